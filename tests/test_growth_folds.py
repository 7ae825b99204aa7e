"""Folds by hour: rounds don't grow with the hours for which a state is kept."""

import random

import pyarrow as pa

from logquill.operators import baseline, folds

KEY = "CLM.PRC"


def seconds(n, seed, high):
    """An hour's rows, with sums as if every second's windows were full."""
    random.seed(seed)
    rows = []
    for i in range(n):
        share = high(i)
        x = {w: (w * 5, sum(random.random() < share for _ in range(w * 5))) for w in (10, 30, 60)}
        x[300] = (1500, round(1500 * share))
        rows.append({"key": KEY} | {f"{c}{w}": v for w, tv in x.items() for c, v in zip(("tot", "err"), tv, strict=True)} | {"t_tot": 50, "t_err": x[10][1], "limit_rate": 0.05, "min_n": 20, "least": 20, "base": 0.002})
    return pa.Table.from_pylist(rows)


def test_what_an_hour_tells_holds_for_other_states():
    """brief and follow against a fold from the other state."""
    alpha, open_state = 2 / 301, {"mean": 0.004, "var": 6e-6, "seen": 120, "run": 0, "quiet": 0, "cusum": 9.0, "open": True}
    closed, known = open_state | {"cusum": 0.0, "open": False}, 0
    for seed, high in enumerate((lambda i: 0.008, lambda i: 0.03 * (i % 100 < 60), lambda i: 0.0, lambda i: 0.004, lambda i: 0.06 * (i > 40))):
        own = seconds(200, seed, high)
        for state in (open_state, closed):
            told = baseline.brief(own, state, alpha)
            for other in [state | {"cusum": c, "quiet": q if state["open"] else 0} for c in (0.0, 0.4, 2.0, 4.9, 5.1, 9.5, 80.0) for q in (0, 12, 30)]:
                after = baseline.follow(state, told, other)
                if after is not None:
                    known += 1
                    assert folds.same(after | {"cusum": 0.0}, (right := baseline.brief(own, other, alpha)[0]) | {"cusum": 0.0}) and abs(after["cusum"] - right["cusum"]) < 1e-9
    assert known > 40


def test_a_state_that_is_kept_takes_few_rounds(spark, monkeypatch):
    """A value that is set in the first second and kept for 40 hours; before, a round an hour."""
    rounds = []
    keep = folds.written
    monkeypatch.setattr(folds, "written", lambda df, label: rounds.append(label) or keep(df, label))
    rows = spark.createDataFrame([("a", s, 7 if s == 0 else None) for s in range(0, 400, 2)] + [("b", 3, 1)], "key string, sec long, x long")

    def fold(own, state):
        kept = next((x for x in reversed(own["x"].to_pylist()) if x is not None), state["kept"])
        return own.select(["key", "sec"]).append_column("kept", pa.array([kept] * own.num_rows, pa.int64())), {"kept": kept}

    guess = lambda r: r.select("key", "_hour", folds.F.lit(0).cast("long").alias("kept")).distinct()
    out = folds.fold_by_hour(rows, guess, fold, "kept long", "key string, sec long, kept long", hour_s=10).collect()
    assert {(x["key"], x["sec"], x["kept"]) for x in out} == {("a", s, 7) for s in range(0, 400, 2)} | {("b", 3, 1)}
    assert rounds.count("fold-ends") <= 3
    assert folds.fold_by_hour(rows.limit(0), guess, fold, "kept long", "key string, sec long, kept long", hour_s=10).count() == 0
