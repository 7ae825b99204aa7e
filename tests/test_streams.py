"""Streams: wrong clocks, components that fall silent, the lives of incidents, restarts."""

import os
from collections import Counter

from pyspark.sql import functions as F

from logquill.operators import detectors, drift, windows
from logquill.streaming import alerts, clock, lifecycle, per_second
from logquill.streaming.timed import stream_session

START = 1_700_000_000


def put(frame, folder, k):
    """frame as one file of a stream's folder, the k-th."""
    before = set(folder.glob("*.parquet")) if folder.exists() else set()
    frame.coalesce(1).write.mode("append").parquet(str(folder))
    for path in set(folder.glob("*.parquet")) - before:
        os.utime(path, (START + k, START + k))


def test_one_wrong_clock_holds_nothing_up(spark, tmp_path):
    own, folder = stream_session(spark), tmp_path / "log"
    folder.mkdir()
    for k in range(6):
        lines = [f"{(START + k * 10 + i) * 1000:013d}|I|CLM|STR|00000|000042|0000abcd|ok" for i in range(10)]
        lines += [f"{(START + 1_000_000) * 1000:013d}|I|CLM|STR|00000|000042|0000abcd|ahead"] if k == 1 else ["1000000000000|I|CLM|STR|00000|000042|0000abcd|behind", "no line"] if k == 3 else []
        (folder / f"{k}.log").write_text("\n".join(lines) + "\n")
        os.utime(folder / f"{k}.log", (START + k, START + k))
    for _ in range(2):  # the second time as after a crash that forgot the checkpoint but not what was written
        clock.guard(per_second.read_log_stream(own, str(folder)), str(tmp_path / "g"), str(tmp_path / f"c{_}"))
        files = sorted(str(p) for p in (tmp_path / "g" / "lines").rglob("*.parquet"))
        assert _ == 0 or files == first
        first = files
    good, aside = clock.guarded(own, str(tmp_path / "g"))
    table, _ = per_second.drained(per_second.settled_counts(good), "t")
    assert {(r["sec"], r["tot"]) for r in table.collect()} == {(START + s, 1) for s in range(58)}
    assert {(r["message"], r["clock"]) for r in aside.collect()} == {("ahead", "ahead"), ("behind", "behind")}


def test_the_time_is_where_most_lines_are(spark):
    def clocks(counts):
        return {r["stretch"]: r["clock"] for r in clock.judged(spark.createDataFrame(counts, "stretch long, n long")).collect()}

    assert clocks([(10, 5), (11, 900), (12, 90), (500, 1), (2, 3)]) == {10: "ok", 11: "ok", 12: "ok", 500: "ahead", 2: "behind"}
    assert clocks([(10, 100), (20, 900)]) == {10: "ok", 20: "ok"}  # an outage, not a clock
    assert clocks([(10, 900), (20, 100)]) == {10: "ok", 20: "ahead"}
    assert clocks([]) == {}


def test_silent_components_are_judged_and_a_restart_goes_on(spark, tmp_path):
    """CLM.STR fails in one second and falls silent: its alert is due in the next one. CLM.DUP falls silent,
    too. Others speak on, so time goes on."""
    own, folder = stream_session(spark), tmp_path / "counts"
    rows = [(k, START + s, 5, 0) for k in ("ELG.X12", "ADM.AUD") for s in range(300)]
    rows += [("CLM.DUP", START + s, 4, 0) for s in range(90)] + [("CLM.STR", START + 100, 100, 50), ("CLM.STR", START + 250, 1, 0)]
    counts = spark.createDataFrame(rows, "key string, sec long, tot long, err long")
    found = {}
    for k, (a, b) in enumerate([(0, 95), (95, 140), (140, 300)]):
        put(counts.where((F.col("sec") >= START + a) & (F.col("sec") < START + b)), folder, k)
        stream = own.readStream.schema(counts.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        for name, judge in (("fast", alerts.fast_alerts), ("silence", alerts.silence_alerts)):
            per_second.drain(judge(stream), str(tmp_path / name), str(tmp_path / f"{name}-state"))
            found[name] = {(r["key"], r["opened_sec"]) for r in spark.read.parquet(str(tmp_path / name)).collect()}
        assert found["fast"] == ({("CLM.STR", START + 101)} if k else set())  # 101 is silent, and settled in the second run
    every = windows.dense(counts, ("tot", "err"))
    runs = drift.silence_runs(every).where("silent").collect()
    assert found["silence"] == {(r["key"], r["first_sec"] + drift.SILENT_S) for r in runs} == {("CLM.DUP", START + 172), ("CLM.STR", START + 190)}
    based = detectors.with_baseline(windows.sliding(every, ("tot", "err")))
    states = detectors.hysteresis(based, detectors.z_rule(based, 10, detectors.Z_FAST), F.lit(detectors.K_FAST))
    assert found["fast"] == {(r["key"], r["sec"]) for r in states.where("opened_now").collect()}


def test_state_is_gone_after_long_silence():
    seen = []
    fold = alerts.each_second(lambda key: {}, lambda state, key, sec, tot, err: seen.append(sec))
    out, state, again = fold(("k",), None, [(10, (1, 0))], 20)
    assert (out, again, seen) == ([], 21, list(range(10, 21)))
    assert fold(("k",), state, [], 909)[1:] == (state, 910)
    assert fold(("k",), state, [], 5000)[1:] == (None, None) and seen[-1] == 909
    _, state, again = fold(("k",), None, [(0, (1, 0)), (2000, (1, 0))], 2001)  # both in one batch
    assert (state["spoken"], again) == (2000, 2002)


EVENTS = [
    ("alert", 0), ("alert", 60), ("alert", 60), ("acknowledged", 180), ("alert", 301), ("acknowledged", 302), ("alert", 340), ("alert", 500), ("alert", 600), ("alert", 900),
    ("acknowledged", 1100), ("alert", 1500), ("alert", 2000),
]
LIVES = [
    (0, "opened", 0, 1), (0, "acknowledged", 180, 3), (301, "opened", 301, 1), (301, "acknowledged", 302, 1), (500, "opened", 500, 1), (600, "opened", 600, 1), (500, "resolved", 621, 1),
    (600, "resolved", 721, 1), (600, "reopened", 900, 2), (600, "resolved", 1021, 2), (1500, "opened", 1500, 1), (1500, "resolved", 1621, 1), (2000, "opened", 2000, 1),
]


def test_lives_of_incidents_in_many_batches(spark, tmp_path):
    own, folder = stream_session(spark), tmp_path / "events"
    events = spark.createDataFrame([(k, "fast", START + s, w) for k in ("a", "b") for w, s in EVENTS if k == "a" or s < 700] + [("c", "fast", START + 2000, "acknowledged")], "key string, rule string, sec long, what string")
    for k, (a, b) in enumerate([(0, 100), (100, 700), (700, 701), (701, 2001)]):
        put(events.where((F.col("sec") >= START + a) & (F.col("sec") < START + b)), folder, k)
        stream = own.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        life = lifecycle.incident_life(stream.where("what = 'alert'"), stream.where("what = 'acknowledged'"))
        per_second.drain(life, str(tmp_path / "life"), str(tmp_path / "state"))
    got = {key: sorted((r["incident"] - START, r["event"], r["sec"] - START, r["n"]) for r in spark.read.parquet(str(tmp_path / "life")).where(F.col("key") == key).collect()) for key in "abc"}
    assert got == {"a": sorted(LIVES), "b": sorted(x for x in LIVES if x[0] < 700 and x[2] < 900), "c": []}
    out, state, again = lifecycle.follow(("a", "r"), None, [(s, (w, n)) for (s, w), n in sorted(Counter((s, w) for w, s in EVENTS).items())], 2000)
    assert sorted(x[2:] for x in out) == sorted(LIVES) and again == 2120
    assert lifecycle.follow(("a", "r"), state, [], 2421)[1:] == (None, None)
