"""Windows, detectors, severity and incidents against plain sequential versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from logquill.functions import redact as r
from logquill.functions import stats as s
from logquill.operators import baseline, detectors, drift, faults, incidents, redaction, reporting, seasonal, severity, windows
from logquill.sources import outbox
from logquill.sources import vocabulary as voc


def test_sliding_sums_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(windows, "CHUNK_S", 50)
    rng = random.Random(3)
    seconds = {s: rng.randint(1, 9) for s in range(1000, 1400) if rng.random() < 0.7}
    counts = spark.createDataFrame([("k", s, n, n // 2, 0) for s, n in seconds.items()], "key string, sec long, tot long, err long, warn long")
    rows = windows.sliding(windows.dense(counts)).collect()
    assert [x["sec"] for x in sorted(rows, key=lambda x: x["sec"])] == list(range(min(seconds), max(seconds) + 1))
    for x in rows:
        for w in windows.WINDOWS:
            assert x[f"tot{w}"] == sum(seconds.get(t, 0) for t in range(x["sec"] - w + 1, x["sec"] + 1))


def machine(hits, needed, quiet=30):
    """Opening seconds of a plain state machine."""
    out, run, calm, is_open = [], 0, 0, False
    for t, hit in enumerate(hits):
        run, calm = (run + 1, 0) if hit else (0, calm + 1)
        if is_open and calm > quiet:
            is_open = False
        if not is_open and run >= needed:
            is_open = True
            out.append(t)
    return out


@pytest.mark.parametrize("chunk_s", [7, 50, 3600])
def test_hysteresis_equals_a_state_machine(spark, monkeypatch, chunk_s):
    monkeypatch.setattr(detectors, "CHUNK_S", chunk_s)
    rng, rows, want = random.Random(11), [], set()
    for k in range(60):
        needed, chance, hits = rng.choice([2, 5]), rng.choice([0.05, 0.3, 0.7]), []
        while len(hits) < 300:
            hits += [rng.random() < chance] * rng.choice([1, 1, 3, 8, 40])
        hits = hits[:300]
        rows += [(f"k{k}", t, h, needed) for t, h in enumerate(hits)]
        want |= {(f"k{k}", t) for t in machine(hits, needed)}
    df = spark.createDataFrame(rows, "key string, sec long, hit boolean, needed int")
    got = detectors.hysteresis(df, F.col("hit"), F.col("needed")).where("opened_now").collect()
    assert {(x["key"], x["sec"]) for x in got} == want and want


@pytest.mark.parametrize("chunk_s", [7, 50, 3600])
def test_cusum_equals_the_recursion(spark, monkeypatch, chunk_s):
    monkeypatch.setattr(detectors, "CHUNK_S", chunk_s)
    rng = random.Random(5)
    rows = [("k", t, rng.choice([10 if t % 90 < 15 else 100, 100, 100]), rng.randint(0, 9), 0.02) for t in range(400)]
    got = detectors.cusum(spark.createDataFrame(rows, "key string, sec long, tot60 long, err60 long, base double"))
    value = 0.0
    want = []
    for _, _, tot, err, base in rows:
        value = 0.0 if tot < 20 else max(value + err / tot - base - 0.5 * 1e-4, 0.0)
        want.append(value)
    assert [x["cusum"] for x in got.orderBy("sec").collect()] == pytest.approx(want, abs=1e-9)


def test_statistics(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert one(s.binomial_z(lit(270), lit(1000), lit(0.002))) == pytest.approx((270 - 2) / math.sqrt(1000 * 0.002 * 0.998))
    assert one(s.binomial_z(lit(1), lit(10), lit(0.0))) == 64.0 and one(s.binomial_z(lit(0), lit(0), lit(0.1))) == 0.0
    assert one(s.wilson_lower(lit(0), lit(20))) == 0.0 and 0.10 < one(s.wilson_lower(lit(3), lit(10))) < 0.11 and one(s.wilson_lower(lit(0), lit(0))) == 0.0
    js = lambda p, q: one(sum((s.js_term(lit(a), lit(b)) for a, b in zip(p, q, strict=True)), lit(0.0)))
    assert js([0.25] * 4, [0.25] * 4) < 0.01 and js([0.5, 0.3, 0.1, 0.1], [0.1, 0.1, 0.3, 0.5]) > 0.1
    assert one(s.severity_level(lit(0.55))) == "CRITICAL" and one(s.severity_level(lit(0.1))) == "INFO"
    assert 45 <= one(s.backoff_s(lit(1), lit("k"))) <= 75 and 2700 <= one(s.backoff_s(lit(9), lit("k"))) <= 4500
    assert one(s.cycle_score(lit(60.0), 60.0)) == 1.0 and one(s.cycle_score(lit(120.0), 60.0)) == 0.0


def test_rules_come_in_order(spark):
    """A burst of errors in one component opens a fast alert of that component only."""
    rows = [(k, 1000 + t, 100, 30 if k == "CLM.STR" and 200 <= t < 260 else 0, 0) for _, k, *_ in voc.DEFAULT.component_rows() for t in range(400)]
    counts = spark.createDataFrame(rows, "key string, sec long, tot long, err long, warn long")
    states = detectors.alert_states(windows.sliding(windows.dense(counts)))
    opened = detectors.alerts(states).collect()
    assert [(x["key"], x["rule"], x["window_s"]) for x in opened] == [("CLM.STR", "fast", 10)]
    assert 1200 <= opened[0]["opened_sec"] <= 1203
    scored = severity.reasons(severity.scored(detectors.alerts(states))).first()
    assert scored["criticality"] == 1.0 and "CLM.STR error rate" in scored["reason"] and scored["severity"] in severity.LEVELS
    held = faults.evaluate(detectors.alerts(states), spark.createDataFrame([(0, "rate", "CLM.STR", 0.3, 0.0, 1200, 1260), (1, "rate", "PAY.BNK", 0.3, 0.0, 1200, 1260)], "fault int, kind string, key string, target double, ramp_s double, start_sec long, end_sec long"))
    assert {x["fault"]: x["detected"] for x in held.collect()} == {0: True, 1: False}


def test_learned_baseline_freezes_while_open(spark):
    rows = [("CLM.STR", t, 100, 40 if 600 <= t < 700 else 1, 0) for t in range(1000)]
    sums = windows.sliding(windows.dense(spark.createDataFrame(rows, "key string, sec long, tot long, err long, warn long")))
    got = {x["sec"]: x for x in baseline.learned(sums).collect()}
    assert 0.005 < got[599]["ewma"] < 0.015 and any(got[t]["open"] for t in range(602, 700)) and got[900]["rule"] == "cusum"  # the sum of a burst holds on
    assert got[699]["ewma"] == got[650]["ewma"]
    value = 0.0
    for x in sums.orderBy("sec").collect():
        value += 2 / 301 * (x["err300"] / max(x["tot300"], 1) - value)
    assert baseline.ewma(sums).first()["ewma"] == pytest.approx(value, abs=1e-6)


def test_a_baseline_learned_in_hours_is_the_one_learned_in_one_go(spark):
    rows = [(k, t, 100, (40 if a <= t < a + 90 else 1) + t % 3, 0) for k, a in (("CLM.STR", 250), ("CLM.EDT", 390)) for t in range(800)]
    sums = windows.sliding(windows.dense(spark.createDataFrame(rows, "key string, sec long, tot long, err long, warn long"))).cache()
    whole, cut = ({(x["key"], x["sec"]): x for x in baseline.learned(sums, hour_s=h).collect()} for h in (10**9, 200))
    assert whole.keys() == cut.keys() and len(cut) == 1600 and any(x["open"] for x in cut.values())
    for k, x in whole.items():
        assert (x["rule"], x["open"], x["opened_now"], x["warming"]) == (cut[k]["rule"], cut[k]["open"], cut[k]["opened_now"], cut[k]["warming"])
        assert [x[c] for c in ("base", "ewma", "sigma", "z10", "z60", "cusum")] == pytest.approx([cut[k][c] for c in ("base", "ewma", "sigma", "z10", "z60", "cusum")], abs=1e-9)


def test_the_last_minute_reaches_over_hours(spark):
    rng = random.Random(2)
    lines = [("CLM.STR", t, rng.choice([3, 4, 9, 19]), rng.randint(1, 3)) for t in range(3500, 3700) if t % 7]
    got = {x["sec"]: (x["lines"], x["upper_ms"]) for x in drift.sliding_p95(spark.createDataFrame(lines, "key string, sec long, bin int, n long")).collect()}
    want = {}
    for s in range(3500, 3700):
        last = sorted(b for _, t, b, n in lines for _ in range(n) if s - 60 < t <= s)
        good = [b for b in last if b <= 18]
        if len(last) >= 20:
            want[s] = (len(last), 2 ** next(b for b in sorted(set(good)) if sum(x <= b for x in good) >= 0.95 * len(good)))
    assert got == {s: x for s, x in want.items() if s <= max(t for _, t, *_ in lines)}
    codes = [("CLM.STR", "X1", t, rng.randint(1, 2)) for t in range(3570, 3640, 5)]
    counts = [("CLM.STR", t, 9) for t in range(3500, 3700)]
    found = {x["sec"]: (x["n"], x["lines"], x["is_new"]) for x in drift.new_codes(spark.createDataFrame(codes, "key string, code string, sec long, n long"), spark.createDataFrame(counts, "key string, sec long, tot long")).collect()}
    plain = {s: (sum(n for _, _, t, n in codes if s - 60 < t <= s), 9 * min(60, s - 3499)) for s in range(3570, 3700)}
    assert found == {s: (n, m, n >= 5 and n >= 0.01 * m) for s, (n, m) in plain.items() if n}


def test_seasonal_summaries_add_up_within_their_error(spark):
    rng = random.Random(8)
    rows = [(k, rng.lognormvariate(2, 1) if k != "z" else 0.0) for k in "xxxyz" for _ in range(200)]
    df = spark.createDataFrame([*rows, ("x", None)], "key string, value double")
    parts = [seasonal.summary(df.where(x), "value", "key") for x in ("value < 5 OR value IS NULL", "value >= 5")]
    usual = seasonal.baseline(seasonal.added(*parts, "key"), "key").collect()
    for r in usual:
        own = sorted(v for k, v in rows if k == r["key"])
        median = own[(len(own) - 1) // 2]
        mad = sorted(abs(v - median) for v in own)[(len(own) - 1) // 2]
        assert r["n"] == len(own) and r["median"] == pytest.approx(median, rel=seasonal.ERROR + 1e-9) and r["mad"] == pytest.approx(mad, abs=4 * seasonal.ERROR * (median + mad) + 1e-9)
    hits = seasonal.seasonal_alerts(df, "value", seasonal.baseline(seasonal.summary(df, "value", "key"), "key"), "key").collect()
    assert {r["key"] for r in hits} <= {"x", "y"} and all(r["z"] >= 3.5 for r in hits) and hits


def test_levels_are_held_over_hours(spark):
    rng = random.Random(4)
    rows = [(k, t, rng.choice(["INFO"] * 12 + ["WARNING", "HIGH"])) for k in "ab" for t in range(300)]
    df = spark.createDataFrame(rows, "key string, sec long, severity string")
    whole, cut = ({(x["key"], x["sec"]): x["held"] for x in severity.hold_levels(df, hour_s=h).collect()} for h in (10**9, 20))
    assert whole == cut and len(set(cut.values())) == 3


def test_levels_rise_at_once_and_fall_late(spark):
    names = ["INFO"] * 3 + ["CRITICAL"] + ["INFO"] * 14 + ["WARNING"] + ["INFO"] * 20
    df = spark.createDataFrame([("k", t, n) for t, n in enumerate(names)], "key string, sec long, severity string")
    held = [x["held"] for x in severity.hold_levels(df).orderBy("sec").collect()]
    assert held[3:18] == ["CRITICAL"] * 15 and held[18] == "WARNING" and held[-1] == "INFO" and held[20] == "WARNING"


@pytest.fixture(scope="module")
def some_alerts(spark):
    rows = [("ELG.CCH", "fast", 100), ("ELG.MBR", "fast", 110), ("CLM.EDT", "fast", 130), ("CLM.STR", "slow", 105), ("CLM.PRC", "fast", 400), ("ELG.MBR", "fast", 140), ("ELG.MBR", "fast", 240), ("ELG.MBR", "fast", 500)]
    return spark.createDataFrame(rows, "key string, rule string, opened_sec long")


def test_origins_and_chains(some_alerts):
    got = {(x["key"], x["opened_sec"]): x["origin"] for x in incidents.suspected_origins(some_alerts).collect()}
    assert got["CLM.EDT", 130] == "ELG.CCH" and got["ELG.CCH", 100] == "ELG.CCH" and got["CLM.STR", 105] == "CLM.STR" and got["CLM.PRC", 400] == "CLM.PRC"
    chains = {x["origin"]: x["chain"] for x in incidents.downstream_chains(incidents.suspected_origins(some_alerts)).collect()}
    assert chains["ELG.CCH"].startswith("ELG.CCH>ELG.MBR>CLM.EDT") and chains["CLM.PRC"] == "CLM.PRC"


def test_incidents(some_alerts):
    rows = [(x["opened_sec"], x["last_sec"], x["n"]) for x in incidents.incident_sessions(some_alerts.where("key = 'ELG.MBR'")).orderBy("incident").collect()]
    assert rows == [(110, 140, 2), (240, 500, 2)]  # 100 s later is a new one, 260 s later reopens it
    state = incidents.incident_state(incidents.incident_sessions(some_alerts), 550).collect()
    assert {x["key"]: x["status"] for x in state if x["last_sec"] == 500} == {"ELG.MBR": "OPEN"}


def test_records_and_acknowledgement(spark, some_alerts):
    scored = some_alerts.withColumn("severity", F.when(F.col("opened_sec") == 140, "CRITICAL").otherwise("WARNING"))
    rows = incidents.records(incidents.incident_sessions(some_alerts), scored, incidents.suspected_origins(some_alerts), 300)
    got = {(x["key"], x["opened_sec"]): x for x in rows.collect()}
    first = got["ELG.MBR", 110]
    assert (first["id"], first["max_severity"], first["origin"], first["status"], first["cooldown_until_sec"]) == ("inc_0003", "CRITICAL", "ELG.CCH", "RESOLVED", 560)
    acks = spark.createDataFrame([("inc_0003", 150), ("inc_0003", 155), ("inc_0001", 900)], "id string, ack_sec long")
    after = {x["id"]: x for x in incidents.acknowledged(rows, acks).collect()}
    assert after["inc_0003"]["status"] == "ACKNOWLEDGED" and after["inc_0003"]["ack_sec"] == 150 and after["inc_0003"]["cooldown_until_sec"] is None
    assert after["inc_0001"]["status"] == "RESOLVED" and len(after) == rows.count()


def test_origins_of_far_alerts_do_not_meet(spark):
    """Alerts on either side of a stretch's end meet if they are near enough, and only then."""
    rows = [("ELG.CCH", "fast", 119), ("ELG.MBR", "fast", 121), ("CLM.EDT", "fast", 239), ("CLM.PRC", "fast", 240), ("ELG.X12", "fast", 1000)]
    got = {x["key"]: x["origin"] for x in incidents.suspected_origins(spark.createDataFrame(rows, "key string, rule string, opened_sec long")).collect()}
    assert got == {"ELG.CCH": "ELG.CCH", "ELG.MBR": "ELG.CCH", "CLM.EDT": "ELG.CCH", "CLM.PRC": "ELG.MBR", "ELG.X12": "ELG.X12"}


def test_severity_by_hand(spark):
    """Literal answers: weights 0.40, 0.18, 0.22, 0.10 and 0.10."""
    rows = [("CLM.STR", "fast", 5, 10, 60, 15.0, 0.5, 0.005), ("PAY.BNK", "cusum", 5, 10, 0, 0.0, 0.002, 0.002)]
    df = spark.createDataFrame(rows, "key string, rule string, opened_sec long, window_s int, seconds_in_breach long, z double, observed double, baseline double")
    got = {x["key"]: x for x in severity.explained(severity.scored(df)).collect()}
    want = 0.40 * (0.5 * 0.5 + 0.5 * 1.0) + 0.18 * 0.5 + 0.22 * 1.0 + 0.10 * (0.5 / 0.99 / 14.4)
    assert got["CLM.STR"]["score"] == pytest.approx(want, abs=1e-6) and got["CLM.STR"]["severity"] == "CRITICAL"
    parts = got["CLM.STR"]["reason"].split("; ")
    assert parts[:3] == ["z=15.0 over 10s", "CLM.STR error rate 50.0% vs baseline 0.5%", "breaching for 60s"] and "payments depend on this component" in parts
    assert parts[-1] == "score 0.61 -> CRITICAL" and not any("burn" in p for p in parts)
    burning = severity.explained(severity.scored(df).withColumn("burn_rate", F.lit(15.0))).where("key = 'CLM.STR'").first()["reason"]
    assert "; burn rate 15.0x: page; " in burning
    assert "too high for long" in got["PAY.BNK"]["reason"] and "breaching" not in got["PAY.BNK"]["reason"]


def test_shape_rules_open_once_in_a_run(spark):
    dense = spark.createDataFrame([("CLM.EDT", t, 0 if 100 <= t < 180 else 5) for t in range(400)], "key string, sec long, tot long")
    mixed = spark.createDataFrame([("CLM.EDT", t, t in (10, 50, 51, 52, 90)) for t in range(400)], "key string, sec long, drifted boolean")
    none = spark.createDataFrame([], "key string, sec long, shifted boolean")
    new = spark.createDataFrame([("CLM.EDT", t, True) for t in range(240, 300)], "key string, sec long, is_new boolean")
    got = drift.advanced_alerts(dense, mixed, none, new, drift.silence_runs(dense)).collect()
    assert sorted((x["rule"], x["opened_sec"]) for x in got) == [("mix", 51), ("new_code", 241), ("silence", 184)]


def test_routes_and_reports(spark):
    scored = spark.createDataFrame([("a", "HIGH"), ("b", "CRITICAL"), ("c", "HIGH")], "key string, severity string")
    assert {x["key"]: x["route"] for x in reporting.routed(scored).collect()} == {"a": "email", "b": "sms", "c": "email"}
    assert {x["metric"]: x["n"] for x in reporting.severity_counts(scored).collect()} == {"AlertCount_INFO": 0, "AlertCount_WARNING": 0, "AlertCount_HIGH": 2, "AlertCount_CRITICAL": 1}
    counts = spark.createDataFrame([("k", 0, 4), ("k", 30, 2), ("k", 61, 6), ("k", 3600, 1), ("k", 3630, 5)], "key string, sec long, tot long")
    got = {x["sec"]: (x["total"], x["rate"]) for x in reporting.rolling_rate(counts).collect()}
    assert got == {0: (4, 4.0), 30: (6, 0.2), 61: (8, 8 / 31), 3600: (1, 1.0), 3630: (6, 0.2)}


@pytest.mark.parametrize(("text", "marks"), [("ssn 123-45-6789 and 123456789", 2), ("born 1990-05-15 or 05/15/1990", 2), ("john.doe@example.com", 1), ("555-123-4567, (555) 123-4567", 2), ("MBR-12345 CLM-88213 NPI-1234567890", 3), ("nothing here", 0)])
def test_redaction(spark, text, marks):
    row = spark.range(1).select(r.redact(F.lit(text)).alias("t"), r.has_personal_data(F.lit(text)).alias("f")).first()
    assert row["t"].count(r.MARK) == marks and row["f"] == bool(marks)


def test_redaction_of_nested_values(spark):
    df = spark.createDataFrame([("a MBR-1", ["CLM-2", None], {"k": "x@y.org"}, (1, "NPI-3"))], "a string, b array<string>, c map<string,string>, d struct<n:int,s:string>")
    row = redaction.redact_all(df, keep=("a",)).first()
    assert row["a"] == "a MBR-1" and row["b"] == [r.MARK, None] and row["c"] == {"k": r.MARK} and row["d"]["s"] == r.MARK


def test_outbox(spark, some_alerts):
    box = outbox.entries(some_alerts)
    assert outbox.add(box, outbox.entries(some_alerts)).count() == box.count() == 8
    due = outbox.pending(box, 130, limit=3).collect()
    assert [x["next_attempt_s"] for x in due] == [100, 105, 110]
    results = spark.createDataFrame([(due[0]["idempotency_key"], True), (due[1]["idempotency_key"], False)], "idempotency_key string, ok boolean")
    after = {x["idempotency_key"]: x for x in outbox.settle(box, results, 200).collect()}
    assert after[due[0]["idempotency_key"]]["status"] == "delivered"
    failed = after[due[1]["idempotency_key"]]
    assert failed["status"] == "pending" and failed["attempts"] == 1 and 245 <= failed["next_attempt_s"] <= 275
    assert {x["status"]: x["n"] for x in outbox.stats(box).collect()} == {"pending": 8, "in_progress": 0, "delivered": 0, "failed": 0}
    old = box.withColumn("status", F.lit("delivered"))
    assert outbox.clean(old, 8 * 86400).count() == 0 and outbox.clean(box, 8 * 86400).count() == 8
