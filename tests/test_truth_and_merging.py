"""Matching of alerts to faults, merged incidents and the outbox table, against plain versions."""

import random
import shutil

from logquill.operators import merged, truth
from logquill.sources import outbox
from logquill.sources import vocabulary as voc
from logquill.streaming.timed import stream_session


def most_pairs(points, spans):
    """How many pairs of a point and a span around it there can be at most, by augmenting paths."""
    taken = {}

    def place(i, seen):
        for j, (a, b) in enumerate(spans):
            if a <= points[i] <= b and j not in seen:
                seen.add(j)
                if j not in taken or place(taken[j], seen):
                    taken[j] = i
                    return True
        return False

    return sum(place(i, set()) for i in range(len(points)))


def test_as_many_alerts_are_matched_as_can_be(spark):
    rng = random.Random(3)
    faults = [(k, n * 100 + i, s := rng.randint(0, 4000), s + rng.randint(0, 900)) for n, k in enumerate("abc") for i in range(25)]
    alerts = [(k, rng.randint(0, 5000)) for k in "abcd" for _ in range(60)]
    fault_rows, alert_rows = spark.createDataFrame(faults, "key string, fault long, start_sec long, end_sec long"), spark.createDataFrame(alerts, "key string, opened_sec long")
    pairs = truth.matched(alert_rows, fault_rows).collect()
    at = {(k, f): (s, e + truth.GRACE_S) for k, f, s, e in faults}
    assert all(at[p["key"], p["fault"]][0] == p["start_sec"] <= p["opened_sec"] <= at[p["key"], p["fault"]][1] for p in pairs)
    assert len({(p["key"], p["fault"]) for p in pairs}) == len(pairs)
    for k in "abcd":
        own = [p["opened_sec"] for p in pairs if p["key"] == k]
        points = [t for x, t in alerts if x == k]
        assert all(own.count(t) <= points.count(t) for t in own)
        assert len(own) == most_pairs(points, [v for (x, _), v in at.items() if x == k])
    got = {r["key"]: r for r in truth.scores(alert_rows, fault_rows, 2.0).collect()}
    inside = sum(any(x == k and a <= t <= b for (x, _), (a, b) in at.items()) for k, t in alerts)
    assert (got["ALL"]["alerts"], got["ALL"]["in_faults"], got["ALL"]["faults"], got["ALL"]["matched"]) == (240, inside, 75, len(pairs))
    assert (got["d"]["precision"], got["d"]["recall"], got["d"]["false_alerts"], got["d"]["delay_p95"], got["d"]["false_per_hour"]) == (0.0, None, 60, None, 30.0)
    assert truth.scores(alert_rows.limit(0), fault_rows.limit(0), 1.0).collect() == []


def test_incidents_are_merged_along_dependencies(spark):
    rng = random.Random(5)
    keys = [r[1] for r in voc.DEFAULT.component_rows()]
    alerts = sorted({(rng.choice(keys), rng.choice(["fast", "slow"]), rng.randint(3000, 12000)) for _ in range(400)}, key=lambda x: (x[2], x[0], x[1]))
    deploys = [(rng.choice(keys), rng.randint(2500, 12000), f"R-{i}") for i in range(60)]
    near = {(a, b) for a, b, *_ in voc.EDGES} | {(b, a) for a, b, *_ in voc.EDGES} | {(k, k) for k in keys}
    root = list(range(len(alerts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (a, _, s) in enumerate(alerts):
        for j in range(i):
            if (a, alerts[j][0]) in near and s - alerts[j][2] <= 120:
                root[max(top(i), top(j))] = min(top(i), top(j))
    groups = {}
    for i, x in enumerate(alerts):
        groups.setdefault(top(i), []).append(x)
    want = set()
    for i, own in groups.items():
        names = sorted({k for k, *_ in own})
        last = max(((s, r) for k, s, r in deploys if k in names and 0 <= alerts[i][2] - s <= 600), default=(None, None))
        want.add((alerts[i][0], alerts[i][2], max(s for *_, s in own), len(own), ",".join(names), last[1], last[0]))
    rows = merged.merged_incidents(spark.createDataFrame(alerts, "key string, rule string, opened_sec long"), spark.createDataFrame(deploys, "key string, sec long, release string")).collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want) and max(len(x[4].split(",")) for x in want) >= 3


def test_an_entry_is_there_once_whenever_a_run_is_killed(spark, tmp_path):
    own = stream_session(spark)
    rows = [(f"k{i % 7}", "fast", i) for i in range(60)] + [("k1", "fast", 1)]
    for k in range(3):
        own.createDataFrame(rows[k * 20 : k * 20 + 25], "key string, rule string, opened_sec long").coalesce(1).write.mode("append").parquet(str(tmp_path / "alerts"))
    path, record = str(tmp_path / "outbox"), outbox.record_batches(str(tmp_path / "outbox"))

    def run():
        stream = own.readStream.schema("key string, rule string, opened_sec long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "alerts"))
        stream.writeStream.foreachBatch(record).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["payload"] for r in outbox.stored_entries(spark, path).collect())

    whole = run()
    assert len(whole) == 60 and len(set(whole)) == 60
    forget = lambda: [p.unlink() for p in (tmp_path / "c" / "commits").glob("*2*")]
    forget()  # killed after the last batch's commit in the outbox, before the stream's
    assert run() == whole
    forget()
    shutil.rmtree(tmp_path / "outbox" / "commits" / "batch=2")  # killed between entries and commit
    assert len(outbox.stored_entries(spark, path).collect()) < 60
    assert run() == whole
