"""Alerts scored against known faults, each alert matched to one fault at most and each fault to one alert."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logquill.operators.faults import GRACE_S

#: Seconds of a stretch of time in which alerts and runs of faults meet.
STRETCH_S = 600
MATCHED = "key string, fault long, start_sec long, opened_sec long"


def runs_of_faults(faults: DataFrame, grace_s: int = GRACE_S) -> DataFrame:
    """faults (key, fault, start_sec, end_sec) with deadline and run, the first start of the faults of a key that overlap
    one after the other: what happens in a run doesn't touch another."""
    timed = faults.select("key", F.col("fault").cast("long").alias("fault"), "start_sec", (F.col("end_sec") + grace_s).alias("deadline"))
    order = Window.partitionBy("key").orderBy("start_sec", "fault")
    upto = F.max("deadline").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.coalesce(F.col("start_sec") > upto, F.lit(True)), F.col("start_sec"))
    return timed.withColumn("run", F.max(fresh).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def in_runs(alerts: DataFrame, runs: DataFrame) -> DataFrame:
    """alerts (key, opened_sec) with the run of faults in which they opened, or null. A run is dealt over the
    stretches of time that it covers, so no key's history is one task."""
    spans = runs.groupBy("key", "run").agg(F.max("deadline").alias("until"))
    stretch = lambda c: F.floor(F.col(c) / STRETCH_S)
    dealt = spans.withColumn("stretch", F.explode(F.sequence(stretch("run"), stretch("until"))))
    near = alerts.select("key", "opened_sec", stretch("opened_sec").alias("stretch")).join(dealt, ["key", "stretch"], "left")
    inside = F.col("opened_sec").between(F.col("run"), F.col("until"))
    # runs of a key don't overlap, but two may touch one stretch
    numbered = near.groupBy("key", "opened_sec", "stretch").agg(F.max(F.when(inside, F.col("run"))).alias("run"), F.count_distinct("run").alias("met"), F.count("*").alias("rows"))
    times = (F.col("rows") / F.greatest(F.col("met"), F.lit(1))).cast("int")  # alerts of one second stay as many
    return numbered.select("key", "opened_sec", "run", F.explode(F.array_repeat(F.lit(0), times))).drop("col")


def matched(alerts: DataFrame, faults: DataFrame, grace_s: int = GRACE_S) -> DataFrame:
    """key, fault, start_sec, opened_sec: as many pairs of a fault and an alert of its key, opened from its start up to grace_s after
    its end, as there can be with no fault or alert in two. Alerts are taken in order of time; each takes the fault that is
    live and ends first, which is known to give the most pairs. A run of overlapping faults is one group."""
    runs = runs_of_faults(faults, grace_s)

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        coming = sorted(zip(left["start_sec"].to_pylist(), left["deadline"].to_pylist(), left["fault"].to_pylist(), strict=True), reverse=True)
        live: list[tuple[int, int, int]] = []
        found = []
        key = left["key"][0].as_py() if len(left) else None
        for at in sorted(right["opened_sec"].to_pylist()):
            while coming and coming[-1][0] <= at:
                start, deadline, fault = coming.pop()
                heapq.heappush(live, (deadline, fault, start))
            while live and live[0][0] < at:
                heapq.heappop(live)
            if live:
                _, fault, start = heapq.heappop(live)
                found.append((key, fault, start, at))
        columns = list(zip(*found, strict=True)) or [[]] * 4
        return pa.table({name: pa.array(x, t) for name, x, t in zip(("key", "fault", "start_sec", "opened_sec"), columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)})

    hits = in_runs(alerts, runs).where("run IS NOT NULL")
    return runs.groupBy("key", "run").cogroup(hits.groupBy("key", "run")).applyInArrow(pair, MATCHED)


def scores(alerts: DataFrame, faults: DataFrame, hours: float, grace_s: int = GRACE_S) -> DataFrame:
    """Of each key, and of all (key ALL): faults, alerts, matched, in_faults (alerts while a fault was live or in its grace time), false_alerts,
    precision (matched of matched and false ones: repeated alerts of a fault are neither), recall, f1, false_per_hour over `hours`, alerts_per_incident (of the matched
    faults), delay_median and delay_p95 in seconds of the matched pairs; null where there is nothing to divide by."""
    keyed = lambda rows, *cols: rows.select(F.explode(F.array("key", F.lit("ALL"))).alias("key"), *cols)
    told = keyed(in_runs(alerts, runs_of_faults(faults, grace_s)), "run").groupBy("key").agg(F.count("*").alias("alerts"), F.count("run").alias("in_faults"))
    real = keyed(faults).groupBy("key").agg(F.count("*").alias("faults"))
    delay = F.col("opened_sec") - F.col("start_sec")
    pairs = keyed(matched(alerts, faults, grace_s), delay.alias("delay")).groupBy("key").agg(F.count("*").alias("matched"), F.percentile("delay", 0.5).alias("delay_median"), F.percentile("delay", 0.95).alias("delay_p95"))
    rows = told.join(real, "key", "full").join(pairs, "key", "full").fillna(0, ["alerts", "in_faults", "faults", "matched"])
    wrong = F.col("alerts") - F.col("in_faults")
    rate = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    hit = F.col("matched")
    return rows.select(
        "key", "faults", "alerts", "matched", "in_faults", wrong.alias("false_alerts"), rate(hit, hit + wrong).alias("precision"), rate(hit, F.col("faults")).alias("recall"),
        rate(2 * hit, hit + wrong + F.col("faults")).alias("f1"), F.round(wrong / F.lit(hours), 6).alias("false_per_hour"), rate(F.col("in_faults"), hit).alias("alerts_per_incident"),
        F.round("delay_median", 6).alias("delay_median"), F.round("delay_p95", 6).alias("delay_p95"),
    )
