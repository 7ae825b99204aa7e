"""Fault windows, their propagation, the daily curve, and evaluation against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquill.functions import stats as s
from logquill.sources import vocabulary as voc

GRACE_S = 60


def scheduled(spark, first_sec: int, every_s: int = 15) -> DataFrame:
    """fault, kind, key, target, ramp_s, start_sec, end_sec: the scenarios, one after the other."""
    rows = [(i, kind, key, float(t), float(ramp), first_sec + 10 + i * every_s, first_sec + 10 + i * every_s + int(ramp + hold)) for i, (_, kind, key, t, ramp, hold) in enumerate(voc.SCENARIOS)]
    return spark.createDataFrame(rows, "fault int, kind string, key string, target double, ramp_s double, start_sec long, end_sec long")


def ramped(base: Column, target: Column, sec: Column, start: Column, ramp: Column) -> Column:
    """Linear way from base to target over ramp seconds from start."""
    share = F.when(ramp <= 0, 1.0).otherwise(F.least((sec - start) / ramp, F.lit(1.0)))
    return base + (target - base) * share


def live_faults(rows: DataFrame, faults: DataFrame) -> DataFrame:
    """rows (key, sec) with the last fault that is live for their key, an interval join; faults is the
    operator's own short table."""
    hit = (rows["key"] == faults["key"]) & (rows["sec"] >= faults["start_sec"]) & (rows["sec"] < faults["end_sec"])
    joined = rows.join(F.broadcast(faults), hit).drop(faults["key"])
    last = F.max_by(F.struct("fault", "kind", "target", "ramp_s", "start_sec"), "fault").alias("f")
    return joined.groupBy("key", "sec").agg(last).select("key", "sec", "f.*")


def fault_values(rows: DataFrame, faults: DataFrame) -> DataFrame:
    """key, sec, fault, value: the error rate that a rate fault sets at each second."""
    base = voc.components(rows.sparkSession).select("key", F.col("err").alias("base"))
    live = live_faults(rows, faults.where("kind = 'rate'")).join(F.broadcast(base), "key")
    return live.select("key", "sec", "fault", F.round(ramped(F.col("base"), F.col("target"), F.col("sec"), F.col("start_sec"), F.col("ramp_s")), 6).alias("value"))


def expected_rates(sums: DataFrame) -> DataFrame:
    """key, sec, expected: base error rate and, for each upstream component, coupling times what its
    10 s rate lag seconds ago was above its base; at most 1."""
    spark = sums.sparkSession
    base = voc.components(spark).select("key", F.col("err").alias("base"))
    up = base.toDF("src", "up_base")
    edges = voc.edges(spark).withColumn("lag", F.ceil("lag_s")).join(F.broadcast(up), "src")
    rates = sums.select(F.col("key").alias("src"), F.col("sec").alias("then"), s.rate(F.col("err10"), F.col("tot10")).alias("r"))
    wanted = sums.select("key", "sec").join(F.broadcast(edges), F.col("key") == F.col("dst")).withColumn("then", F.col("sec") - F.col("lag"))
    terms = wanted.join(rates, ["src", "then"], "left")
    added = terms.groupBy("key", "sec").agg(F.sum(F.col("coupling") * F.greatest(F.lit(0.0), F.coalesce("r", "up_base") - F.col("up_base"))).alias("added"))
    rows = added.join(F.broadcast(base), "key")
    return rows.select("key", "sec", F.round(F.least(F.col("base") + F.col("added"), F.lit(1.0)), 6).alias("expected"))


def daily_volume(events: DataFrame) -> DataFrame:
    """hour, n, volume, err_mult, adjusted: events by hour of the day against the daily curve."""
    hours = events.groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    return hours.join(F.broadcast(voc.daily_curve(events.sparkSession)), "hour", "left").fillna({"volume": 1.0, "err_mult": 1.0}).withColumn("adjusted", F.round(F.col("n") / F.col("volume"), 6))


def hour_of_week(events: DataFrame) -> DataFrame:
    """how (hour of the week, from Sunday), n, median and mad of value: the seasonal baseline. Exact medians of a few hundred groups."""
    how = ((F.dayofweek("ts") - 1) * 24 + F.hour("ts")).alias("how")
    rows = events.select(how, "value")
    middle = rows.groupBy("how").agg(F.count("*").alias("n"), F.median("value").alias("median"))
    off = rows.join(F.broadcast(middle), "how").groupBy("how").agg(F.median(F.abs(F.col("value") - F.col("median"))).alias("mad"))
    return middle.join(off, "how").select("how", "n", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


def evaluate(alerts: DataFrame, faults: DataFrame, grace_s: int = GRACE_S) -> DataFrame:
    """fault, key, detected, delay_s: for each fault whether an alert of its key opened while it was
    live or within the grace time, and how long it took."""
    near = (alerts["key"] == faults["key"]) & (alerts["opened_sec"] >= faults["start_sec"]) & (alerts["opened_sec"] <= faults["end_sec"] + grace_s)
    found = faults.join(alerts, near, "left").groupBy(faults["fault"], faults["key"], faults["start_sec"]).agg(F.min("opened_sec").alias("first"))
    return found.select("fault", "key", F.col("first").isNotNull().alias("detected"), (F.col("first") - F.col("start_sec")).alias("delay_s"))
