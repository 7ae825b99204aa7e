"""Dense seconds and sliding sums.

Windows by key alone would put a component's whole history into one task. Seconds are dealt into
chunks of time instead, each with a lead-in as long as the longest window, which is exact because
the calendar has every second."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOWS = (10, 30, 60, 300)
CHUNK_S = 3600


def dense(counts: DataFrame, values: tuple[str, ...] = ("tot", "err", "warn")) -> DataFrame:
    """counts (key, sec, values...) with a row for every key and second between the first and the
    last, zeros where there was none."""
    # keys are as many as the platform has components; hours are dealt out before they are spread
    span = counts.agg(F.min("sec").alias("a"), F.max("sec").alias("b"), F.collect_set("key").alias("keys")).where("a IS NOT NULL")
    hour = lambda c: F.floor(F.col(c) / CHUNK_S)
    hours = span.select("*", F.explode(F.sequence(hour("a"), hour("b"))).alias("hour")).repartition("hour")
    seconds = hours.select("keys", F.explode(F.sequence(F.greatest("a", F.col("hour") * CHUNK_S), F.least("b", (F.col("hour") + 1) * CHUNK_S - 1))).alias("sec"))
    grid = seconds.select("sec", F.explode("keys").alias("key"))
    return grid.join(counts, ["key", "sec"], "left").select("key", "sec", *(F.coalesce(v, F.lit(0)).cast("long").alias(v) for v in values))


def sliding(rows: DataFrame, values: tuple[str, ...] = ("tot", "err", "warn"), windows: tuple[int, ...] = WINDOWS, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """Sums over the last w seconds, the row's own included, as value + w (tot10, ...), of dense
    rows."""
    longest = max(windows)
    chunk = F.floor(F.col("sec") / CHUNK_S)
    dealt = rows.withColumn("_chunk", F.explode(F.sequence(chunk, F.floor((F.col("sec") + longest - 1) / CHUNK_S))))
    order = Window.partitionBy(*keys, "_chunk").orderBy("sec")
    sums = [F.sum(v).over(order.rowsBetween(1 - w, 0)).alias(f"{v}{w}") for w in windows for v in values]
    return dealt.select(*rows.columns, "_chunk", *sums).where(F.col("_chunk") == chunk).drop("_chunk")


def rollup(rows: DataFrame) -> DataFrame:
    """scope, name, sec and 60 s sums of each service and of the whole system."""
    service = F.split_part("key", F.lit("."), F.lit(1))
    sums = [F.sum("tot60").alias("tot60"), F.sum("err60").alias("err60")]
    grouped = rows.withColumn("service", service).rollup("sec", "service").agg(*sums).where("sec IS NOT NULL")
    whole = F.col("service").isNull()
    return grouped.select(F.when(whole, "system").otherwise("service").alias("scope"), F.when(whole, "SYSTEM").otherwise(F.col("service")).alias("key"), "sec", "tot60", "err60")
