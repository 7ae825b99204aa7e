"""Seasonal baselines from mergeable summaries, and a rule against them.

Values are counted by bins whose edges grow by a factor, so a group's summary has some 2,400 bins at most (from 1e-9 to 1e12), whatever the
number of its rows; summaries of parts of the data add up. A quantile read from it is off by ERROR at most, relative to itself; a deviation
from the median by ERROR times the value and the median."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAMMA = 1.02
ERROR = (GAMMA - 1) / (GAMMA + 1)
#: A value's bin if it isn't above zero; the robust z that is told, and the rows that a group needs.
NOTHING, Z_ROBUST, LEAST = -1_000_000, 3.5, 8
#: What makes a median absolute deviation comparable with a standard deviation.
NORMAL = 1.4826


def hour_of_week(ts: Column) -> Column:
    """From 0, Sunday at midnight."""
    return (F.dayofweek(ts) - 1) * 24 + F.hour(ts)


def middle(bin_: Column) -> Column:
    """The value that stands for a bin."""
    return F.when(bin_ == NOTHING, 0.0).otherwise(F.pow(F.lit(GAMMA), bin_) * 2 / (GAMMA + 1))


def summary(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, bin, n) of rows; null values are left out."""
    bin_ = F.when(F.col(value) > 0, F.ceil(F.log(F.col(value)) / F.log(F.lit(GAMMA)))).otherwise(NOTHING).cast("long")
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("n"))


def added(summaries: DataFrame, more: DataFrame, *keys: str) -> DataFrame:
    return summaries.unionByName(more).groupBy(*keys, "bin").agg(F.sum("n").alias("n"))


def _median(counts: DataFrame, at: str, *keys: str) -> DataFrame:
    """(keys, total, at) with the lower median of counts (keys, at, n)."""
    whole = Window.partitionBy(*keys)
    rows = counts.withColumns({"upto": F.sum("n").over(whole.orderBy(at)), "total": F.sum("n").over(whole)})
    return rows.where(F.col("upto") * 2 >= F.col("total")).groupBy(*keys, "total").agg(F.min(at).alias(at))


def baseline(summaries: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, median, mad) of summaries: median and median absolute deviation of each group."""
    counts = summaries.select(*keys, "n", middle(F.col("bin")).alias("median"))
    medians = _median(counts, "median", *keys)
    off = summaries.join(medians, list(keys)).select(*keys, "n", F.abs(middle(F.col("bin")) - F.col("median")).alias("mad"))
    return medians.join(_median(off, "mad", *keys).drop("total"), list(keys)).select(*keys, F.col("total").alias("n"), "median", "mad")


def seasonal_alerts(rows: DataFrame, value: str, usual: DataFrame, *keys: str, limit: float = Z_ROBUST, least: int = LEAST) -> DataFrame:
    """rows with n, median, mad and z of their group in usual (baseline), where the value is limit robust deviations above it or more. A group
    of less than `least` rows, or without any deviation, tells nothing."""
    z = (F.col(value) - F.col("median")) / (NORMAL * F.col("mad"))
    joined = rows.join(usual.where((F.col("n") >= least) & (F.col("mad") > 0)), list(keys))
    return joined.withColumn("z", z).where(F.col("z") >= limit)
