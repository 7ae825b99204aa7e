"""Counts over parsed lines. All are hash aggregates with partial sums before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logquill.functions import parse as p
from logquill.operators.parse import counted, rejected
from logquill.sources import vocabulary as voc

ADOPT_CHUNK_S = 3600
ADOPT_WINDOW_S, ADOPT_LINES, KEY_CAP, SAMPLES = 30, 20, 1000, 3
OVERFLOW, HOUR_S = "<overflow>", 3600


def _level_counts() -> list:
    level = F.col("level_class")
    return [F.count("*").alias("tot"), F.count_if(level.between(2, 3)).alias("err"), F.count_if(level == 1).alias("warn")]


def per_second(parsed: DataFrame) -> DataFrame:
    """key, sec, tot, err, warn."""
    return counted(parsed).groupBy("key", "sec").agg(*_level_counts())


def line_classes(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("class").agg(F.count("*").alias("n"))


def reject_reasons(lines: DataFrame) -> DataFrame:
    """reason, n of lines that can't be read."""
    cut = lines.select(F.octet_length("value").alias("n"), p.header(F.col("value").cast("binary")).alias("head"))
    reason = cut.select(p.quick_reason(F.col("n"), F.col("head")).alias("reason"))
    return reason.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def unknown_components(parsed: DataFrame) -> DataFrame:
    """key, n of well-formed lines whose component the vocabulary lacks (an anti join)."""
    known = voc.components(parsed.sparkSession).select("key")
    whole = parsed.where(F.col("raw_len").between(p.HEADER, p.LONGEST) & F.col("ts_ms").isNotNull() & (F.col("level_class") <= 3) & ~F.array_contains("flags", "malformed_header"))
    return whole.join(F.broadcast(known), "key", "left_anti").groupBy("key").agg(F.count("*").alias("n"))


def known_codes(parsed: DataFrame) -> DataFrame:
    """key, code, n of counted lines with a catalogued code (a semi join)."""
    known = voc.codes(parsed.sparkSession).select("code")
    return counted(parsed).join(F.broadcast(known), "code", "left_semi").groupBy("key", "code").agg(F.count("*").alias("n"))


def unmapped_codes(parsed: DataFrame) -> DataFrame:
    known = voc.codes(parsed.sparkSession).select("code")
    failed = counted(parsed).where(F.col("code") != voc.SUCCESS)
    return failed.join(F.broadcast(known), "code", "left_anti").groupBy("code").agg(F.count("*").alias("n"))


def component_counts(parsed: DataFrame) -> DataFrame:
    """Totals of each component with the counts of its codes (a map told as code=n, sorted)."""
    lines = counted(parsed)
    level = F.col("level_class")
    read = F.col("latency_ms") >= 0
    each = lines.groupBy("key", "code").agg(
        *_level_counts(), F.count_if(level == 0).alias("info"),
        F.count_if((F.col("class") == "unknown_code") & (level >= 2)).alias("unmapped_err"),
        F.sum(F.when(read, F.col("latency_ms").cast("long")).otherwise(0)).alias("latency_sum"), F.count_if(read).alias("latency_n"),
        F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec"),
    )
    ends = {"first_sec": F.min("first_sec"), "last_sec": F.max("last_sec")}
    told = F.when(F.col("code") != voc.SUCCESS, F.concat_ws("=", "code", F.col("tot").cast("string")))
    return each.groupBy("key").agg(*(ends.get(c, F.sum(c)).alias(c) for c in each.columns[2:]), F.array_join(F.array_sort(F.collect_list(told)), ",").alias("by_code"))


def code_counts(parsed: DataFrame, by_second: bool = False) -> DataFrame:
    """n of failing lines by component and code, and by second if asked."""
    keys = ["key", "code", *(["sec"] if by_second else [])]
    return counted(parsed).where(F.col("code") != voc.SUCCESS).groupBy(*keys).agg(F.count("*").alias("n"))


def latency_histogram(parsed: DataFrame, by_second: bool = False) -> DataFrame:
    """n of lines by component and latency bin, and by second if asked."""
    keys = ["key", "bin", *(["sec"] if by_second else [])]
    return counted(parsed).withColumn("bin", p.latency_bin(F.col("latency_ms"))).groupBy(*keys).agg(F.count("*").alias("n"))


def median_second(by_second: DataFrame) -> DataFrame:
    """median_sec, the upper median of the seconds of by_second (sec, n), in two steps: the hour it lies
    in from a row for each hour, then the second from that hour's rows."""
    hours = by_second.groupBy((F.floor(F.col("sec") / HOUR_S) * HOUR_S).alias("hour")).agg(F.sum("n").alias("n"))
    running = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)  # a row for each hour
    placed = hours.withColumns({"upto": F.sum("n").over(running), "half": F.floor(F.sum("n").over(Window.partitionBy()) / 2)})
    held = placed.where((F.col("upto") > F.col("half")) & (F.col("upto") - F.col("n") <= F.col("half"))).select("hour", (F.col("half") - F.col("upto") + F.col("n")).alias("left"))
    inside = by_second.join(F.broadcast(held), (F.col("sec") >= F.col("hour")) & (F.col("sec") < F.col("hour") + HOUR_S))  # one row
    upto = F.sum("n").over(Window.orderBy("sec").rowsBetween(Window.unboundedPreceding, 0))  # of one hour
    return inside.withColumn("upto", upto).where(F.col("upto") > F.col("left")).agg(F.min("sec").alias("median_sec"))


def skew_filter(parsed: DataFrame, bound_s: int = 300) -> DataFrame:
    """median_sec (upper median of event seconds), kept and dropped lines within bound_s of it."""
    by_second = parsed.where("sec IS NOT NULL").groupBy("sec").agg(F.count("*").alias("n"))
    rows = by_second.crossJoin(F.broadcast(median_second(by_second)))  # one row
    near = F.abs(F.col("sec") - F.col("median_sec")) <= bound_s
    return rows.groupBy("median_sec").agg(F.sum(F.when(near, F.col("n")).otherwise(0)).alias("kept"), F.sum(F.when(near, 0).otherwise(F.col("n"))).alias("dropped"))


def without_skew(parsed: DataFrame, bound_s: int = 300) -> DataFrame:
    """The lines of parsed whose second lies within bound_s of the median one."""
    seconds = parsed.where("sec IS NOT NULL").groupBy("sec").agg(F.count("*").alias("n"))
    near = F.abs(F.col("sec") - F.col("median_sec")) <= bound_s
    return parsed.join(F.broadcast(median_second(seconds)), near).drop("median_sec")


def unknown_keys(parsed: DataFrame, cap: int | None = None) -> DataFrame:
    """key, n, first and last timestamp and the first SAMPLES lines, cut to 200 bytes, of unknown
    components. With a cap, keys beyond the cap largest are summed as one."""
    line = F.decode(F.substring(F.col("value").cast("binary"), 1, 200), "UTF-8").alias("line")
    lines = rejected(parsed).where("class = 'unknown_component'").select("key", "ts_ms", line)
    stats = lines.groupBy("key").agg(F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("ts_ms", "line"))
    first = lines.withColumn("place", place).where(F.col("place") <= SAMPLES).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ts_ms", "line"))).alias("first"))
    rows = stats.join(first, "key").select("key", "n", "first_ms", "last_ms", F.array_join("first.line", " / ").alias("samples"))
    if cap is None:
        return rows
    top = F.broadcast(stats.orderBy(F.desc("n"), "key").limit(cap).select("key", F.lit(True).alias("top")))
    named = rows.join(top, "key", "left").withColumn("key", F.when(F.col("top"), F.col("key")).otherwise(OVERFLOW))
    return named.groupBy("key").agg(F.sum("n").alias("n"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), F.min_by("samples", "first_ms").alias("samples"))


def top_unknown_keys(parsed: DataFrame, limit: int = 10) -> DataFrame:
    return unknown_keys(parsed, KEY_CAP).orderBy(F.col("key") == OVERFLOW, F.desc("n"), "key").limit(limit)


def adopt_candidates(parsed: DataFrame, window_s: int = ADOPT_WINDOW_S, least: int = ADOPT_LINES) -> DataFrame:
    """key, adopted_sec, n, first_ms, last_ms: unknown components with at least so many lines in window_s seconds, whichever,
    and the first second in which that was so."""
    lines = rejected(parsed).where("class = 'unknown_component' AND sec IS NOT NULL")
    seconds = lines.groupBy("key", "sec").agg(F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))
    # by hour with a lead-in, so that no key's history is one task
    hour = F.floor(F.col("sec") / ADOPT_CHUNK_S)
    dealt = seconds.withColumn("_hour", F.explode(F.sequence(hour, F.floor((F.col("sec") + window_s - 1) / ADOPT_CHUNK_S))))
    last = Window.partitionBy("key", "_hour").orderBy("sec").rangeBetween(1 - window_s, 0)
    told = dealt.select("key", "sec", "_hour", F.sum("n").over(last).alias("n"), F.min("first_ms").over(last).alias("first_ms"), F.max("last_ms").over(last).alias("last_ms"))
    first = told.where((F.col("_hour") == hour) & (F.col("n") >= least)).groupBy("key").agg(F.min_by(F.struct("sec", "n", "first_ms", "last_ms"), "sec").alias("x"))
    return first.select("key", F.col("x.sec").alias("adopted_sec"), "x.n", "x.first_ms", "x.last_ms")


def trace_fanout(parsed: DataFrame, digits: int = 8) -> DataFrame:
    """trace_group, lines, components: how many components the lines of a trace (or of traces with
    the same first digits) touch."""
    group = F.substring("trace", 1, digits).alias("trace_group")
    keys = F.array_sort(F.collect_set("key"))
    return counted(parsed).groupBy(group).agg(F.count("*").alias("lines"), F.size(keys).cast("long").alias("components"), F.array_join(keys, ",").alias("keys"))
