"""Detectors of shape: code mix, latency, silence, new codes, format drift."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logquill.functions import parse as p
from logquill.functions import stats as s
from logquill.operators import counting, windows
from logquill.operators.detectors import hysteresis
from logquill.sources import vocabulary as voc
from logquill.sources.tables import written

MIX_WINDOW, MIX_LINES, MIX_LIMIT, MIX_KEYS = 60, 50, 0.02, ("CLM.EDT",)
ADVANCED_BREACHES, ADVANCED_QUIET = 2, 30
LATENCY_LINES, LATENCY_FACTOR, WARMUP_S = 20, 2.0, 60
SILENT_S, SILENT_RATE = 30, 0.5
NEW_LINES, NEW_SHARE, NEW_WINDOW = 5, 0.01, 60
RATIO_WARNING, RATIO_HIGH = 0.005, 0.05


def code_mix(code_seconds: DataFrame, sums: DataFrame) -> DataFrame:
    """Of counts by key, code and second: key, sec, code, n60, p, q: share of each warning code in the component's warnings of the last
    minute, and in its catalogued mix. Components with one warning code have no mix."""
    catalog = voc.codes(sums.sparkSession).where("level = 'W' AND places > 1").select("key", "code", F.col("weight").alias("q"))
    counts = code_seconds.join(F.broadcast(catalog.select("key", "code")), ["key", "code"])
    grid = sums.select("key", "sec").join(F.broadcast(catalog), "key")
    dense = grid.join(counts, ["key", "code", "sec"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rolled = windows.sliding(dense, ("n",), (MIX_WINDOW,), ("key", "code"))
    whole = Window.partitionBy("key", "sec")
    return rolled.withColumn("all60", F.sum("n60").over(whole)).withColumn("p", F.when(F.col("all60") > 0, F.col("n60") / F.col("all60")).otherwise(0.0))


def mix_drift(mix: DataFrame, sums: DataFrame, limit: float = MIX_LIMIT) -> DataFrame:
    """key, sec, js, moved_code (largest change of share), moved_by, drifted."""
    delta = F.abs(F.col("p") - F.col("q"))
    lead = F.max(F.struct(F.round(delta, 9).alias("d"), "code"))
    by = mix.where("all60 > 0").groupBy("key", "sec").agg(F.sum(s.js_term(F.col("p"), F.col("q"))).alias("js"), lead.alias("lead"))
    joined = by.join(sums.select("key", "sec", "tot60"), ["key", "sec"]).where(F.col("tot60") >= MIX_LINES)
    return joined.select("key", "sec", F.round("js", 6).alias("js"), F.col("lead.code").alias("moved_code"), F.round("lead.d", 6).alias("moved_by"), (F.round("js", 6) > limit).alias("drifted"))


def percentiles(histogram: DataFrame, share: float = 0.95, keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """keys, lines, upper_ms and lower_ms: edges of the first bin up to which that share of lines lies.

    upper_ms leaves latencies out that can't be read, lower_ms has them in the last bin."""
    order = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    good = F.when(F.col("bin") <= p.LATENCY_BINS, F.col("n")).otherwise(0)
    rows = histogram.withColumn("_good", good)
    rows = rows.withColumns({"_upto": F.sum("n").over(order), "_all": F.sum("n").over(whole), "_good_upto": F.sum("_good").over(order), "_good_all": F.sum("_good").over(whole)})
    upper = F.min(F.when((F.col("_good_all") > 0) & (F.col("_good_upto") >= share * F.col("_good_all")), F.col("bin")))
    lower = F.min(F.when(F.col("_upto") >= share * F.col("_all"), F.col("bin")))
    found = rows.groupBy(*keys).agg(upper.alias("_u"), lower.alias("_l"), F.sum("n").alias("lines"))
    power = lambda b: F.pow(F.lit(2.0), b).cast("long")
    return found.select(*keys, "lines", power(F.col("_u")).alias("upper_ms"), F.when(F.col("_l") == 0, 0).otherwise(power(F.col("_l") - 1)).cast("long").alias("lower_ms"))


def sliding_p95(seconds: DataFrame, share: float = 0.95) -> DataFrame:
    """key, sec, lines, upper_ms: the upper edge of the bin of that share of the last minute's readable latencies, for each second up to the
    component's last line that has LATENCY_LINES lines in its minute, of seconds (key, bin, sec, n). An hour of a component, with a
    lead-in, is a group: a table of seconds by bins, whose running sums are subtracted from each other."""
    ends = seconds.groupBy("key").agg(F.max("sec").alias("last"))  # a row a component
    hour = F.floor(F.col("sec") / windows.CHUNK_S)
    dealt = seconds.withColumn("hour", F.explode(F.sequence(hour, F.floor((F.col("sec") + WARMUP_S - 1) / windows.CHUNK_S))))

    def slide(own: pa.Table) -> pa.Table:
        start = own["hour"][0].as_py() * windows.CHUNK_S - WARMUP_S
        counts = np.zeros((WARMUP_S + windows.CHUNK_S, p.BAD_LATENCY_BIN + 1), np.int64)
        np.add.at(counts, (own["sec"].to_numpy() - start, own["bin"].to_numpy()), own["n"].to_numpy())
        upto = np.cumsum(counts, axis=0)
        last = upto[WARMUP_S:] - upto[:-WARMUP_S]
        lines, good = last.sum(1), np.cumsum(last[:, : p.LATENCY_BINS + 1], axis=1)
        at = np.flatnonzero((lines >= LATENCY_LINES) & (np.arange(len(last)) + start + WARMUP_S <= own["last"][0].as_py()))
        edge = np.argmax(good[at] >= share * good[at, -1:], axis=1)
        upper = pa.array(2**edge, pa.int64(), mask=good[at, -1] == 0)
        return pa.table({"key": pa.array([own["key"][0].as_py()] * len(at), pa.string()), "sec": pa.array(at + start + WARMUP_S, pa.int64()), "lines": pa.array(lines[at], pa.int64()), "upper_ms": upper})

    joined = dealt.join(F.broadcast(ends), "key").select("key", "hour", "sec", F.col("bin").cast("long").alias("bin"), "n", "last")
    return joined.groupBy("key", "hour").applyInArrow(slide, "key string, sec long, lines long, upper_ms long")


def latency_shift(parsed: DataFrame, factor: float = LATENCY_FACTOR) -> DataFrame:
    """key, sec, lines, upper_ms, baseline_ms, shifted: p95 of the last minute at each second against that of the component's first
    whole minute with enough lines."""
    seconds = written(counting.latency_histogram(parsed.where("sec IS NOT NULL"), by_second=True), "latency-seconds")
    rows = written(sliding_p95(seconds), "latency-p95")
    first = seconds.groupBy("key").agg(F.min("sec").alias("_first"))
    warm = rows.join(F.broadcast(first), "key").where(F.col("sec") >= F.col("_first") + WARMUP_S - 1)
    usual = warm.groupBy("key").agg(F.min("sec").alias("_from"), F.min_by("upper_ms", "sec").alias("baseline_ms"))  # a row a component
    out = rows.join(F.broadcast(usual), "key").where(F.col("sec") >= F.col("_from"))
    return out.select("key", "sec", "lines", "upper_ms", "baseline_ms", (F.col("upper_ms") > factor * F.col("baseline_ms")).alias("shifted"))


def silence_runs(dense: DataFrame, least_s: int = SILENT_S) -> DataFrame:
    """key, first_sec, last_sec, seconds, silent: runs of seconds with less than SILENT_RATE lines a second over the last
    minute, of components that had more in their first minute. Only what came before a second is looked at."""
    first = dense.where("tot > 0").groupBy("key").agg(F.min("sec").alias("_first"))
    warm = dense.join(F.broadcast(first), "key").where(F.col("sec").between(F.col("_first"), F.col("_first") + WARMUP_S - 1))
    usual = warm.groupBy("key", "_first").agg((F.sum("tot") / WARMUP_S).alias("rate")).where(F.col("rate") > SILENT_RATE)  # a row a component
    low = windows.sliding(dense, ("tot",), (WARMUP_S,)).join(F.broadcast(usual), "key").where((F.col("sec") >= F.col("_first") + WARMUP_S) & (F.col(f"tot{WARMUP_S}") < SILENT_RATE * WARMUP_S))
    order = Window.partitionBy("key").orderBy("sec")
    runs = low.withColumn("_run", F.col("sec") - F.row_number().over(order)).groupBy("key", "_run").agg(F.min("sec").alias("first_sec"), F.max("sec").alias("last_sec"), F.count("*").alias("seconds"))
    return runs.select("key", "first_sec", "last_sec", "seconds", (F.col("seconds") >= least_s).alias("silent"))


def new_codes(code_seconds: DataFrame, per_second: DataFrame) -> DataFrame:
    """key, code, sec, n, lines, is_new: codes the catalog lacks, in the last minute of each second in which they are seen or were in the minute
    before it, the component's lines in that minute, and whether the code's are many enough to be told."""
    per_second = written(per_second, "line-seconds")
    known = voc.codes(per_second.sparkSession).select("code")
    seen = written(code_seconds.join(F.broadcast(known), "code", "left_anti").where("sec IS NOT NULL"), "unlisted-codes")
    by = ("key", "code")
    after = seen.select(*by, F.explode(F.sequence("sec", F.col("sec") + NEW_WINDOW - 1)).alias("sec")).distinct()
    rows = after.join(seen, [*by, "sec"], "left")
    # up to the component's last line: a second after it has no line left to come
    ends = per_second.groupBy("key").agg(F.max("sec").alias("_last"))  # a row a component
    rows = rows.join(F.broadcast(ends), "key").where(F.col("sec") <= F.col("_last")).select(*by, "sec", F.coalesce("n", F.lit(0)).alias("n"))
    hour = F.floor(F.col("sec") / windows.CHUNK_S)
    lead = lambda df: df.withColumn("_hour", F.explode(F.sequence(hour, F.floor((F.col("sec") + NEW_WINDOW - 1) / windows.CHUNK_S))))
    last = lambda *keys: Window.partitionBy(*keys, "_hour").orderBy("sec").rangeBetween(1 - NEW_WINDOW, 0)
    counts = lead(rows).withColumn("n60", F.sum("n").over(last(*by))).where(F.col("_hour") == hour).select(*by, "sec", F.col("n60").alias("n"))
    # the component's lines of those seconds: its counts and the seconds asked for, in one order
    both = per_second.select("key", "sec", "tot").unionByName(counts.select("key", "sec", F.lit(0).cast("long").alias("tot")).distinct())
    lines = lead(both).withColumn("lines", F.sum("tot").over(last("key"))).where(F.col("_hour") == hour).groupBy("key", "sec").agg(F.max("lines").alias("lines"))
    told = (F.col("n") >= NEW_LINES) & (F.col("n") >= NEW_SHARE * F.col("lines"))
    return counts.where("n > 0").join(lines, ["key", "sec"]).select(*by, "sec", "n", "lines", told.alias("is_new"))


def advanced_alerts(dense: DataFrame, mixed: DataFrame, shifts: DataFrame, new: DataFrame, silent: DataFrame) -> DataFrame:
    """key, rule, opened_sec of the openings of the four rules of shape, each with hysteresis of its own
    by component: dense has every second, the others what mix_drift, latency_shift, new_codes and
    silence_runs give."""
    of = lambda rows, rule: rows.select("key", F.lit(rule).alias("rule"), "sec")
    hits = (
        mixed.where("drifted").where(F.col("key").isin(*MIX_KEYS)).select("key", F.lit("mix").alias("rule"), "sec")
        .union(of(shifts.where("shifted"), "latency"))
        .union(of(new.where("is_new"), "new_code"))
        .union(silent.where("silent").select("key", F.lit("silence").alias("rule"), F.explode(F.sequence(F.col("first_sec") + SILENT_S - 1, "last_sec")).alias("sec")))
    )
    ruled = F.broadcast(hits.select("key", "rule").distinct())  # four rules of each component at most
    rows = dense.select("key", "sec").join(ruled, "key").join(hits.distinct().withColumn("hit", F.lit(True)), ["key", "rule", "sec"], "left")
    states = hysteresis(rows, F.col("hit"), F.lit(ADVANCED_BREACHES), ("key", "rule"), ADVANCED_QUIET)
    return states.where("opened_now").select("key", "rule", F.col("sec").alias("opened_sec"))


def unidentified_ratio(parsed: DataFrame, window: int = 60) -> DataFrame:
    """sec, lines and bad lines of the last minute, their ratio: lines with a readable time that can't be
    told to a component or code."""
    bad = F.col("class").isin("bad_level", "unknown_component", "unknown_code", "malformed_header", "oversized_line")
    seconds = parsed.where("sec IS NOT NULL").groupBy("sec").agg(F.count("*").alias("tot"), F.count_if(bad).alias("bad"))
    dense = windows.dense(written(seconds.withColumn("key", F.lit("")), "ratio-seconds"), ("tot", "bad"))
    rows = windows.sliding(dense, ("tot", "bad"), (window,))
    return rows.select("sec", F.col("tot60").alias("lines"), F.col("bad60").alias("bad"), F.round(s.rate(F.col("bad60"), F.col("tot60")), 6).alias("ratio"))


def format_drift(ratios: DataFrame) -> DataFrame:
    """The level that a ratio of unidentified lines means, for seconds that have one."""
    level = F.when(F.col("ratio") >= RATIO_HIGH, "HIGH").when(F.col("ratio") >= RATIO_WARNING, "WARNING")
    return ratios.withColumn("level", level).where("level IS NOT NULL").select("sec", "ratio", "level")
