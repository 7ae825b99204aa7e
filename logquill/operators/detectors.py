"""Detectors over sliding sums with a seeded baseline, and the opening and closing of alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from logquill.functions import stats as s
from logquill.operators.windows import CHUNK_S
from logquill.sources import vocabulary as voc
from logquill.sources.tables import written

Z_FAST, Z_SLOW, MIN_DELTA, MIN_N = 6.0, 4.0, 0.01, 20
WILSON_KEYS, WILSON_RATE, WILSON_N = ("PAY.BNK",), 0.05, 5
CUSUM_SLACK, CUSUM_LIMIT = 0.5, 5.0
K_FAST, K_SLOW, QUIET = 2, 5, 30
ROLLUP_RATE, ROLLUP_N = 0.05, {"service": 80, "system": 400}


def with_least(sums: DataFrame) -> DataFrame:
    """sums with least: the lines that a window of the component needs for a z-score."""
    own = voc.thresholds(sums.sparkSession).select("key", F.col("min_n").alias("least"))
    return sums.join(F.broadcast(own), "key", "left").fillna({"least": MIN_N})


def with_baseline(sums: DataFrame) -> DataFrame:
    """sums with base, the vocabulary's error rate of the component, floored, and least."""
    base = voc.components(sums.sparkSession).select("key", F.greatest("err", F.lit(s.FLOOR)).alias("base"))
    return with_least(sums).join(F.broadcast(base), "key")


def z_rule(rows: DataFrame, window: int, limit: float) -> Column:
    tot, err, base = F.col(f"tot{window}"), F.col(f"err{window}"), F.col("base")
    z = s.binomial_z(err, tot, base)
    return (tot >= F.col("least")) & (z > limit) & (s.rate(err, tot) > base + MIN_DELTA) & (F.col("tot300") > 0)


def wilson_rule() -> Column:
    return F.col("key").isin(*WILSON_KEYS) & (F.col("tot30") >= WILSON_N) & (s.wilson_lower(F.col("err30"), F.col("tot30")) > WILSON_RATE)


def with_thresholds(rows: DataFrame) -> DataFrame:
    """limit_rate, window_s, min_n of each row's key, and its sums over that window (t_tot, t_err)."""
    limits = F.broadcast(voc.thresholds(rows.sparkSession))
    rate, window, least = voc.DEFAULT_THRESHOLD
    joined = rows.join(limits, "key", "left").fillna({"limit_rate": rate, "window_s": window, "min_n": least})
    pick = lambda v: F.when(F.col("window_s") == 30, F.col(f"{v}30")).when(F.col("window_s") == 60, F.col(f"{v}60")).otherwise(F.col(f"{v}10"))
    return joined.withColumns({"t_tot": pick("tot"), "t_err": pick("err")})


def threshold_rule() -> Column:
    return (F.col("t_tot") >= F.col("min_n")) & (s.rate(F.col("t_err"), F.col("t_tot")) > F.col("limit_rate"))


def _hour() -> Column:
    return F.floor(F.col("sec") / CHUNK_S)


def _upto(*by: str, order: str = "sec") -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def _before(value: Column, keys: tuple[str, ...]) -> Column:
    """value of a key's hour before, of a table with a row for each key and hour."""
    return F.lag(value).over(Window.partitionBy(*keys).orderBy("_hour"))


def cusum(rows: DataFrame, slack: float = CUSUM_SLACK, sigma: float = s.FLOOR) -> DataFrame:
    """rows with cusum, the sum of excess over base kept above zero; low volume starts it anew.

    After an hour it is max(S + c, c - m) of what it was before, S, with c the hour's plain sum and m the least
    running sum; an hour with low volume forgets S. These pairs compose, so hours are summed apart from each other, S of each hour
    comes from the table of hours, and is put in where no low volume came yet."""
    low = F.col("tot60") < MIN_N
    step = F.when(low, 0.0).otherwise(s.rate(F.col("err60"), F.col("tot60")) - F.col("base") - slack * sigma)
    cut = rows.withColumns({"_hour": _hour(), "_step": step, "_low": low.cast("int")}).withColumn("_part", F.sum("_low").over(_upto("key", "_hour")))
    inside = _upto("key", "_hour", "_part")
    summed = written(cut.withColumn("_c", F.sum("_step").over(inside)).withColumn("_m", F.min("_c").over(inside)).drop("_step", "_low"), "cusum")
    hours = summed.groupBy("key", "_hour").agg(F.max_by(F.struct("_part", "_c", "_m"), "sec").alias("x"))
    anew = F.col("x._part") > 0
    hours = hours.select("key", "_hour", F.when(anew, 0.0).otherwise(F.col("x._c")).alias("a"), (F.col("x._c") - F.when(anew, F.least(F.lit(0.0), "x._m")).otherwise(F.col("x._m"))).alias("b"), anew.cast("int").alias("anew"))
    hours = hours.withColumn("seg", F.sum("anew").over(_upto("key", order="_hour"))).withColumn("A", F.sum("a").over(_upto("key", "seg", order="_hour")))
    after = F.col("A") + F.greatest(F.lit(0.0), F.max(F.col("b") - F.col("A")).over(_upto("key", "seg", order="_hour")))
    carried = hours.withColumn("_s", after).select("key", "_hour", F.coalesce(_before(F.col("_s"), ("key",)), F.lit(0.0)).alias("_s"))
    own = F.when(F.col("_part") == 0, F.greatest(F.col("_s") + F.col("_c"), F.col("_c") - F.col("_m"))).otherwise(F.col("_c") - F.least(F.lit(0.0), "_m"))
    return summed.join(carried, ["key", "_hour"]).withColumn("cusum", own).drop("_hour", "_part", "_c", "_m", "_s")


def rules(sums: DataFrame) -> DataFrame:
    """sums with base, z by window, cusum, and rule, the first that breaches of fast, slow, Wilson
    (told as threshold), threshold, cusum; null without a breach."""
    rows = cusum(with_thresholds(with_baseline(sums)))
    z = {f"z{w}": s.binomial_z(F.col(f"err{w}"), F.col(f"tot{w}"), F.col("base")) for w in (10, 60)}
    rows = rows.withColumns(z)
    rule = (
        F.when(z_rule(rows, 10, Z_FAST), "fast").when(z_rule(rows, 60, Z_SLOW), "slow").when(wilson_rule(), "wilson")
        .when(threshold_rule(), "threshold").when(F.col("cusum") > CUSUM_LIMIT, "cusum")
    )
    return rows.withColumn("rule", rule)


def hysteresis(rows: DataFrame, breach: Column, needed: Column, keys: tuple[str, ...] = ("key",), quiet: int = QUIET) -> DataFrame:
    """rows with breach_run, segment, open and opened_now.

    An alert opens on the `needed`-th breaching second in a row and ends on the first second after
    `quiet` quiet ones; segments are cut there. No window spans more than an hour of a key: what an hour needs from those
    before it are the places of the last breaching and the last quiet second, then the number of cuts, and of openings
    since the last one, which tables with a row for each key and hour carry on."""
    hour, own = (*keys, "_hour"), lambda x: F.when(x, F.col("_r"))
    rows = rows.withColumns({"_hour": _hour(), "_hit": F.coalesce(breach, F.lit(False)), "_need": needed})
    rows = written(rows.withColumn("_r", F.row_number().over(Window.partitionBy(*hour).orderBy("sec")).cast("long")), "hysteresis")
    ends = rows.groupBy(*hour).agg(F.count("*").alias("n"), F.max(own(F.col("_hit"))).alias("hit"), F.max(own(~F.col("_hit"))).alias("calm"))
    ends = ends.withColumn("_start", F.sum("n").over(_upto(*keys, order="_hour")) - F.col("n"))
    ends = ends.withColumns({"_last_hit": F.max(F.col("_start") + F.col("hit")).over(_upto(*keys, order="_hour")), "_last_calm": F.max(F.col("_start") + F.col("calm")).over(_upto(*keys, order="_hour"))})
    ends = ends.select(*hour, "_start", *(F.coalesce(_before(F.col(c), keys), F.lit(0)).alias(c) for c in ("_last_hit", "_last_calm")))
    place = F.col("_start") + F.col("_r")
    since = lambda x, carried: place - F.greatest(F.coalesce(F.max(F.when(x, place)).over(_upto(*hour)), F.lit(0)), carried)
    rows = rows.join(ends, list(hour)).withColumns({"breach_run": since(~F.col("_hit"), "_last_calm"), "_quiet_run": since(F.col("_hit"), "_last_hit")})
    rows = rows.withColumn("_ready", (F.col("_hit") & (F.col("breach_run") >= F.col("_need"))).cast("int")).withColumn("_cut", (F.col("_quiet_run") == quiet + 1).cast("int"))
    rows = rows.withColumn("_cuts", F.sum("_cut").over(_upto(*hour))).withColumn("_opened", F.sum("_ready").over(_upto(*hour, "_cuts")))
    told = rows.groupBy(*hour).agg(F.max_by(F.struct("_cuts", "_opened"), "sec").alias("x"))
    told = told.withColumns({"_cuts_before": F.sum("x._cuts").over(_upto(*keys, order="_hour")), "_seg": F.sum((F.col("x._cuts") > 0).cast("int")).over(_upto(*keys, order="_hour"))})
    told = told.withColumn("_opened_before", F.sum("x._opened").over(_upto(*keys, "_seg", order="_hour")))
    told = told.select(*hour, *(F.coalesce(_before(F.col(c), keys), F.lit(0)).alias(c) for c in ("_cuts_before", "_opened_before")))
    rows = rows.join(told, list(hour)).withColumn("segment", F.col("_cuts_before") + F.col("_cuts"))
    opened = F.col("_opened") + F.when(F.col("_cuts") == 0, F.col("_opened_before")).otherwise(0)
    rows = rows.withColumns({"open": opened > 0, "opened_now": (F.col("_ready") == 1) & (opened == 1)})
    return rows.drop("_hour", "_hit", "_need", "_r", "_start", "_last_hit", "_last_calm", "_quiet_run", "_ready", "_cut", "_cuts", "_opened", "_cuts_before", "_opened_before")


def needed_seconds(rule: Column) -> Column:
    return F.when(rule.isin("slow", "cusum"), K_SLOW).otherwise(K_FAST)


def alert_states(sums: DataFrame) -> DataFrame:
    rows = rules(sums)
    return hysteresis(rows, F.col("rule").isNotNull(), needed_seconds(F.col("rule")))


def open_intervals(states: DataFrame) -> DataFrame:
    """key, segment, first and last second of each open alert, seconds and greatest 10 s z."""
    last = F.max(F.when(F.col("rule").isNotNull(), F.col("sec")))
    return states.where("open").groupBy("key", "segment").agg(F.min("sec").alias("opened_sec"), last.alias("last_breach_sec"), F.count("*").alias("open_seconds"), F.max("z10").alias("peak_z"))


def alerts(states: DataFrame) -> DataFrame:
    """One row per opening: key, rule, opened_sec, window_s, total, errors, observed, baseline, z, with
    the window of the rule that opened it."""
    rule = F.col("rule")
    pick = lambda v: F.when(rule == "fast", F.col(f"{v}10")).when(rule == "wilson", F.col(f"{v}30")).when(rule == "threshold", F.col(f"t_{v}")).otherwise(F.col(f"{v}60"))
    window = F.when(rule == "fast", 10).when(rule == "wilson", 30).when(rule == "threshold", F.col("window_s")).otherwise(60)
    rows = states.where("opened_now").select("key", "rule", F.col("sec").alias("opened_sec"), window.cast("int").alias("window_s"), pick("tot").alias("total"), pick("err").alias("errors"), F.col("base").alias("baseline"))
    told = rows.withColumn("rule", F.when(rule == "wilson", "threshold").otherwise(rule))
    return told.withColumns({"observed": s.rate(F.col("errors"), F.col("total")), "z": s.binomial_z(F.col("errors"), F.col("total"), F.col("baseline"))})


def rollup_alerts(rolled: DataFrame) -> DataFrame:
    """Openings of service and system alerts."""
    least = F.when(F.col("scope") == "service", ROLLUP_N["service"]).otherwise(ROLLUP_N["system"])
    breach = (F.col("tot60") >= least) & (s.rate(F.col("err60"), F.col("tot60")) > ROLLUP_RATE)
    states = hysteresis(rolled, breach, F.lit(K_SLOW), ("scope", "key"))
    return states.where("opened_now").select("scope", "key", F.col("sec").alias("opened_sec"), "tot60", "err60", s.rate(F.col("err60"), F.col("tot60")).alias("observed"))
