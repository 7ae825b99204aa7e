"""Severity of alerts, and the words that explain it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquill.functions import stats as s
from logquill.operators.folds import fold_by_hour
from logquill.operators.windows import CHUNK_S
from logquill.sources import vocabulary as voc

CUTOFF_MIN, HOLD_S = 60.0, 15
LEVELS = ("INFO", "WARNING", "HIGH", "CRITICAL")


def criticality(spark) -> DataFrame:
    """key and criticality of each component; of each service and the system the largest of their
    members'."""
    parts = voc.components(spark).select("key", "service", "criticality")
    whole = parts.rollup("service").agg(F.max("criticality").alias("criticality")).select(F.coalesce("service", F.lit("SYSTEM")).alias("key"), "criticality")
    return parts.select("key", "criticality").union(whole)


def scored(alerts: DataFrame, minutes_to_cutoff: float | None = None) -> DataFrame:
    """alerts with criticality, burn_rate, score, severity. seconds_in_breach may be a column."""
    rows = alerts.join(F.broadcast(criticality(alerts.sparkSession)), "key", "left").fillna({"criticality": 0.5})
    seconds = F.col("seconds_in_breach") if "seconds_in_breach" in alerts.columns else F.lit(0)
    burn = s.burn_rate(F.col("observed"))
    cycle = s.cycle_score(F.lit(minutes_to_cutoff).cast("double"), CUTOFF_MIN)
    score = s.severity_score(s.deviation_score(F.col("z"), F.col("observed"), F.col("baseline")), s.duration_score(seconds), F.col("criticality"), burn, cycle)
    return rows.withColumns({"burn_rate": burn, "score": F.round(score, 6)}).withColumn("severity", s.severity_level(F.col("score")))


def reasons(alerts: DataFrame) -> DataFrame:
    """alerts with reason, the parts joined by semicolons."""
    times = F.round(F.col("observed") / F.col("baseline"), 0).cast("long").cast("string")
    percent = lambda c: F.format_string("%.1f%%", F.round(F.col(c) * 100, 1))
    told = F.concat_ws(
        "; ",
        F.when(F.col("z") > 0, F.format_string("z=%.1f over %ds", F.round("z", 1), F.col("window_s"))),
        F.concat(F.col("key"), F.lit(" error rate "), percent("observed"), F.lit(" vs baseline "), percent("baseline"), F.lit(" ("), times, F.lit("x)")),
    )
    return alerts.withColumn("reason", told)


def breaches(states: DataFrame) -> DataFrame:
    """key, rule, opened_sec, window_s, seconds_in_breach, z, observed, baseline of each open stretch of
    alert states, at its last breaching second: with the peaks of z and of the rate up to then."""
    rate10 = s.rate(F.col("err10"), F.col("tot10"))
    breach = F.col("rule").isNotNull()
    rows = states.where("open").groupBy("key", "segment").agg(
        F.min("sec").alias("opened_sec"), F.max(F.when(breach, F.col("sec"))).alias("last_sec"), F.min_by("rule", F.when(breach, F.col("sec"))).alias("rule"),
        F.max("z10").alias("z"), F.max(rate10).alias("observed"), F.max("base").alias("baseline"),
    )
    return rows.select("key", "rule", "opened_sec", F.lit(10).alias("window_s"), (F.col("last_sec") - F.col("opened_sec")).alias("seconds_in_breach"), "z", "observed", "baseline")


def explained(scored: DataFrame, page: float = 14.4, ticket: float = 6.0) -> DataFrame:
    """scored alerts (with seconds_in_breach) with reason, all parts that apply joined by semicolons."""
    percent = lambda c: F.format_string("%.1f%%", F.round(F.col(c) * 100, 1))
    burn = F.format_string("burn rate %.1fx: ", F.round("burn_rate", 1))
    told = F.concat_ws(
        "; ",
        F.when(F.col("z") > 0, F.format_string("z=%.1f over %ds", F.round("z", 1), F.col("window_s"))),
        F.concat(F.col("key"), F.lit(" error rate "), percent("observed"), F.lit(" vs baseline "), percent("baseline")),
        F.when(F.col("seconds_in_breach") > 0, F.concat(F.lit("breaching for "), F.col("seconds_in_breach").cast("string"), F.lit("s"))),
        F.when(F.col("criticality") >= 0.9, "payments depend on this component"),
        F.when(F.col("burn_rate") >= page, F.concat(burn, F.lit("page"))).when(F.col("burn_rate") >= ticket, F.concat(burn, F.lit("ticket"))),
        F.when(F.col("rule") == "cusum", "rates have been too high for long"),
        F.concat(F.format_string("score %.2f -> ", F.round("score", 2)), F.col("severity")),
    )
    return scored.withColumn("reason", told)


def hold_levels(proposed: DataFrame, hold_s: int = HOLD_S, hour_s: int = CHUNK_S) -> DataFrame:
    """proposed (key, sec, severity) with held: a level rises at once and falls after hold_s seconds
    in a row below it. Hours are folded apart, first as if nothing came before them."""

    def fold(own: pa.Table, state: dict) -> tuple[pa.Table, dict]:
        level, below, held = state["level"], state["below"], []
        for name in own["severity"].to_pylist():
            rank = LEVELS.index(name)
            below = below + 1 if rank < level else 0
            if rank > level or below >= hold_s:
                level, below = rank, 0
            held.append(LEVELS[level])
        return own.select(["key", "sec", "severity"]).append_column("held", pa.array(held, pa.string())), {"level": level, "below": below}

    guess = lambda rows: rows.select("key", "_hour").distinct().withColumns({"level": F.lit(-1).cast("long"), "below": F.lit(0).cast("long")})
    rows = proposed.select("key", "sec", "severity")
    return fold_by_hour(rows, guess, fold, "level long, below long", "key string, sec long, severity string, held string", hour_s)
