"""Reports: the state of components and of the parser, routes and counts of alerts, recent rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logquill.functions import stats as s
from logquill.operators import windows
from logquill.operators.parse import rejected
from logquill.operators.severity import LEVELS, criticality
from logquill.sources import vocabulary as voc

LAST, PREVIEW = 1000, 120
#: Where alerts of a level go.
ROUTES = (("CRITICAL", "sms"), ("HIGH", "email"), ("WARNING", "email"), ("INFO", "none"))


def component_table(learned: DataFrame) -> DataFrame:
    """Rates, baseline, z and state of each component in the last second of learned states."""
    last = learned.agg(F.max("sec").alias("sec"))
    rows = learned.join(F.broadcast(last), "sec").join(F.broadcast(criticality(learned.sparkSession)), "key")  # one row; a row for each component
    return rows.select(
        "key", *(F.round(s.rate(F.col(f"err{w}"), F.col(f"tot{w}")), 5).alias(f"rate_{w}s") for w in (10, 60)), F.round("base", 5).alias("baseline"),
        F.round("z10", 2).alias("z"), F.when(F.col("open"), "open").otherwise("ok").alias("state"), (~F.col("warming")).alias("warm"), "criticality",
    )


def open_components(learned: DataFrame) -> DataFrame:
    """sec, n_open, keys: which components have an open alert, for seconds with any."""
    rows = learned.where("open").groupBy("sec").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    return rows.select("sec", F.size("keys").cast("long").alias("n_open"), F.array_join("keys", ",").alias("keys"))


def alerts_since(alerts: DataFrame, since_sec: int) -> DataFrame:
    return alerts.where(F.col("opened_sec") > since_sec)


def last_alerts(alerts: DataFrame, n: int = LAST) -> DataFrame:
    return alerts.orderBy(F.desc("opened_sec"), "key", "rule").limit(n)


def last_seconds(dense: DataFrame, n: int = 60) -> DataFrame:
    """The last n seconds of every component, those without lines as zeros."""
    return dense.join(F.broadcast(dense.agg(F.max("sec").alias("last"))), F.col("sec") > F.col("last") - n).drop("last")


def rolling_rate(counts: DataFrame, window_s: int = 60) -> DataFrame:
    """key, sec, total, rate: sum of a component's samples (seconds with lines) of the last window and
    its share of the time between the first and last of them, one second at least. Hours of time are
    dealt out with a lead-in."""
    chunk = F.floor(F.col("sec") / windows.CHUNK_S)
    dealt = counts.withColumn("_chunk", F.explode(F.sequence(chunk, F.floor((F.col("sec") + window_s) / windows.CHUNK_S))))
    own = Window.partitionBy("key", "_chunk").orderBy("sec").rangeBetween(-window_s, 0)
    rows = dealt.select("key", "sec", "_chunk", F.sum("tot").over(own).alias("total"), F.min("sec").over(own).alias("_first"))
    return rows.where(F.col("_chunk") == chunk).select("key", "sec", "total", (F.col("total") / F.greatest(F.col("sec") - F.col("_first"), F.lit(1))).alias("rate"))


def severity_counts(scored: DataFrame) -> DataFrame:
    """metric (AlertCount_LEVEL), n for every level."""
    names = scored.sparkSession.createDataFrame([(x,) for x in LEVELS], "severity string")
    counts = scored.groupBy("severity").agg(F.count("*").alias("n"))
    return names.join(counts, "severity", "left").select(F.concat(F.lit("AlertCount_"), "severity").alias("metric"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def routed(scored: DataFrame, routes: tuple[tuple[str, str], ...] = ROUTES) -> DataFrame:
    """scored alerts with route, by severity."""
    table = scored.sparkSession.createDataFrame(list(routes), "severity string, route string")
    return scored.join(F.broadcast(table), "severity")


def neighbours(alerts: DataFrame) -> DataFrame:
    """key, n (alerts), upstream and downstream: the components one hop away."""
    edges = voc.edges(alerts.sparkSession)
    side = lambda of, other, name: edges.groupBy(F.col(of).alias("key")).agg(F.array_join(F.array_sort(F.collect_set(other)), ",").alias(name))
    rows = alerts.groupBy("key").agg(F.count("*").alias("n")).join(F.broadcast(side("dst", "src", "upstream")), "key", "left")
    return rows.join(F.broadcast(side("src", "dst", "downstream")), "key", "left").fillna("", ["upstream", "downstream"])


def sample_summaries(parsed: DataFrame) -> DataFrame:
    """event_id, class, n_bytes, preview of each line that can't be told to a component."""
    return rejected(parsed).select("event_id", "class", F.octet_length("value").alias("n_bytes"), F.substring("value", 1, PREVIEW).alias("preview"))


def parser_health(parsed: DataFrame, ratios: DataFrame) -> DataFrame:
    """One row: lines, valid ones, unknown components, and the ratio of unidentified lines in the last
    minute."""
    totals = parsed.agg(
        F.count("*").alias("lines"), F.count_if(F.col("class") == "valid").alias("valid"),
        F.count_distinct(F.when(F.col("class") == "unknown_component", F.col("key"))).alias("unknown_keys"),
    )
    return totals.crossJoin(ratios.agg(F.max_by("ratio", "sec").alias("ratio_60s")))  # one row each


def routed_lines(reasons: DataFrame) -> DataFrame:
    """reason, class, n: rejected lines counted by the cheap reason, all as malformed headers."""
    return reasons.select("reason", F.lit("malformed_header").alias("class"), "n")
