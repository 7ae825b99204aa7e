"""Grouping of alerts: dependency closure, suspected origins, incidents, cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquill.operators.severity import LEVELS
from logquill.operators.windows import CHUNK_S
from logquill.sources import vocabulary as voc
from logquill.sources.tables import written

DEDUPE_S, GROUPING_S, IDLE_S, COOLDOWN_S = 60, 120, 120, 300


def closure(spark) -> DataFrame:
    """src, dst, depth (fewest hops): which component can affect which. Over the fixed, small graph."""
    return spark.sql(
        """
        WITH RECURSIVE walk(src, dst, depth) AS (
            SELECT src, dst, 1 FROM {edges}
            UNION ALL
            SELECT w.src, e.dst, w.depth + 1 FROM walk w JOIN {edges} e ON w.dst = e.src WHERE w.depth < 8
        ) SELECT src, dst, min(depth) AS depth FROM walk GROUP BY src, dst
        """,
        edges=voc.edges(spark),
    )


def suspected_origins(alerts: DataFrame, window_s: int = GROUPING_S) -> DataFrame:
    """key, rule, opened_sec, origin, origin_sec: the earliest alert of the component or of what it
    depends on, in the window up to the alert; itself if none is earlier."""
    up = closure(alerts.sparkSession).select(F.col("src").alias("origin"), F.col("dst").alias("key"))
    # only alerts of the same and the previous stretch of time meet
    bucket = lambda c: F.floor(F.col(c) / window_s)
    others = alerts.select(F.col("key").alias("origin"), F.col("opened_sec").alias("origin_sec"), F.explode(F.array(bucket("opened_sec"), bucket("opened_sec") + 1)).alias("bucket"))
    pairs = alerts.select("key", "rule", "opened_sec", bucket("opened_sec").alias("bucket")).join(F.broadcast(up), "key").join(others, ["origin", "bucket"])
    near = pairs.where((F.col("origin_sec") < F.col("opened_sec")) & (F.col("origin_sec") >= F.col("opened_sec") - window_s))
    own = alerts.select(F.col("key").alias("origin"), "key", "rule", "opened_sec", F.col("opened_sec").alias("origin_sec"))
    rows = near.select(own.columns).unionByName(own)
    first = F.min(F.struct("origin_sec", "origin")).alias("first")
    return rows.groupBy("key", "rule", "opened_sec").agg(first).select("key", "rule", "opened_sec", F.col("first.origin").alias("origin"), F.col("first.origin_sec").alias("origin_sec"))


def downstream_chains(origins: DataFrame) -> DataFrame:
    """origin, n (alerts) and chain: the origin and all it can affect, nearest first."""
    reach = closure(origins.sparkSession).groupBy(F.col("src").alias("origin")).agg(F.array_sort(F.collect_list(F.struct("depth", "dst"))).alias("far"))
    names = origins.groupBy("origin").agg(F.count("*").alias("n"))
    joined = names.join(F.broadcast(reach), "origin", "left")
    chain = F.concat_ws(">", F.col("origin"), F.array_join(F.transform(F.coalesce("far", F.array().cast("array<struct<depth:int,dst:string>>")), lambda x: x["dst"]), ">"))
    return joined.select("origin", "n", F.rtrim(chain, F.lit(">")).alias("chain"))


def incident_sessions(alerts: DataFrame) -> DataFrame:
    """key, rule, incident (number in its key and rule), opened_sec, last_sec, n of incidents.

    An alert joins its predecessor's incident within DEDUPE_S seconds; after IDLE_S the incident is
    resolved, and an alert in the cooldown that follows reopens it; any other starts a new one."""
    order = Window.partitionBy("key", "rule").orderBy("opened_sec")
    gap = F.col("opened_sec") - F.lag("opened_sec").over(order)
    same = (gap <= DEDUPE_S) | ((gap > IDLE_S) & (gap <= IDLE_S + COOLDOWN_S))
    rows = alerts.select("key", "rule", "opened_sec").withColumn("_new", F.when(same, 0).otherwise(1))
    rows = rows.withColumn("incident", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("key", "rule", "incident").agg(F.min("opened_sec").alias("opened_sec"), F.max("opened_sec").alias("last_sec"), F.count("*").alias("n"))


def cascades(origins: DataFrame) -> DataFrame:
    """origin, origin_sec, n, keys: alerts with one origin and origin time, told as one."""
    keys = F.array_join(F.array_sort(F.collect_set("key")), ",").alias("keys")
    return origins.groupBy("origin", "origin_sec").agg(F.count("*").alias("n"), keys)


def incident_state(incidents: DataFrame, now_sec: int) -> DataFrame:
    """incidents with status at a time and, for resolved ones, the end of their cooldown."""
    idle = F.lit(now_sec) - F.col("last_sec")
    status = F.when(idle > IDLE_S, "RESOLVED").otherwise("OPEN")
    return incidents.withColumns({"status": status, "cooldown_until_sec": F.when(idle > IDLE_S, F.col("last_sec") + IDLE_S + COOLDOWN_S)})


def worst(severity: Column) -> Column:
    """The worst level of a group, by rank (not by letter)."""
    return F.max_by(severity, F.array_position(F.array(*map(F.lit, LEVELS)), severity))


def records(incidents: DataFrame, scored: DataFrame, origins: DataFrame, now_sec: int) -> DataFrame:
    """A row for each of incidents (incident_sessions) with an id by time of opening, the worst severity
    of its alerts, the origin of its first one, status and end of cooldown."""
    alert = scored.join(origins, ["key", "rule", "opened_sec"]).select("key", "rule", F.col("opened_sec").alias("at"), "severity", "origin")
    own = incidents.join(alert, ["key", "rule"]).where((F.col("at") >= F.col("opened_sec")) & (F.col("at") <= F.col("last_sec")))
    rows = own.groupBy(*incidents.columns).agg(worst(F.col("severity")).alias("max_severity"), F.min_by("origin", "at").alias("origin"))
    # numbered hour by hour, after as many as there were in the hours before, which a table of hours tells
    rows = written(rows.withColumn("_hour", F.floor(F.col("opened_sec") / CHUNK_S)), "incidents")
    upto = Window.orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = rows.groupBy("_hour").agg(F.count("*").alias("_n")).select("_hour", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_hour").orderBy("opened_sec", "key", "rule"))
    numbered = rows.join(hours, "_hour").withColumn("id", F.format_string("inc_%04d", F.col("_before") + place))
    return incident_state(numbered, now_sec).drop("incident", "_hour", "_before")


def acknowledged(records: DataFrame, acks: DataFrame) -> DataFrame:
    """records after acks (id, ack_sec): an acknowledged incident isn't resolved by time alone."""
    rows = records.join(acks.groupBy("id").agg(F.min("ack_sec").alias("ack_sec")), "id", "left")
    told = F.col("ack_sec").isNotNull() & (F.col("ack_sec") <= F.col("last_sec") + IDLE_S)
    return rows.withColumns({"status": F.when(told, "ACKNOWLEDGED").otherwise(F.col("status")), "cooldown_until_sec": F.when(~told, F.col("cooldown_until_sec"))})
