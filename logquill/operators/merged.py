"""Incidents merged along dependencies, with the deploy that came before them.

Alerts belong together if they are of one component, or of two that depend on each other directly, and at most GROUPING_S apart,
and so do chains of them. It is enough to link an alert to the latest one before it of its own component and of each neighbour: alerts of
a component between two that are near are near each other, too, so the chains are the same, and no pairs of a group are made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquill.operators.incidents import GROUPING_S
from logquill.sources import vocabulary as voc
from logquill.sources.tables import written

#: Seconds of a stretch of time within which the latest alert is looked for, and up to which a deploy is told.
STRETCH_S, DEPLOY_S = 3600, 600
MARKER = "DEPLOY "
DEPLOY = f"^{MARKER}"


def latest(asked: DataFrame, told: DataFrame, within_s: int) -> DataFrame:
    """asked (key, sec, id, ...) with found, the value of the last row of told (key, sec, order, value) before it of that key, by (sec, order), if at
    most within_s seconds before. Rows are dealt by key and stretch of time, those of told also to the stretch that within_s reaches."""
    stretch = lambda c: F.floor(c / STRETCH_S)
    rows = told.select("key", "sec", "order", F.struct("sec", "value").alias("_told"), F.lit(None).cast(asked.schema["row"].dataType).alias("row"))
    rows = rows.withColumn("_stretch", F.explode(F.sequence(stretch(F.col("sec")), stretch(F.col("sec") + within_s))))
    both = rows.unionByName(asked.select("key", "sec", "order", F.lit(None).cast(rows.schema["_told"].dataType).alias("_told"), "row", stretch(F.col("sec")).alias("_stretch")))
    before = Window.partitionBy("key", "_stretch").orderBy("sec", "order", F.col("row").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("_last", F.last("_told", ignorenulls=True).over(before)).where("row IS NOT NULL")
    return found.select("row", F.when(F.col("sec") - F.col("_last.sec") <= within_s, F.col("_last.value")).alias("found"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of edges (a, b): each node's smallest connected one. In turn, nodes hang their larger
    neighbours, and then their smaller ones, on the smallest that they know, until nothing changes."""

    def hung(pairs: DataFrame, larger: bool) -> DataFrame:
        both = pairs.union(pairs.select("b", "a")).toDF("a", "b") if larger else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        hang = both.join(least, "a").where((F.col("b") > F.col("a")) if larger else (F.col("b") != F.col("m"))).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return (hang if larger else hang.union(least.select("a", "m"))).where("a <> b").distinct()

    edges, before = written(edges.where("a <> b").distinct(), "merged-edges"), None
    while (now := edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()) != before:
        before = now
        edges = written(hung(hung(edges, True), False), "merged-edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def alert_id() -> Column:
    """Ids in the order of opening, then key and rule."""
    return F.concat_ws("|", F.lpad(F.col("opened_sec").cast("string"), 12, "0"), "key", "rule")


def neighbours(spark) -> DataFrame:
    """(key, near): the component itself and those that it depends on or that depend on it. As many as the platform has."""
    edges = voc.edges(spark).select(F.col("src").alias("key"), F.col("dst").alias("near"))
    own = voc.components(spark).select("key", F.col("key").alias("near"))
    return own.union(edges).union(edges.select("near", "key")).distinct()


def merged_incidents(alerts: DataFrame, deploys: DataFrame, grouping_s: int = GROUPING_S, deploy_s: int = DEPLOY_S) -> DataFrame:
    """origin, opened_sec, last_sec, n, keys, deploy, deploy_sec: incidents of alerts (key, rule, opened_sec) that belong together, the component of the first one, and the
    last of deploys (key, sec, release) of the components concerned in the deploy_s seconds before it."""
    rows = written(alerts.select("key", "rule", "opened_sec", alert_id().alias("id")).distinct(), "merged-alerts")
    told = rows.select("key", F.col("opened_sec").alias("sec"), F.col("id").alias("order"), F.col("id").alias("value"))
    asked = rows.join(F.broadcast(neighbours(rows.sparkSession)), "key").select(F.col("near").alias("key"), F.col("opened_sec").alias("sec"), F.col("id").alias("order"), F.col("id").alias("row"))
    links = latest(asked, told, grouping_s).where("found IS NOT NULL").select(F.col("row").alias("a"), F.col("found").alias("b"))
    of = rows.join(components(links), rows["id"] == F.col("node"), "left").select("key", "opened_sec", "id", F.coalesce("root", "id").alias("root"))
    keys = F.array_sort(F.collect_set("key"))  # as many as the platform has components
    found = written(of.groupBy("root").agg(F.min_by("key", "id").alias("origin"), F.min("opened_sec").alias("opened_sec"), F.max("opened_sec").alias("last_sec"), F.count("*").alias("n"), keys.alias("keys")), "merged-incidents")
    asked = found.select(F.explode("keys").alias("key"), F.col("opened_sec").alias("sec"), F.lit("~").alias("order"), F.struct("root", F.col("opened_sec").alias("at")).alias("row"))
    markers = deploys.select("key", "sec", F.col("release").alias("order"), F.struct("sec", "release").alias("value"))
    last = latest(asked, markers, deploy_s).where("found IS NOT NULL").groupBy("row.root").agg(F.max("found").alias("found"))
    out = found.join(last, "root", "left")
    return out.select("origin", "opened_sec", "last_sec", "n", F.array_join("keys", ",").alias("keys"), F.col("found.release").alias("deploy"), F.col("found.sec").alias("deploy_sec"))


def maybe_deploys(lines: DataFrame) -> DataFrame:
    """The lines (value) among which all deploy lines are: others needn't be parsed."""
    return lines.where(F.col("value").cast("string").contains(MARKER))


def deploy_lines(parsed: DataFrame) -> DataFrame:
    """(key, sec, release) of the log's deploy lines."""
    lines = parsed.where(F.col("message").rlike(DEPLOY) & F.col("sec").isNotNull())
    return lines.select("key", "sec", F.regexp_extract("message", r"release=(\S+)", 1).alias("release")).distinct()
