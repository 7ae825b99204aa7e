"""Delivery: an outbox of alerts with idempotency keys, and the events they are told as."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logquill.functions import stats as s

STATUSES = ("pending", "in_progress", "delivered", "failed")
MAX_ATTEMPTS, BATCH, KEEP_DAYS = 5, 10, 7
SCHEMA = "idempotency_key string, payload string, status string, attempts int, next_attempt_s long, created_s long"


def idempotency_key(*columns: str) -> Column:
    return F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in columns)), 256)


def entries(alerts: DataFrame) -> DataFrame:
    """Outbox rows of alerts (key, rule, opened_sec, ...), one for each key, rule and opening."""
    rows = alerts.withColumn("idempotency_key", idempotency_key("key", "rule", "opened_sec"))
    told = F.to_json(F.struct(*alerts.columns))
    return rows.select("idempotency_key", told.alias("payload"), F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.col("opened_sec").alias("next_attempt_s"), F.col("opened_sec").alias("created_s")).dropDuplicates(["idempotency_key"])


def add(outbox: DataFrame, new: DataFrame) -> DataFrame:
    """outbox and those of new that it doesn't have."""
    return outbox.unionByName(new.dropDuplicates(["idempotency_key"]).join(outbox.select("idempotency_key"), "idempotency_key", "left_anti").select(outbox.columns))


def pending(outbox: DataFrame, now_s: int, limit: int = BATCH) -> DataFrame:
    """The next entries that are due."""
    due = outbox.where((F.col("status") == "pending") & (F.col("next_attempt_s") <= now_s))
    return due.orderBy("next_attempt_s", "idempotency_key").limit(limit)


def settle(outbox: DataFrame, results: DataFrame, now_s: int) -> DataFrame:
    """outbox after an attempt: results (idempotency_key, ok). A failed entry waits longer each time
    and is given up after MAX_ATTEMPTS."""
    rows = outbox.join(results, "idempotency_key", "left")
    tries = F.col("attempts") + 1
    status = F.when(F.col("ok").isNull(), F.col("status")).when(F.col("ok"), "delivered").when(tries >= MAX_ATTEMPTS, "failed").otherwise("pending")
    wait = s.backoff_s(tries, F.col("idempotency_key")).cast("long")
    return rows.withColumns(
        {"status": status, "next_attempt_s": F.when(F.col("ok") == F.lit(False), F.lit(now_s) + wait).otherwise(F.col("next_attempt_s")), "attempts": F.when(F.col("ok").isNull(), F.col("attempts")).otherwise(tries)}
    ).select(outbox.columns)


def clean(outbox: DataFrame, now_s: int, days: int = KEEP_DAYS) -> DataFrame:
    """outbox without what was delivered longer ago than that."""
    return outbox.where(~((F.col("status") == "delivered") & (F.col("created_s") < now_s - days * 86400)))


def stats(outbox: DataFrame) -> DataFrame:
    """status, n of all four statuses."""
    counts = outbox.groupBy("status").agg(F.count("*").alias("n"))
    names = outbox.sparkSession.createDataFrame([(x,) for x in STATUSES], "status string")
    return names.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def metric_events(sums: DataFrame, namespace: str = "LogQuill") -> DataFrame:
    """key, sec, event: error rates as embedded-metric JSON with service and component dimensions."""
    part = lambda i: F.split_part("key", F.lit("."), F.lit(i))
    metrics = F.array(F.struct(F.lit(namespace).alias("Namespace"), F.array(F.array(F.lit("Service"), F.lit("Component")), F.array(F.lit("Service"))).alias("Dimensions"), F.array(F.struct(F.lit("ErrorRate").alias("Name"), F.lit("None").alias("Unit"))).alias("Metrics")))
    aws = F.struct((F.col("sec") * 1000).alias("Timestamp"), metrics.alias("CloudWatchMetrics"))
    body = F.to_json(F.struct(aws.alias("_aws"), part(1).alias("Service"), part(2).alias("Component"), F.round(s.rate(F.col("err60"), F.col("tot60")), 6).alias("ErrorRate")))
    return sums.select("key", "sec", body.alias("event"))


def alarms(sums: DataFrame, limit: float = 0.05, period_s: int = 60) -> DataFrame:
    """key, window_start, mean_rate of periods whose mean error rate a second is above the limit."""
    start = (F.floor(F.col("sec") / period_s) * period_s).alias("window_start")
    means = sums.groupBy("key", start).agg(F.avg(s.rate(F.col("err"), F.col("tot"))).alias("mean_rate"))
    return means.where(F.col("mean_rate") > limit).withColumn("mean_rate", F.round("mean_rate", 6))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at a path, empty if there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def stored_entries(spark: SparkSession, path: str) -> DataFrame:
    """The outbox's entries (SCHEMA and batch) of batches that were committed."""
    done = _read(spark, f"{path}/commits", "batch long")
    return _read(spark, f"{path}/entries", f"{SCHEMA}, batch long").join(done.distinct(), "batch", "left_semi")


def record_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that adds the entries of a batch of alerts to the outbox table at path, each key once for good.

    A batch's entries are a directory of their own, and another one says that it was committed; a batch that
    is replayed after that writes nothing, and one that was lost before it is written anew. So an entry is there exactly
    once, whenever a run is killed. An outbox belongs to one stream, whose batch numbers it is kept by."""

    def record(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not _read(spark, f"{path}/commits/batch={batch_id}", "at timestamp").isEmpty():
            return
        known = stored_entries(spark, path).select("idempotency_key")
        entries(batch).join(known, "idempotency_key", "left_anti").write.mode("overwrite").parquet(f"{path}/entries/batch={batch_id}")
        spark.range(1).select(F.current_timestamp().alias("at")).write.mode("overwrite").parquet(f"{path}/commits/batch={batch_id}")

    return record


def deliver_batches(write: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands alerts on, each key once in a batch; with a checkpoint and an
    idempotent write that makes delivery exact."""

    def deliver(batch: DataFrame, batch_id: int) -> None:
        write(entries(batch).withColumn("batch_id", F.lit(batch_id)))

    return deliver
