"""Lines with wrong clocks, told apart before any watermark sees them.

A watermark is the latest time of all lines, so one line of next week would make all others late. Each
micro-batch's lines are counted by stretches of BOUND_S seconds; stretches next to each other are one run, and the
run that holds the upper median line is the time it is. Lines of later runs have clocks that are ahead; lines of earlier ones are
behind, unless they are many, as after an outage. A small batch is judged together with the lines of batches before
it, so that a batch of one wrong line doesn't speak for itself, and the time moves on with the majority."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logquill.operators.parse import parse

#: Seconds of a stretch; lines that a judgement needs; share of the lines that an earlier run needs to be kept.
BOUND_S, LEAST, SHARE = 300, 1000, 0.05
HISTORY = "batch long, stretch long, n long"


def judged(counts: DataFrame, share: float = SHARE) -> DataFrame:
    """(stretch, clock) of (stretch, n): ok, ahead or behind. One row a stretch: a time of 13 digits has 33 million at most, and a
    log a few, so one ordered pass over them is small."""
    order = Window.orderBy("stretch")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.coalesce(F.col("stretch") - F.lag("stretch").over(order) > 1, F.lit(False)).cast("int")
    rows = counts.groupBy("stretch").agg(F.sum("n").alias("n")).withColumn("fresh", fresh)
    rows = rows.withColumns({"run": F.sum("fresh").over(upto), "upto": F.sum("n").over(upto), "all": F.sum("n").over(Window.partitionBy())})
    centre = F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("run"))).over(Window.partitionBy())
    rows = rows.withColumns({"centre": centre, "own": F.sum("n").over(Window.partitionBy("run"))})
    clock = F.when(F.col("run") > F.col("centre"), "ahead").when((F.col("run") < F.col("centre")) & (F.col("own") < share * F.col("all")), "behind").otherwise("ok")
    return rows.select("stretch", clock.alias("clock"))


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def guard(lines: DataFrame, path: str, checkpoint: str, bound_s: int = BOUND_S, least: int = LEAST, share: float = SHARE) -> None:
    """Parses the stream of lines (value, ...) and writes it at path/lines with clock: ok, ahead, behind. Runs over what there is.

    A line without a time stays ok. The lines of a micro-batch are one directory and its counts, with those of
    the latest batches before it, another; a batch that is replayed after a crash finds both and writes nothing."""

    def judge(frame: DataFrame, batch: int) -> None:
        spark = frame.sparkSession
        parsed = parse(frame).withColumn("stretch", F.floor(F.col("sec") / bound_s))
        schema = parsed.withColumn("clock", F.lit("ok")).schema
        own, history = f"{path}/lines/batch={batch}", f"{path}/history/batch={batch}"
        known, written = _table(spark, history, HISTORY), _table(spark, own, schema)
        if known is not None and written is not None:
            expected = known.where(F.col("batch") == batch).agg(F.sum("n")).first()[0] or 0
            if written.where("stretch IS NOT NULL").count() == expected:
                return
        counts = parsed.where("stretch IS NOT NULL").groupBy(F.lit(batch).cast("long").alias("batch"), "stretch").agg(F.count("*").alias("n"))
        before = _table(spark, f"{path}/history/batch={batch - 1}", HISTORY)
        both = counts if before is None else counts.unionByName(before)
        # of earlier batches as many as it takes to have enough lines
        sizes = both.groupBy("batch").agg(F.sum("n").alias("size"))
        later = F.coalesce(F.sum("size").over(Window.orderBy(F.desc("batch")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        kept = sizes.withColumn("later", later).where((F.col("later") < least) | (F.col("batch") == batch)).select("batch")
        both.join(kept, "batch").select("batch", "stretch", "n").write.mode("overwrite").parquet(history)
        clocks = judged(spark.read.schema(HISTORY).parquet(history), share)
        marked = parsed.join(clocks, "stretch", "left").withColumn("clock", F.coalesce("clock", F.lit("ok")))
        marked.select(schema.names).write.mode("overwrite").parquet(own)

    query = lines.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def guarded(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The parsed lines with right clocks as a stream, and those with wrong ones as a table, after guard() has run."""
    schema = spark.read.parquet(f"{path}/lines").schema
    stream = spark.readStream.schema(schema).parquet(f"{path}/lines").where("clock = 'ok'")
    return stream, spark.read.schema(schema).parquet(f"{path}/lines").where("clock <> 'ok'")
