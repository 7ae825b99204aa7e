"""Streaming counts by component and second.

The event second, not the millisecond, carries the watermark: with a delay of one second a
one-second window closes when a line of two seconds later has come. For the drop rule of late lines
to be exact a query holds one stateful operator; timed.stream_session() gives a session that is set so."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquill.operators.parse import counted, parse
from logquill.sources.tables import shared_folder

SETTLE = "1 second"


def read_log_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Lines of the text files of a folder, as they arrive (a log rotated into files)."""
    return spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", files_per_batch).text(folder)


def settled_counts(parsed: DataFrame) -> DataFrame:
    """key, sec, tot, err, warn of settled seconds, from a stream of parsed lines."""
    timed = counted(parsed).withColumn("second", F.timestamp_seconds("sec")).withWatermark("second", SETTLE)
    level = F.col("level_class")
    counts = timed.groupBy(F.window("second", "1 second"), "key").agg(F.count("*").alias("tot"), F.count_if(level.between(2, 3)).alias("err"), F.count_if(level == 1).alias("warn"))
    return counts.select("key", F.unix_timestamp("window.start").alias("sec"), "tot", "err", "warn")


def per_second_stream(lines: DataFrame) -> DataFrame:
    """key, sec, tot, err, warn of settled seconds, from a stream of lines (value) whose clocks are trusted;
    clock.guard() tells the others apart."""
    return settled_counts(parse(lines))


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs the stream over what there is and ends; its output is a Parquet table at path. A checkpoint of an
    earlier run is gone on from."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
    query.awaitTermination()


def drained(stream: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The table that the stream leaves, with its checkpoint beside it, in the shared folder; and its
    path."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/logquill/{label}-{uuid.uuid4().hex}"
    drain(stream, f"{path}/table", f"{path}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{path}/table"), f"{path}/table"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the events table, for the adapter. The path is told as a pattern, as a stream of one
    file has no base folder."""
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{folder}/[{name[0]}]{name[1:]}")
