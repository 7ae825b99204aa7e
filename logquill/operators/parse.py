"""Parsing and classification of raw lines; nothing is lost, rejected lines stay as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquill.functions import parse as p
from logquill.sources import vocabulary as voc


def parse(lines: DataFrame) -> DataFrame:
    """Fields, class and flags of each row of lines (value, other columns kept).

    class is the first failed check in the order oversized, header, timestamp, level, component,
    UTF-8 of the message, code; flags lists all. Component and code dimensions have a fixed small
    size and are broadcast."""
    spark = lines.sparkSession
    known = F.broadcast(voc.components(spark).select("service", "component", F.lit(True).alias("known_key")))
    codes = F.broadcast(voc.codes(spark).select("code", F.lit(True).alias("known_code")))
    data = lines.withColumn("_data", p.body(F.col("value")))
    data = data.withColumn("_head", p.header(F.col("_data"))).withColumn("raw_len", F.octet_length("_data"))
    head = F.col("_head")
    whole = (F.col("raw_len") >= p.HEADER) & (F.col("raw_len") <= p.LONGEST)
    field = lambda a, n: F.when(whole, F.substring(head, a, n))
    rest = F.substring(F.col("_data"), F.lit(p.HEADER + 1), F.col("raw_len"))
    cut = data.withColumns(
        {
            "ts_ms": F.when(whole, p.timestamp_ms(head)), "level": field(15, 1), "service": field(17, 3), "component": field(21, 3),
            "code": field(25, 5), "latency_ms": F.when(whole, p.latency_ms(head)).otherwise(-1), "trace": field(38, 8), "_rest": rest,
        }
    )
    joined = cut.join(known, ["service", "component"], "left").join(codes, "code", "left")
    level = p.level_class(F.coalesce("level", F.lit("?")))
    bad_code = (F.col("code") != voc.SUCCESS) & F.col("known_code").isNull()
    checks = [
        ("oversized_line", F.col("raw_len") > p.LONGEST),
        ("malformed_header", (F.col("raw_len") < p.HEADER) | (whole & ~p.separators_hold(head))),
        ("bad_timestamp", whole & F.col("ts_ms").isNull()),
        ("bad_level", whole & (level == 255)),
        ("unknown_component", whole & F.col("known_key").isNull()),
        ("non_utf8_message", whole & ~F.is_valid_utf8(F.col("_rest").cast("string"))),
        ("unknown_code", whole & bad_code),
    ]
    keep = [c for c in lines.columns if c != "value"]
    told = joined.withColumn("flags", p.flags(checks))  # in the order of precedence, so the first is the class
    return told.select(
        *keep, "value", "ts_ms", F.floor(F.col("ts_ms") / 1000).alias("sec"), "level", level.alias("level_class"), "service", "component",
        F.concat_ws(".", "service", "component").alias("key"), "code", "latency_ms", "trace",
        F.make_valid_utf8(F.col("_rest").cast("string")).alias("message"), "raw_len", F.coalesce(F.get("flags", F.lit(0)), F.lit("valid")).alias("class"), "flags",
    )


def counted(parsed: DataFrame) -> DataFrame:
    """Lines that count for their component."""
    return parsed.where(~F.col("class").isin(*p.REJECTED))


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("class").isin(*p.REJECTED))
