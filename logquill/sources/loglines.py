"""Log lines: reading raw text, writing lines of the fixed header, and an adapter from events.

A line is a 46-byte header and a message:
timestamp (13 digits)|level|service|component|code|latency (6 digits)|trace (8 hex digits)|message
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logquill.sources import vocabulary as voc

EPOCH_MS = 1790603400000
#: The adapter's fault: component index, first and last second, share of a hundred events.
FAULT_INDEX, FAULT_FIRST, FAULT_LAST, FAULT_SHARE = 7, 80, 139, 60
LASTING = 10**9
#: What else happens, as (component index, first and last second): errors of few lines, slow answers, silence (no lines at
#: all), a code that no catalogue has, lines of a component that nobody knows. Slow answers take so many times as long.
BURST, SLOW, SILENT, NEW_CODE, NEWCOMER = (3, 130, 160), (12, 60, LASTING), (6, 65, 190), (9, 100, 119), (15, 40, 69)
SLOWER, UNLISTED, UNKNOWN = 8, "W9777", "NEW|CMP"
#: Lines one after the other that share a trace.
TRACED = 4
LONG = 100_000
WRONG_S = 1_000_000
#: Broken lines by event_id modulo 997: what is kept up to, put in, kept (from, length), put in, kept from.
BROKEN = [
    (1, 0, "garbage line without a header", 1, 0, "", LONG),
    (2, 19, ",", 1, 0, "", 21),
    (3, 12, "a", 1, 0, "", 14),
    (4, 14, "X", 1, 0, "", 16),
    (5, 16, "ZZZ|QQQ", 1, 0, "", 24),
    (6, 14, "E", 16, 9, "E9999", 30),
    (7, 46, "x" * 9000, 1, 0, "", LONG),
]


def read_log(spark: SparkSession, path: str, max_lines: int | None = None) -> DataFrame:
    """Lines of a text log as `value`; only newline ends a line, so a carriage return stays."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.limit(max_lines) if max_lines is not None else lines


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground-truth records, one JSON object a line."""
    return spark.read.schema("seq long, event string, target string, at_ms long, detail map<string,string>").json(path)


def format_line(ts_ms: Column, level: Column, service: Column, component: Column, code: Column, latency_ms: Column, trace: Column, message: Column) -> Column:
    """A line of these fields; a field that doesn't fit its width fails the query."""
    checks = [
        (ts_ms.between(0, 9_999_999_999_999), "timestamp"), (level.isin("I", "W", "E", "F"), "level"), (F.length(service) == 3, "service"),
        (F.length(component) == 3, "component"), (F.length(code) == 5, "code"), (latency_ms.between(0, 999_999), "latency"),
        (trace.rlike("^[0-9a-f]{8}$"), "trace"), (~message.contains("\n"), "message"),
    ]
    line = F.format_string("%013d|%s|%s|%s|%s|%06d|%s|%s", ts_ms, level, service, component, code, latency_ms, trace, message)
    for ok, what in checks:
        line = F.when(F.coalesce(ok, F.lit(False)), line).otherwise(F.raise_error(F.lit(f"{what} doesn't fit its field")))
    return line


def lines_from_events(events: DataFrame) -> DataFrame:
    """event_id and value: the events table told as a log, 50 lines a second, with a fault window, what else
    happens by component and time, deploys (by event_id modulo 499) and some broken lines (modulo 997)."""
    spark = events.sparkSession
    components = voc.components(spark).select("idx", "service", "component", "key")
    codes = voc.codes(spark).select("key", F.col("level").alias("code_level"), "place", "places", "code", "template")
    k = F.get_json_object("props", "$.k").cast("int")
    second = F.floor(F.col("event_id") * 20 / 1000)
    fault = (F.col("idx") == FAULT_INDEX) & second.between(FAULT_FIRST, FAULT_LAST) & F.col("event_type").isin("error", "view") & (F.col("k") < FAULT_SHARE)
    during = lambda x: (F.col("idx") == x[0]) & second.between(x[1], x[2])
    burst = during(BURST) & (F.col("event_type") == "view") & (F.col("k") < 60)
    level = F.when(fault | burst, "E").when((F.col("event_type") == "error") & (F.col("k") < 6), "E").when((F.col("event_type") == "purchase") & (F.col("k") < 30), "W").otherwise("I")
    base = events.select("event_id", "event_type", "value", k.alias("k"), F.pmod("user_id", F.lit(20)).cast("int").alias("idx")).where(~during(SILENT))
    placed = base.join(F.broadcast(components), "idx").withColumn("level", level)
    drawn = placed.join(F.broadcast(codes), (placed["key"] == codes["key"]) & (placed["level"] == codes["code_level"]) & (F.col("k") % F.col("places") == F.col("place")), "left")
    message = F.replace(F.coalesce("template", F.lit("ok event={n}")), F.lit("{n}"), F.col("event_id").cast("string"))
    message = F.when(F.col("event_id") % 499 == 7, F.concat(F.lit("DEPLOY release=R-"), F.col("event_id").cast("string"))).otherwise(message)
    name = F.when(during(NEWCOMER) & (F.col("k") < 60), UNKNOWN).otherwise(F.concat("service", F.lit("|"), "component"))
    code = F.when(during(NEW_CODE) & (F.col("k") < 50), UNLISTED).otherwise(F.coalesce("code", F.lit(voc.SUCCESS)))
    latency = F.floor(F.col("value") * 10) * F.when(during(SLOW), SLOWER).otherwise(1)
    line = F.concat(
        (F.lit(EPOCH_MS) + F.col("event_id") * 20).cast("string"), F.lit("|"), "level", F.lit("|"), name, F.lit("|"), code, F.lit("|"),
        F.lpad(latency.cast("string"), 6, "0"), F.lit("|"), F.lower(F.lpad(F.hex(F.floor(F.col("event_id") / TRACED)), 8, "0")), F.lit("|"), message,
    )
    whole = drawn.select("event_id", line.alias("line"))
    edits = spark.createDataFrame(BROKEN, "kind long, left int, first string, middle int, middle_n int, second string, rest int")
    edited = whole.join(F.broadcast(edits), whole["event_id"] % 997 == edits["kind"], "left")
    cut = lambda a, n: F.substring(F.col("line"), a, n)
    value = F.concat(cut(F.lit(1), F.col("left")), "first", cut(F.col("middle"), F.col("middle_n")), "second", cut(F.col("rest"), F.lit(LONG)))
    return edited.select("event_id", F.when(F.col("left").isNull(), F.col("line")).otherwise(value).alias("value"))


def with_wrong_clocks(lines: DataFrame) -> DataFrame:
    """lines (event_id, value) with a clock WRONG_S ahead or behind on some whole ones, by event_id modulo 499."""
    off = F.when(F.col("event_id") % 499 == 3, WRONG_S * 1000).when(F.col("event_id") % 499 == 5, -WRONG_S * 1000)
    wrong = off.isNotNull() & (F.col("event_id") % 997 > len(BROKEN))
    return lines.withColumn("value", F.when(wrong, F.concat((F.substring("value", 1, 13).cast("long") + off).cast("string"), F.substring("value", 14, LONG))).otherwise(F.col("value")))
