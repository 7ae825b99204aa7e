"""redact_stats: a text is replaced once a pattern, and only words with a hint are looked at."""

from pyspark.sql import functions as F

from logquill.functions import redact as r
from logquill.operators import redaction

TEXTS = [
    "call (555) 123-4567 or (555) foo 123-4567, (555) ~123-4567, (555)\n\t123-4567", "~ plain words only", "a~ 12-34 ~12345678 ~", "", None, "fund=F-12 shard=3 NPI-9 MBR-12 x@y.org word 1-Jan-2020",
    "123-45-6789 12345678 1234567890 2020-01-02 01/02/2020 tel 555-123-4567.", "x" * 50_000 + " 12345678 " + "é" * 50_000, "mail a.b@c|d.com; claim-7,user-8  12345678  " + "word " * 30_000,
]


def test_counts_are_those_of_the_whole_text(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    got, want = {x["category"]: x["n"] for x in redaction.stats(df, "text").collect()}, dict.fromkeys(r.CATEGORIES, 0)
    for category, pattern in r.PATTERNS:
        want[category] += df.agg(F.sum(F.regexp_count("text", F.lit(pattern)))).first()[0]
        df = df.select(F.regexp_replace("text", pattern, r.MARK).alias("text")).localCheckpoint()
    assert got == want and all(want.values())
    assert {x["n"] for x in redaction.stats(df.limit(0), "text").collect()} == {0}


def test_a_text_is_replaced_once_a_pattern(spark):
    df = spark.createDataFrame([("1",)], "text string")
    plan = redaction.stats(df, "text")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 2 * len(r.PATTERNS)
