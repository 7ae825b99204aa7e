"""Redaction of tables and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquill.functions import redact as r


def redact_column(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, r.redact(F.col(column)))


def redact_all(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """df with all strings redacted, nested ones too, but for the columns in keep."""
    return df.select(*(F.col(f.name) if f.name in keep else r.redact_values(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields))


def flags(df: DataFrame, key: str, column: str) -> DataFrame:
    return df.select(key, r.has_personal_data(F.col(column)).alias("has_phi"))


def stats(df: DataFrame, column: str) -> DataFrame:
    """category, n of all matches in a column, each pattern counted after the replacements before it.

    Only words with a hint are looked at. Each replacement is a projection of its own, so that a text is replaced once a
    pattern, and not anew in each later pattern's expression."""
    rows = df.where(F.col(column).rlike(r.HINT)).select(r.hinted(F.col(column)).alias("_text"))
    for i, (_, pattern) in enumerate(r.PATTERNS):
        found, left = F.regexp_count("_text", F.lit(pattern)).cast("long"), F.regexp_replace("_text", pattern, r.MARK)
        rows = rows.select(*(f"_n{j}" for j in range(i)), found.alias(f"_n{i}"), left.alias("_text"))
    each = lambda k: sum((F.col(f"_n{i}") for i, (c, _) in enumerate(r.PATTERNS) if c == k), F.lit(0))
    sums = rows.agg(*(F.coalesce(F.sum(each(k)), F.lit(0)).cast("long").alias(k) for k in r.CATEGORIES))
    return sums.select(F.explode(F.create_map(*(x for k in r.CATEGORIES for x in (F.lit(k), F.col(k))))).alias("category", "n"))
