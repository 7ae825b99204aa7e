"""Removal of personal data from text, by patterns in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "[REDACTED]"
# Fixed patterns, in the order in which they apply: (category, pattern).
PATTERNS = (
    ("ssn", r"\b\d{3}-?\d{2}-?\d{4}\b"),
    ("dob", r"\b\d{4}-\d{2}-\d{2}\b"),
    ("dob", r"\b\d{2}/\d{2}/\d{4}\b"),
    ("dob", r"\b\d{2}-\d{2}-\d{4}\b"),
    ("dob", r"\b\d{1,2}-[A-Za-z]{3}-\d{4}\b"),
    ("dob", r"\b\d{8}\b"),
    ("email", r"(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("phone", r"\b\d{3}-\d{3}-\d{4}\b"),
    ("phone", r"\(\d{3}\)\s*\d{3}-\d{4}"),
    ("phone", r"\b\d{10}\b"),
    ("phone", r"\b\+1-\d{3}-\d{3}-\d{4}\b"),
    ("member_id", r"(?i)\b(MBR|CLM|PRV|APP|EVT|ISA|BNK|REMIT|txn|claim|member|provider|app|file|report|user)-\d+\b"),
    ("other", r"(?i)\bNPI-\d+\b"),
    ("other", r"(?i)\bfund=F-\d+\b"),
    ("other", r"(?i)\bshard=\d+\b"),
)
CATEGORIES = ("ssn", "dob", "email", "phone", "member_id", "other")


#: Every pattern needs one of these, so a text without is left after one look.
HINT = "[0-9@]"


#: No match goes beyond a word, but for white space before a phone number, and every word of a match has a hint.
PLAIN_WORD, PLAIN_WORDS = r"(?<!\S)[^\s0-9@]++(?!\S)", r"\s~[~\s]*+"


def hinted(text: Column) -> Column:
    """text with its words without a hint told as ~, and runs of them as one: it has the same matches and is short, as most words have
    none. The place of a word stays taken, so words that weren't next to each other still aren't."""
    return F.regexp_replace(F.regexp_replace(text, PLAIN_WORD, "~"), PLAIN_WORDS, " ~ ")


def redact(text: Column) -> Column:
    out = text
    for _, pattern in PATTERNS:
        out = F.regexp_replace(out, pattern, MARK)
    return F.when(text.rlike(HINT), out).otherwise(text)


def has_personal_data(text: Column) -> Column:
    found = F.lit(False)
    for _, pattern in PATTERNS:
        found = found | text.rlike(pattern)
    return text.rlike(HINT) & found


def redact_values(value: Column, data_type) -> Column:
    """value with every string inside it redacted: in arrays, maps (values) and structs."""
    from pyspark.sql import types as T

    if isinstance(data_type, T.StringType):
        return redact(value)
    if isinstance(data_type, T.ArrayType):
        return F.transform(value, lambda x: redact_values(x, data_type.elementType))
    if isinstance(data_type, T.MapType):
        return F.transform_values(value, lambda _, v: redact_values(v, data_type.valueType))
    if isinstance(data_type, T.StructType):
        inside = F.struct(*(redact_values(value[f.name], f.dataType).alias(f.name) for f in data_type.fields))
        return F.when(value.isNotNull(), inside)
    return value
