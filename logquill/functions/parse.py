"""Column expressions of a log line: fields, checks, classes.

The header is a contract of bytes. It is cut from the binary value and read as Latin-1, one
character a byte, so a multi-byte character can't shift fields.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER, LONGEST = 46, 8192
REJECTED = ("oversized_line", "malformed_header", "bad_timestamp", "bad_level", "unknown_component")
LATENCY_BINS, BAD_LATENCY_BIN = 18, 19


def body(value: Column) -> Column:
    """The line's bytes without one trailing carriage return."""
    data = value.cast("binary")
    n = F.octet_length(data)
    ends = F.substring(data, n, F.lit(1)) == F.lit(b"\r")
    return F.when((n > 0) & ends, F.substring(data, F.lit(1), n - 1)).otherwise(data)


def header(data: Column) -> Column:
    return F.decode(F.substring(data, F.lit(1), F.lit(HEADER)), "ISO-8859-1")


def separators_hold(head: Column) -> Column:
    return head.rlike(r"(?s)^.{13}\|.\|.{3}\|.{3}\|.{5}\|.{6}\|.{8}\|$")


def timestamp_ms(head: Column) -> Column:
    digits = F.substring(head, 1, 13)
    return F.when(digits.rlike("^[0-9]{13}$"), digits.cast("bigint"))


def latency_ms(head: Column) -> Column:
    """Milliseconds, -1 if the field isn't six digits."""
    digits = F.substring(head, 31, 6)
    return F.when(digits.rlike("^[0-9]{6}$"), digits.cast("int")).otherwise(F.lit(-1))


def level_class(level: Column) -> Column:
    """0 to 3 by severity, 255 for any other letter."""
    return F.when(level == "I", 0).when(level == "W", 1).when(level == "E", 2).when(level == "F", 3).otherwise(255)


def latency_bin(latency: Column) -> Column:
    """Number of binary digits, 18 at most; 19 for a latency that can't be read."""
    return F.when(latency < 0, BAD_LATENCY_BIN).when(latency == 0, 0).otherwise(F.least(F.length(F.bin(latency)), F.lit(LATENCY_BINS)))


def flags(checks: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*(F.when(c, name) for name, c in checks)))


def quick_reason(n: Column, head: Column) -> Column:
    """Why a line of n bytes with this header can't be read, from its bytes alone; null if it looks well
    formed."""
    return (
        F.when(n > LONGEST, "oversized_line").when(n < HEADER, "short_line").when(~separators_hold(head), "bad_separator")
        .when(timestamp_ms(head).isNull(), "bad_timestamp").when(level_class(F.substring(head, 15, 1)) == 255, "bad_level")
    )
