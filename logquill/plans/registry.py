"""All registered queries of the log engine and their DuckDB equivalents."""

from logquill.plans.oracle import ORACLE_SQL
from logquill.plans.queries import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
