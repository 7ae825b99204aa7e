"""Registered queries over the given tables, with DuckDB equivalents."""
