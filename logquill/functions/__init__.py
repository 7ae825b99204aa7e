"""Column expressions: line parsing, statistics, redaction patterns."""
