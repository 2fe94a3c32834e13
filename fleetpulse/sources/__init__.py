"""Readers and writers: telemetry CSV, rulebase, Parquet, text, JDBC, result sets."""
