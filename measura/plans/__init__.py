"""Registered queries, each with its DuckDB oracle where SQL can express it."""
