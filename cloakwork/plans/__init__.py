"""Registered queries: each with the same question in DuckDB's SQL, where SQL can ask it."""
