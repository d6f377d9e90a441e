"""Registered queries by topic: each module has a dict key -> (Spark function, DuckDB SQL or None)."""
