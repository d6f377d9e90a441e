"""Registry of the queries: key -> (Spark function, DuckDB SQL or None)."""

from __future__ import annotations

from lexmill.plans import assessment, graph, retrieval, text

QUERIES: dict = {}
for topic in (text, graph, retrieval, assessment):
    QUERIES |= topic.QUERIES
