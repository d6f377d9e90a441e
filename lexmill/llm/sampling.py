"""Bounded samples of rows for fitting a classifier; everything but fitting covers all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_sample(rows: DataFrame, id_col: str, bound: int, seed: int) -> DataFrame:
    """About ``bound`` rows at most, chosen by a hash of the id: the same ones in any partitioning."""
    total = rows.count()
    if total <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30)) < int(bound / total * (1 << 30)))


def one_label(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(doc_id, label 0/1): null ids and labels dropped, repeated rows united (1 wins)."""
    return labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))


def one_text(rows: DataFrame, *others: str) -> DataFrame:
    """(doc_id, text, others...): of the rows of an id the one with the least hash of its text, so a sample of ids is one of as many rows."""
    least = F.min(F.struct(F.xxhash64("text").alias("h"), "text", *others)).alias("r")
    return rows.groupBy("doc_id").agg(least).select("doc_id", "r.text", *[f"r.{c}" for c in others])
