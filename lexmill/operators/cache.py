"""Reuse of embeddings: keys, hits and misses, encoding of what is new, entries that age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TTL_SECONDS = 3600
CAPACITY = 10_000


def cache_key(model: Column, text: Column) -> Column:
    return F.md5(F.concat(model, F.lit(":"), text))


def split_hits(wanted: DataFrame, cached: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    return wanted.join(cached.select(key).distinct(), key, "left_semi"), wanted.join(cached.select(key).distinct(), key, "left_anti")


def encode_missing(wanted: DataFrame, cached: DataFrame, encode, key: str = "key") -> DataFrame:
    """``wanted`` with its vectors: each distinct missing text is encoded once. ``encode`` maps (key, text) rows to (key, embedding)."""
    _, missing = split_hits(wanted, cached, key)
    fresh = encode(missing.dropDuplicates([key]).select(key, "text"))
    return wanted.join(cached.select(key, "embedding").unionByName(fresh), key)


def live_entries(puts: DataFrame, now: Column, key: str = "key", ttl: int = TTL_SECONDS, capacity: int = CAPACITY) -> DataFrame:
    """Entries left at ``now``: the last put of each key, not older than the ttl, the newest ``capacity`` of them."""
    last = puts.groupBy(key).agg(F.max("at").alias("at")).where(F.col("at") >= now - F.expr(f"interval {ttl} seconds"))
    return last.orderBy(F.desc("at"), key).limit(capacity)


def hit_statistics(wanted: DataFrame, cached: DataFrame, key: str = "key") -> DataFrame:
    seen = cached.select(key).distinct().withColumn("hit", F.lit(1))
    out = wanted.join(seen, key, "left").agg(F.count("hit").alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))
    rate = F.when(F.col("hits") + F.col("misses") > 0, F.format_string("%.2f%%", 100.0 * F.col("hits") / (F.col("hits") + F.col("misses")))).otherwise("0.00%")
    return out.withColumn("hit_rate", rate)


def newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__rn = 1").drop("__rn")
