"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bits_differ, free_prefix, id_type, keyed_text, staged, text_column, text_slices, utf8
from .components import connected_components

#: Shingles of a text whose bits are counted at a time.
SHINGLES = 1 << 16


def fingerprint(data: bytes, width: int) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text, repeats included; 0 without words."""
    words = data.lower().split()  # bytes: lower-cases A-Z only, splits at space and \t \n \v \f \r only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[width - 1 :].tolist() or [len(joined)]
    first = [0, *(ends + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(last), SHINGLES):  # bits take 64 bytes a shingle
        hashes = np.array([digest(joined[s:e], 42) for s, e in zip(first[at : at + SHINGLES], last[at : at + SHINGLES], strict=False)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(last), bitorder="little").tobytes(), "little")


def simhash_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): one row for each row of ``docs``. Null and word-less texts have fingerprint zero."""
    source = keyed_text(docs, id_col, text_col)

    def kernel(batches):
        for part in text_slices(batches):
            prints = np.array([fingerprint(x, width) for x in utf8(part.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return source.mapInArrow(kernel, f"doc_id {id_type(source)}, fp long")


def ball_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b) fingerprint links that join all fingerprints within ``radius`` differing bits.

    ``prints`` has distinct fingerprints in ``fp``. Each emits every variant within radius/2 flipped
    bits; two fingerprints within ``radius`` share a variant, and two that share one are within
    ``radius``. A variant's bucket therefore holds at most the ball of radius/2 (65 for radius 2),
    however large the input, and a star around its least member keeps all reachability.
    """
    if radius % 2 or radius < 2:
        raise ValueError("radius must be even and at least 2")
    masks = [sum(1 << i for i in c) for k in range(radius // 2 + 1) for c in combinations(range(64), k)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    variants = prints.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m).cast("long")) for m in signed])).alias("variant"))
    bucket = variants.withColumn("least", F.min("fp").over(Window.partitionBy("variant")))
    return bucket.where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct().where(bits_differ(F.col("a"), F.col("b")) <= radius)


def rooted(nodes: DataFrame, radius: int) -> DataFrame:
    """``nodes`` (distinct fingerprints in ``fp``) with the ``root`` of each one's component."""
    roots = connected_components(ball_links(nodes.select("fp"), radius))
    return nodes.join(roots, nodes.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id): near-duplicate group of every row of ``docs``.

    component_id is the least doc_id reachable over links of at most ``radius`` bits. Equal
    fingerprints (copies, word-less texts) are one node: the pair search sees each only once.
    Null ids stay null and never name a component unless it has no other; repeated rows each give a row.
    An empty table gives an empty table; other columns are ignored, whatever their names.
    """
    prints = staged(simhash_fingerprints(docs, id_col, text_col, width), "prints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    named = staged(rooted(nodes, radius), "nodes")
    ids = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return (
        prints.join(named.join(ids, "root").select("fp", "component_id"), "fp")
        .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    )


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """One row of ``docs`` for each near-duplicate group; all columns as they were.

    It is the group's first by id, null ids last, then by a hash of the row; of equal rows any one. Rows are
    numbered in a staged copy, so rows that share an id, or have none, are still told apart.
    """
    own = free_prefix(docs.columns)
    fp, row = own + "fp", own + "row"

    def start():
        return lambda part: pa.array(np.array([fingerprint(x, width) for x in utf8(part)], np.uint64).view(np.int64))

    rows = staged(docs.withColumns({fp: text_column(start, "long")(F.col(text_col).cast("string")), row: F.monotonically_increasing_id()}), "rows")
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    first = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(*hashed).alias("hash"), F.col(row).alias("row"))
    nodes = staged(rows.select(F.col(fp).alias("fp"), first.alias("first")).groupBy("fp").agg(F.min("first").alias("first")), "nodes")
    kept = rooted(nodes, radius).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return rows.join(kept, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
