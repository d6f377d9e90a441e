"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.storage import discard, shared_dir, staged  # noqa: F401

#: A value with over one in HOT_SHARE of all rows, and over HOT_LEAST rows, is hot; at most HOT_SHARE values can be.
HOT_SHARE, HOT_LEAST = 1000, 1000
#: Text bytes that a numpy kernel takes at a time; bounds its working memory.
KERNEL_BYTES = 2 << 20


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files of finished plans now, not at its next half-hourly turn: it acts when the JVM collects garbage.

    Only disk use depends on it; a session without a JVM of its own goes without.
    """
    jvm = getattr(getattr(spark, "sparkContext", None), "_jvm", None)
    if jvm is not None:
        jvm.System.gc()


def often(counts: DataFrame, rows: DataFrame, n: str = "n", share: int = HOT_SHARE) -> DataFrame:
    """Rows of ``counts`` (a value and its number ``n`` of rows) whose value holds over one in ``share`` of all ``rows``: at most ``share`` of them."""
    return counts.where(F.col(n) > max(HOT_LEAST, rows.count() // share))


def keyed_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under fixed names: other columns cannot clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def free_prefix(columns: list[str]) -> str:
    """A prefix that no column name starts with, for an operator's own columns."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def id_type(df: DataFrame, name: str = "doc_id") -> str:
    return df.schema[name].dataType.simpleString()


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = KERNEL_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of Arrow batches with at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(ends):
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def text_column(start: Callable[[], Callable[[pa.Array], pa.Array]], kind: str) -> Callable[[Column], Column]:
    """A column made of each row's text: its value stays on the row, whatever the row's id or other columns.

    A task calls ``start`` once for its kernel, which gets the texts in slices as ``text_slices`` cuts them.
    """

    @F.arrow_udf(kind)
    def column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kernel = start()
        for batch in batches:
            parts = [kernel(part.column("text")) for part in text_slices(iter([pa.RecordBatch.from_arrays([batch], ["text"])]))]
            yield pa.concat_arrays(parts or [kernel(batch)])

    return column


def utf8(array: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()
    return [x or b"" for x in array.cast(kind).to_pylist()]


def texts(array: pa.Array) -> list[str]:
    return [x or "" for x in array.to_pylist()]


def split_rows(df: DataFrame, by: list[Column] | None = None) -> DataFrame:
    """Spread rows over the session's shuffle partitions, by key or evenly."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *by) if by else df.repartition(n)


def bits_differ(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
