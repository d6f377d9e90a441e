"""Vector tables: normalise, add, search exactly, describe."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.storage import staged

from .best import Best, cut, seeded, steps

#: Rows of a table that meet the queries at a time.
SLICE = 2048
#: Bytes of query vectors that one pass over the table may broadcast.
QUERY_BYTES = 64 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """Unit vector as doubles; a zero vector stays as it is."""
    length = norm(v)
    return F.transform(v, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def add_stats(index: DataFrame, added: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(n_added, n_new, n_duplicate) of rows to add, by whether their key is there already."""
    seen = index.select(key).distinct().withColumn("seen", F.lit(1))
    return added.join(seen, key, "left").agg(F.count("*").alias("n_added"), F.count_if(F.col("seen").isNull()).alias("n_new"), F.count("seen").alias("n_duplicate"))


def top_k(vectors: DataFrame, query: list[float], k: int = 5, key: str = "chunk_id") -> DataFrame:
    """The k best keys by inner product with one query, best score of each key, ties by key. Filter ``vectors`` first."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(key, F.round(dot(F.col("embedding"), q), 6).alias("score"))
    return scored.groupBy(key).agg(F.max("score").alias("score")).orderBy(F.desc("score"), key).limit(k)


def _in_blocks(queries: DataFrame, qid: str):
    """(ids, matrix) of the queries, a block of at most QUERY_BYTES at a time; the driver never holds more."""
    ids, rows, size = [], [], 0
    for row in queries.select(qid, "embedding").where(F.col("embedding").isNotNull()).orderBy(qid).toLocalIterator():
        vector = np.array(row[1], np.float64)
        if rows and size + vector.nbytes > QUERY_BYTES:
            yield np.array(ids), np.stack(rows)
            ids, rows, size = [], [], 0
        ids.append(row[0])
        rows.append(vector)
        size += vector.nbytes
    if rows:
        yield np.array(ids), np.stack(rows)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(rows, -1)


def _every_block(vectors: DataFrame, queries: DataFrame, kernel, schema: str, qid: str) -> DataFrame:
    """Union of kernel(batches, ids, matrix) over the blocks of queries; several blocks are written one after the other."""
    spark, out = vectors.sparkSession, None
    for block in _in_blocks(queries, qid):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            yield from kernel((batch for batch in batches if batch.num_rows), *shared.value)

        found = vectors.mapInArrow(run, schema)
        out = found if out is None else staged(out, "scores").unionByName(staged(found, "scores"))
    return spark.createDataFrame([], schema) if out is None else out


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "chunk_id", places: int = 6, qid: str = "qid") -> DataFrame:
    """(qid, key, score, rank): exact top-k of every query (columns qid, embedding) over the whole table.

    A stated set of queries meets all rows in blocks: tasks multiply an Arrow batch by a block of
    queries, CELLS scores at a time, and keep the task's best k keys for each; the k best of those are taken after one
    shuffle of k rows a query and task. Query blocks stay under QUERY_BYTES. Ties by key.
    """
    kind = vectors.schema[key].dataType.simpleString()

    def kernel(batches, ids, matrix):
        held, key_type = Best(len(ids), k), None
        for batch in batches:
            key_type = batch.schema.field(key).type
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                names, of = np.unique(np.array(part.column(key).to_pylist(), dtype=object), return_inverse=True)
                rows = _matrix(part.column("embedding"), part.num_rows)
                for some in steps(len(ids), part.num_rows):
                    scores = np.round(matrix[some] @ rows.T, places)
                    best = np.full((len(scores), len(names)), -np.inf)
                    if len(names) == len(of):
                        best[:, of] = scores
                    else:
                        np.maximum.at(best, (slice(None), of), scores)  # the best row of each key
                    row, col = np.nonzero(best >= seeded(best, held.least[some], k)[:, None])
                    kept = cut(row, best[row, col], col, k)
                    row, col = row[kept], col[kept]
                    held.add(row + some.start, best[row, col], names[col].tolist())
        found = list(held.rows())
        if found:
            query, score, name = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids[list(query)], pa.int64()), pa.array(name, key_type), pa.array(score)], ["qid", key, "score"])

    found = _every_block(vectors.where(F.col("embedding").isNotNull() & F.col(key).isNotNull()).select(key, "embedding"), queries, kernel, f"qid long, {key} {kind}, score double", qid)
    best = found.groupBy("qid", key).agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), key))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def cosines(vectors: DataFrame, queries: DataFrame, key: str, places: int = 6, qid: str = "qid") -> DataFrame:
    """(qid, key, similarity) of every query with every row of a table of few rows a document; 0 beside a zero vector."""
    kind = vectors.schema[key].dataType.simpleString()

    def kernel(batches, ids, matrix):
        for batch in batches:
            rows = _matrix(batch.column("embedding"), batch.num_rows)
            for some in steps(len(ids), len(rows)):
                mine = matrix[some]
                size = np.linalg.norm(mine, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None, :]
                scores = np.where(size > 0, mine @ rows.T / np.where(size > 0, size, 1), 0.0).round(places)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[some], len(rows)), pa.int64()), pa.concat_arrays([batch.column(key)] * len(mine)), pa.array(scores.ravel())], ["qid", key, "similarity"])

    return _every_block(vectors.where(F.col("embedding").isNotNull()).select(key, "embedding"), queries, kernel, f"qid long, {key} {kind}, similarity double", qid)


def mean_vectors(vectors: DataFrame, group: str) -> DataFrame:
    """(group, embedding): mean vector of each group; sums are combined before the one shuffle of a row a group and task."""
    summed = vectors.select(group, array_to_vector("embedding").alias("v")).where("v is not null").groupBy(group).agg(Summarizer.mean(F.col("v")).alias("m"))
    return summed.select(group, vector_to_array("m").alias("embedding"))


def index_stats(vectors: DataFrame, key: str = "chunk_id", doc: str = "document_id") -> DataFrame:
    out = vectors.agg(F.count("*").alias("total"), F.countDistinct(key).alias("unique_keys"), F.countDistinct(doc).alias("documents"), F.max(F.size("embedding")).cast("long").alias("dimension"))
    duplicates = F.col("total") - F.col("unique_keys")
    rate = F.when(F.col("total") > 0, F.format_string("%.1f%%", 100.0 * duplicates / F.col("total"))).otherwise("0%")
    return out.withColumn("duplicates", duplicates).withColumn("duplicate_rate", rate)


def hashed_embedding(docs: DataFrame, tokens: Column, key: str, dimension: int = 64) -> DataFrame:
    """(key, bucket, value): unit-length feature-hashing embedding in sparse rows, from md5 of each token."""
    terms = docs.select(key, F.explode(tokens).alias("t"))
    bucket = (F.conv(F.substring(F.md5("t"), 1, 6), 16, 10).cast("long") % dimension).alias("bucket")
    counts = terms.select(key, bucket).groupBy(key, "bucket").agg(F.count("*").cast("double").alias("n"))
    return counts.withColumn("value", F.round(F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key))), 6)).drop("n")


def hashing_encoder(dimension: int = 64):
    """An encoder for ``encode``: unit-length counts of words in buckets of their md5; a text without words gives zeros."""

    def run(texts: list[str]) -> np.ndarray:
        known: dict[str, int] = {}
        out = np.zeros((len(texts), dimension))
        for i, text in enumerate(texts):
            for word in text.split():
                if word not in known:
                    known[word] = int(hashlib.md5(word.encode()).hexdigest()[:6], 16) % dimension
                out[i, known[word]] += 1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)

    return run


def encode(rows: DataFrame, encoder, key: str, text: Column) -> DataFrame:
    """(key, embedding): any encoder from a list of texts to a matrix, called in Arrow batches on the executors; null counts as empty."""

    def kernel(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(list(encoder(batch.column("__text").to_pylist())), pa.list_(pa.float64()))], [key, "embedding"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.coalesce(text, F.lit("")).alias("__text")).mapInArrow(kernel, f"{key} {kind}, embedding array<double>")


def remove(vectors: DataFrame, gone: DataFrame, key: str = "chunk_id") -> DataFrame:
    return vectors.join(gone.select(key).distinct(), key, "left_anti")


def centroid_distances(vectors: DataFrame, doc: str = "document_id") -> DataFrame:
    """``vectors`` with the Euclidean distance of each to its document's mean vector."""
    mean = mean_vectors(vectors, doc).withColumnRenamed("embedding", "centroid")
    gap = F.zip_with("embedding", "centroid", lambda a, b: a.cast("double") - b)
    return vectors.join(mean, doc).withColumn("distance", norm(gap))
