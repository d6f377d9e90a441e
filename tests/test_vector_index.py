"""The cell index against the whole product."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from lexmill.operators.vector_index import VectorIndex
from lexmill.operators.vectors import top_k_batch
from lexmill.storage import shared_dir

SCHEMA = "chunk_id string, embedding array<double>, label int"


def folder(spark):
    return f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"


def clusters(n, seed=1, scale=0.05):
    r = random.Random(seed)
    centres = [[r.uniform(-1, 1) for _ in range(8)] for _ in range(10)]
    return [(f"v{seed}_{i}", [x + r.gauss(0, scale) for x in centres[i % 10]], i % 10) for i in range(n)]


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_exact_and_reads_few_cells(spark):
    data = spark.createDataFrame(clusters(600) + [("v1_7", [3.0] * 8, 1), (None, [9.0] * 8, 1), ("null", None, 1)], SCHEMA).repartition(3)
    queries = data.where("chunk_id like 'v1_%1'").select(F.xxhash64("chunk_id").alias("qid"), "embedding").dropDuplicates(["qid"])
    index = VectorIndex.create(data, folder(spark), cells=20)
    report = {}
    want = top_k_batch(data, queries, 5).select("qid", "chunk_id", "score", "rank")
    assert rows(index.search(queries, 5, report=report)) == rows(want)
    assert report["scored"] < report["pairs"] / 2
    one = queries.orderBy("qid").limit(1)
    few = {}
    assert rows(index.search(one, 3, report=few)) == rows(top_k_batch(data, one, 3).select("qid", "chunk_id", "score", "rank"))
    assert few["cells_read"] < 10
    filtered = index.search(queries, 4, where=F.col("label") == 3)
    assert rows(filtered) == rows(top_k_batch(data.where("label = 3"), queries, 4).select("qid", "chunk_id", "score", "rank"))
    with pytest.raises(ValueError, match="there is an index"):
        VectorIndex.create(data, index.path)


def test_add_and_reopen(spark):
    first, second = clusters(200), clusters(150, 2, 0.4)
    index = VectorIndex.create(spark.createDataFrame(first, SCHEMA), folder(spark))
    index.add(spark.createDataFrame(second, SCHEMA))
    both = spark.createDataFrame(first + second, SCHEMA)
    queries = both.where("chunk_id like '%_5'").select(F.xxhash64("chunk_id").alias("qid"), "embedding")
    again = VectorIndex.open(spark.newSession(), index.path)
    assert again.number == 1 and again.rows().count() == 350
    assert rows(again.search(queries, 6)) == rows(top_k_batch(both, queries, 6).select("qid", "chunk_id", "score", "rank"))
    assert index.rows().count() == 200  # readers of the earlier state go on


def test_ties_few_rows_and_empty(spark):
    same = spark.createDataFrame([(f"k{i}", [1.0, 0.0], 1) for i in range(30)] + [("z", [0.0, 0.0], 1)], SCHEMA)
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "qid long, embedding array<double>")
    index = VectorIndex.create(same, folder(spark), cells=4)
    assert rows(index.search(queries, 3)) == rows(top_k_batch(same, queries, 3).select("qid", "chunk_id", "score", "rank"))
    one = VectorIndex.create(same.limit(1), folder(spark))
    assert len(rows(one.search(queries, 3))) == 2
    none = VectorIndex.create(same.limit(0), folder(spark))
    assert none.search(queries, 3).collect() == [] and VectorIndex.open(spark, none.path).cells().count() == 0
    assert index.search(queries.limit(0), 3).collect() == []
