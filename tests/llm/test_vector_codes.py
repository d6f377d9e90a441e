"""Product codes against a plain reading of the contract."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import queries
from lexmill.llm.vector_codes import nearest, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v int"


def plain(rows, parts=8, entries=16, rounds=6):
    """(sorted (vec_id, code, error, label_error), digest) by exhaustive distances."""
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [c[p] for c, g in zip(cut, got, strict=True) if g[p][1] == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    got, total = assign(), {}
    out = [(i, "".join(f"{k:02x}" for _, k in g), sum(d for d, _ in g), label) for (i, _, label), g in zip(kept, got, strict=True)]
    for _, _, e, label in out:
        total[label] = total.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, total[label]) for i, c, e, label in out), key=str), digest


def got(frame):
    rows = frame.collect()
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in rows), key=str), {r.codebooks_sha256 for r in rows}


@pytest.mark.parametrize("width", [1, 3, 8])
def test_nearest_equals_exhaustive_search(width):
    rng = np.random.default_rng(width)
    rows, book = rng.integers(-4, 5, (500, width)), rng.integers(-4, 5, (16, width))
    entry, distance = nearest(rows, book)
    want = ((rows[:, None] - book[None]) ** 2).sum(2)
    assert (entry == want.argmin(1)).all() and (distance == want.min(1)).all()
    entry, distance = nearest(rows, book[:1])
    assert (entry == 0).all() and (distance == want[:, 0]).all()


def test_query_equals_plain_reading(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    want, digest = plain(rows)
    assert got(queries.op11_vector_codes(spark, "/root/testdata/sf0.001")) == (want, {digest})


def test_edges(spark):
    rng = np.random.default_rng(5)
    rows = [(i if i % 7 else None, [float(x) for x in rng.normal(size=16)], [None, 1, 2][i % 3]) for i in range(90)]
    rows += [(5, rows[5][1], 2)] * 3 + [(200, None, 1), (201, [math.nan] * 16, 1), (202, [None] + [0.0] * 15, 1), (203, [math.inf] + [0.0] * 15, None), (204, [-math.inf] * 16, None), (1, rows[3][1], None)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    want, digest = plain(rows)
    assert got(vector_codes(frame.repartition(5))) == (want, {digest})
    few, digest = plain(rows[1:4])
    assert got(vector_codes(frame.limit(4).where("vec_id is not null").repartition(2))) == (few, {digest})


def test_other_dimensions_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, [0.5] * 16, 1, "x", 1), (2, [0.25] * 8, 1, "x", 1), (3, [], None, "x", 1)], SCHEMA)
    out = {r.vec_id: r for r in vector_codes(frame).collect()}
    assert (out[1].code, out[1].error) == ("00" * 8, 0) and out[2].code is None and out[3].error is None and out[3].label_error is None
    assert vector_codes(frame.limit(0)).collect() == []
    empty = vector_codes(spark.createDataFrame([(3, [], None, "x", 1)], SCHEMA)).collect()
    assert [(r.code, r.error) for r in empty] == [("00" * 8, 0)]
    with pytest.raises(Exception, match="cannot be coded"):
        vector_codes(frame.withColumn("embedding", F.transform("embedding", lambda x: x * 1e9))).collect()
