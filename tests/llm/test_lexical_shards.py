"""Sharded lexical search against a plain reading of the contract."""

import math
import re
from collections import Counter

import pyarrow as pa
import pytest

from lexmill.llm import lexical_shards as X
from lexmill.llm import queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k=20):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 75 + (25 * sum(c.values()) * n_docs) // total if total else 75
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def got(frame):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in frame.collect()), key=str)


def table(spark, name):
    return [(r[0], r.text) for r in spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").collect()]


def test_query_equals_plain_reading(spark):
    assert got(queries.op12_lexical_search(spark, "/root/testdata/sf0.001")) == plain(table(spark, "documents"), table(spark, "benchmark"))


@pytest.mark.parametrize(("shard_bytes", "query_bytes"), [(2000, 50), (1, 1)])
def test_many_shards_and_blocks(spark, shard_bytes, query_bytes):
    docs = [(i, t) for i, t in table(spark, "documents") if len(t) < 5000][:80] + [(None, "alpha beta"), (7, "alpha"), (7, "alpha"), (900, None), (901, ""), (902, ".. --"), (903, "Ä ä À alpha\x00Beta_gamma {x}~é")]
    docs += [(1000 + i, "alpha tie") for i in range(40)]
    items = [(1, "alpha"), (1, "alpha beta alpha"), (None, "tie TIE"), (2, None), (3, ""), (4, "nowhere"), (5, "ä É x"), (6, "the and of the")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, item_id string, score int").repartition(3)
    asked = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    index = X.build_index(frame, shard_bytes=shard_bytes)
    assert index.shards.count() > 3 or shard_bytes > 1
    assert got(X.search(index, asked, k=20, query_bytes=query_bytes)) == plain(docs, items)
    assert got(X.search(index, asked, k=3)) == plain(docs, items, 3)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert X.lexical_search(docs, items).collect() == []
    assert X.lexical_search(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"), items.limit(0)).collect() == []
    assert X.lexical_search(spark.createDataFrame([(1, "--"), (2, None)], "doc_id long, text string"), items).collect() == []


def test_long_text_by_pieces():
    words = [f"w{i % 997}x" for i in range(2_600_000)]
    data = " ".join(words).encode()
    assert len(data) > 3 * X.PIECE and b"".join(X._pieces(data)) == data
    shard = X._Shard(1, len(words))
    shard.add([1, 2], [data, b"w5x"])
    row = shard.rows(pa.int64())
    assert row.column("terms")[0].as_py().split() == sorted({w.encode() for w in words})
    m = 75 + (25 * len(words) * 1) // len(words)
    tf = Counter(words)
    first = sorted(tf)[0]
    assert int.from_bytes(row.column("impacts")[0].as_py()[:4], "little") == (10**9 * tf[first]) // (1000 * tf[first] + 12 * m)
    assert X.lengths([data]).tolist() == [len(words)] and X.lengths([b"a b", b"", b"-", b"cc"]).tolist() == [2, 0, 0, 1]
    blank = b"x" * (2 * X.PIECE + 5)
    assert list(X._pieces(blank)) == [blank, b""]
