"""The index in shards against plain scores, and what it writes."""

import random
import shutil
from pathlib import Path

import numpy as np
import pytest

from lexmill.operators import best, shard_search
from lexmill.operators.shard_search import ShardIndex
from lexmill.plans import retrieval
from lexmill.storage import shared_dir

from test_lexical_store import QUERIES, folder, frame, plain, texts, words_of

SF = Path("/root/testdata/sf0.01")


def index(spark, docs):
    return ShardIndex.create(spark, folder(spark), frame(spark, docs), toks=words_of("text"))


def found(store, spark, k):
    rows = store.search(spark.createDataFrame(QUERIES, "qid int, query string"), k, toks=words_of("query")).collect()
    return sorted((r.qid, r.key, round(r.bm25, 6), r["rank"]) for r in rows)


@pytest.mark.parametrize("small", [False, True])
def test_equals_plain_scores(spark, monkeypatch, small):
    """Many equal documents, one repeated text; also with tiny shards, steps and blocks."""
    if small:
        monkeypatch.setattr(shard_search, "QUERY_BYTES", 300)
        monkeypatch.setattr(best, "CELLS", 50)
        monkeypatch.setattr(best, "SEED", 4)
    docs = [*texts(300), *[(f"c{i}", "w1 w3 w3 w10") for i in range(150)], ("n", None)]
    store = index(spark, docs)
    assert found(store, spark, 5) == plain(docs, QUERIES, 5)
    assert found(store, spark, 60) == plain(docs, QUERIES, 60)
    with pytest.raises(ValueError, match="there is an index"):
        ShardIndex.create(spark, store.path, frame(spark, docs))
    assert ShardIndex.open(spark, store.path).keys().count() == len(docs)


def test_few_documents_and_weights_below_zero(spark):
    for docs in ([("a", "w1"), ("b", "w1 w2")], [("a", "w1")], [("a", ""), ("b", None)]):
        assert found(index(spark, docs), spark, 5) == (plain(docs, QUERIES, 5) if any(t for _, t in docs) else [])
    assert found(ShardIndex.create(spark, folder(spark), spark.createDataFrame([], "chunk_id string, text string"), toks=words_of("text")), spark, 5) == []
    with pytest.raises(Exception, match="a key is null"):
        index(spark, [(None, "w1")])
    with pytest.raises(ValueError, match="there is no index"):
        ShardIndex.open(spark, folder(spark))


@pytest.mark.parametrize("cells", [100, 1 << 21])
def test_hybrid_equals_plain_fusion(spark, monkeypatch, cells):
    """Documents without vector, vectors without document, a key with two vectors, queries without either leg."""
    monkeypatch.setattr(best, "CELLS", cells)
    docs, r = [*texts(200, 3), *[(f"c{i}", "w1 w3 w3 w10") for i in range(40)]], random.Random(4)
    vectors = [(k, [r.uniform(-1, 1) for _ in range(4)]) for k in [*[k for k, _ in docs[:150]], *[f"v{i}" for i in range(30)], "k7"]]
    queries = [(i, q, [r.uniform(-1, 1) for _ in range(4)] if i % 3 else None) for i, q in QUERIES]
    asked = spark.createDataFrame(queries, "qid int, query string, embedding array<double>")
    got = index(spark, docs).hybrid(spark.createDataFrame(vectors, "chunk_id string, embedding array<double>"), asked, 5, toks=words_of("query"))
    words = {(q, k): b for q, k, b, _ in plain(docs, [(i, q) for i, q, _ in queries], 10**6)}
    want = []
    for i, _, v in queries:
        near = {}
        for key, e in vectors if v else []:
            near[key] = max(near.get(key, -9), round(sum(a * b for a, b in zip(v, e, strict=True)), 6))
        scored = sorted((-round(0.7 * near.get(k, 0.0) + (1 - 0.7) * words.get((i, k), 0.0), 7), k) for k in set(near) | {k for q, k in words if q == i})[:5]
        want += [(i, k, n) for n, (_, k) in enumerate(scored, 1)]
    assert sorted((x.qid, x.chunk_id, x["rank"]) for x in got.collect()) == sorted(want)


@pytest.mark.parametrize("query", [retrieval.bm25_topk_batch, retrieval.hybrid_topk_batch])
def test_index_and_search_write_little(spark, tmp_path, query):
    """All that stays of building and searching, against the documents."""
    shutil.copytree(SF, tmp_path / "in")
    shared = Path(shared_dir(spark).removeprefix("file:")).resolve()
    size = lambda: sum(p.stat().st_size for p in shared.rglob("*.parquet"))
    before = size()
    assert query(spark, str(tmp_path / "in")).count()
    assert size() - before < 1.3 * (SF / "documents.parquet").stat().st_size


def test_cut_keeps_places_of_equal_values():
    row, value, col = np.array([0, 0, 0, 0, 1]), np.array([2.0, 3.0, 3.0, 3.0, 1.0]), np.array([0, 3, 1, 2, 0])
    assert best.cut(row, value, col, 2).tolist() == [2, 3, 4]
    assert best.cut(row, value, col, 2, each=True).tolist() == [2, 3, 0, 4]
    assert best.cut(row[:0], value[:0], col[:0], 2).tolist() == []
