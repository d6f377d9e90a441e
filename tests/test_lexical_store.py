"""The stored lexical index against rebuilds and plain scores."""

import math
import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexmill.operators.hybrid import hybrid_top_k
from lexmill.operators.lexical_store import LexicalStore
from lexmill.plans import retrieval
from lexmill.storage import shared_dir

WORDS = [f"w{i}" for i in range(60)]


def words_of(column):
    return F.filter(F.split(column, " "), lambda w: w != "")


def folder(spark):
    return f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"


def texts(n, seed=1):
    r = random.Random(seed)
    return [(f"k{i}", " ".join(r.choices(WORDS, [1 / (j + 1) for j in range(60)], k=r.randint(0, 40)))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, text string").repartition(3)


def plain(docs, queries, k):
    """(qid, key, bm25, rank) from the definition, over all documents."""
    held = [(key, Counter((t or "").split()), len((t or "").split())) for key, t in docs]
    n, avgdl = len(held), sum(dl for _, _, dl in held) / len(held)
    df = Counter(t for _, c, _ in held for t in c)
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: 0.25 * mean if x < 0 else x for t, x in raw.items()}
    out = []
    for qid, q in queries:
        scored = [(key, sum(idf[t] * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * dl / avgdl)) for t in q.split() if c[t])) for key, c, dl in held if any(c[t] for t in q.split())]
        best = max((s for _, s in scored), default=0)
        ranked = sorted(((-round(s / (best if best > 0 else 1), 6), key) for key, s in scored))[:k]
        out += [(qid, key, -s, r) for r, (s, key) in enumerate(ranked, 1)]
    return sorted(out)


QUERIES = [(i, q) for i, q in enumerate(["w1", "w3 w40 w3", "w0 w1 w2", "w59 w58", "nothing", "", "w10 w0 nothing w25"])]


def found(store, spark, k=5, report=None):
    rows = store.search(spark.createDataFrame(QUERIES, "qid int, query string"), k, toks=words_of("query"), report=report).collect()
    return sorted((r.qid, r.key, round(r.bm25, 6), r["rank"]) for r in rows)


def terms(store):
    return sorted((r.term, r.df, round(r.idf, 6)) for r in store.terms().collect())


def test_search_skips_ranges_and_equals_scoring_all(spark):
    docs = texts(900)
    store = LexicalStore.create(spark, folder(spark), frame(spark, docs), toks=words_of("text"), range_docs=4)
    report = {}
    assert found(store, spark, 3, report) == plain(docs, QUERIES, 3)
    assert 0 < report["scored"] < 0.7 * report["pairs"]
    with pytest.raises(ValueError, match="there is an index"):
        LexicalStore.create(spark, store.path)


def test_add_remove_reopen_compact_equal_a_rebuild(spark):
    first, second = texts(120), [(f"n{i}", t) for i, (_, t) in enumerate(texts(60, 2))] + [("k3", "w1 w1 w59"), ("k4", None)]
    store = LexicalStore.create(spark, folder(spark), frame(spark, first), toks=words_of("text"), range_docs=8)
    store.add(frame(spark, second), toks=words_of("text")).remove(spark.createDataFrame([(f"k{i}",) for i in range(50, 90)] + [("n1",), ("unknown",), (None,)], "chunk_id string"))
    live = [(k, t) for k, t in first if k not in ("k3", "k4") and not (50 <= int(k[1:]) < 90)] + [(k, t) for k, t in second if k != "n1"]
    again = LexicalStore.open(spark.newSession(), store.path)
    assert again.version == 2
    rebuilt = LexicalStore.create(spark, folder(spark), frame(spark, live), toks=words_of("text"))
    small = again.compact()
    for s in (again, small):
        assert found(s, spark) == plain(live, QUERIES, 5)
        assert terms(s) == terms(rebuilt)
        assert sorted(r.key for r in s.keys().collect()) == sorted(k for k, _ in live)
    assert [p.kind for p in small.parts] == ["segments", "corpus"]
    assert found(LexicalStore(spark, store.path, 0), spark) == plain(first, QUERIES, 5)  # readers of an earlier version go on
    with pytest.raises(Exception, match="(?i)exist"):
        LexicalStore(spark, store.path, 1).remove(spark.createDataFrame([("k1",)], "chunk_id string"))  # another writer was first


def test_bounds_hold_when_texts_get_longer(spark):
    docs, longer = texts(80), [(f"l{i}", " ".join(["w7"] * 50 + ["w1"] * (i % 5) + WORDS * 3)) for i in range(60)]
    store = LexicalStore.create(spark, folder(spark), frame(spark, docs), toks=words_of("text"), range_docs=4).add(frame(spark, longer), toks=words_of("text"), range_docs=4)
    assert found(store, spark, 3) == plain(docs + longer, QUERIES, 3)


def test_empty_and_null(spark):
    store = LexicalStore.create(spark, folder(spark))
    assert found(store, spark) == [] and store.keys().collect() == [] and terms(store) == []
    store = store.add(frame(spark, [("a", None), ("b", ""), ("c", "w1")]), toks=words_of("text"))
    assert [x[1] for x in found(store, spark)] == ["c"] * 2 and store.keys().count() == 3
    assert terms(store.remove(spark.createDataFrame([("c",)], "chunk_id string"))) == []
    with pytest.raises(Exception, match="a key is null"):
        store.add(frame(spark, [(None, "w1")]), toks=words_of("text"))


def test_changed_folder_is_seen(spark, tmp_path):
    path = f"file://{tmp_path}"
    docs = spark.createDataFrame([(i, f"the license {i}", "s") for i in range(9)], "doc_id long, text string, source string")
    docs.write.parquet(f"{path}/documents.parquet")
    assert retrieval.bm25_search(spark, path).count() == 9
    assert len({r.chunk_id for r in retrieval._store(spark, path).keys().select(F.col("key").alias("chunk_id")).collect()}) == 9
    docs.limit(4).cache().write.mode("overwrite").parquet(f"{path}/documents.parquet")
    assert retrieval.bm25_search(spark, path).count() == 4
    assert retrieval._store(spark, path).keys().count() == 4


def test_hybrid_lists_grow_until_exact(spark):
    docs = texts(200, 3)
    r = random.Random(4)
    vectors = [(k, [r.uniform(-1, 1) for _ in range(4)]) for k, _ in docs[:150]]
    queries = [(i, q, [r.uniform(-1, 1) for _ in range(4)] if i % 3 else None) for i, q in QUERIES]
    store = LexicalStore.create(spark, folder(spark), frame(spark, [(k, t.replace("w", "ww")) for k, t in docs]))
    asked = spark.createDataFrame([(i, q.replace("w", "ww"), v) for i, q, v in queries], "qid int, query string, embedding array<double>")
    report = {}
    got = hybrid_top_k(store, spark.createDataFrame(vectors, "chunk_id string, embedding array<double>"), asked, 5, first=6, report=report)
    words = {(q, k): b for q, k, b, _ in plain(docs, [(i, q) for i, q, _ in queries], 10**6)}
    want = []
    for i, _, v in queries:
        near = {k: round(sum(a * b for a, b in zip(v, e, strict=True)), 6) for k, e in vectors} if v else {}
        keys = set(near) | {k for q, k in words if q == i}
        scored = sorted((-round(0.7 * near.get(k, 0.0) + (1 - 0.7) * words.get((i, k), 0.0), 7), k) for k in keys)[:5]
        want += [(i, k, n) for n, (_, k) in enumerate(scored, 1)]
    assert sorted((x.qid, x.chunk_id, x["rank"]) for x in got.collect()) == sorted(want)
    assert report["rounds"] > 1
