import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import common
from lexmill.llm.suffix_dedup import anchor_runs, repeated_spans, window_hashes


def brute(datas, size):
    starts = {}
    for i, d in enumerate(datas):
        for p in range(len(d) - size + 1):
            starts.setdefault(d[p : p + size], []).append((i, p))
    cover = [np.zeros(len(d), bool) for d in datas]
    for at in starts.values():
        if len(at) > 1:
            for i, p in at:
                cover[i][p : p + size] = True
    out = []
    for d, c in zip(datas, cover, strict=True):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], c.astype(int), [0]]))).tolist()
        out.append((list(zip(edge[::2], edge[1::2], strict=True)), bytes(b for b, x in zip(d, c, strict=True) if not x)))
    return out


def make_texts(seed):
    rng = random.Random(seed)
    words = ["the", "of", "straße", "é", "漢字", "😀", "alpha", "beta", "\n", "x"] + [f"w{i}" for i in range(50)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [prose(60) for _ in range(4)]
    texts = [None, "", "short", "a" * 500, "ab" * 300, "a" * 199, "é" * 150]
    for _ in range(50):
        parts = [prose(rng.randrange(0, 80))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            cut = rng.randrange(len(p))
            parts += [rng.choice([p, p[cut:], p[:cut]]), prose(rng.randrange(0, 40))]
        texts.append(" ".join(parts))
    texts += [texts[12], texts[12], texts[13][:150] + "CHANGED" + texts[13][150:]]
    return texts


@pytest.mark.parametrize(("seed", "size", "group", "hot"), [(1, 200, 2048, 1000), (2, 64, 2048, 1), (3, 64, 1, 1000), (4, 100, 2, 1)])
def test_against_brute_force(spark, monkeypatch, seed, size, group, hot):
    """group: pieces of a key before it is dealt by further columns; hot: rows of a value before they are told apart."""
    monkeypatch.setattr(common, "HOT_LEAST", hot)
    texts = make_texts(seed)
    rows = [(i, t) for i, t in enumerate(texts)] + [(9, texts[9]), (None, texts[10]), (None, "q" * 300), (5, "same id, other text " * 20)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, key int").withColumn("kept_bytes", F.lit("clash"))
    got = repeated_spans(docs, min_bytes=size, group=group)
    assert [c for c in got.columns if c not in ("removed_spans", "kept_bytes", "text_bytes")] == ["doc_id", "text", "key"]
    have = sorted((str(r.doc_id), r.text or "", r.text_bytes, [tuple(s) for s in r.removed_spans], bytes(r.kept_bytes)) for r in got.collect())
    want = sorted((str(i), t or "", len((t or "").encode()), s, k) for (i, t), (s, k) in zip(rows, brute([(t or "").encode() for _, t in rows], size), strict=True))
    assert have == want


def test_runs_cover_every_window():
    rng = random.Random(4)
    datas = [bytes(rng.choice(b"abc") for _ in range(n)) for n in (0, 10, 200, 201, 900)]
    d, s, n, at, _ = anchor_runs(np.frombuffer(b"".join(datas), np.uint8), np.array([len(x) for x in datas]), 200)
    got = sorted((i, w) for i, a, c in zip(d, s, n, strict=True) for w in range(a, a + c))
    assert got == [(i, w) for i, x in enumerate(datas) for w in range(len(x) - 199)]
    assert ((at >= s + n - 1) & (at <= s + 168)).all()


def test_hashes_depend_on_content_only():
    data = np.frombuffer(b"abcdefghij" * 30, np.uint8)
    for width in (1, 5, 32, 64, 200):
        h = window_hashes(data, width)
        assert len(h) == len(data) - width + 1 and len(set(h.tolist())) == 10


def test_empty(spark):
    assert repeated_spans(spark.createDataFrame([], "doc_id long, text string")).collect() == []
