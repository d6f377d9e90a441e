"""Mixing against a plain reading of the contract."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from lexmill.llm import queries
from lexmill.llm.source_mix import mix_sources

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(docs, share=1.5, epochs=2.0):
    """(doc_id, size, source_size, target, taken) by clamping until none is above, then by a walk through each source."""
    sized = [(i, s, len(WORD.findall(t or ""))) for i, t, s in docs]
    sources = sorted({s for _, s, _ in sized}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(sources)}
    size = Counter()
    for _, s, n in sized:
        size[s] += n
    total, capped = share * sum(size.values()), set()
    while True:
        rest = [s for s in sources if s not in capped]
        level = (total - sum(epochs * size[s] for s in capped)) / sum(weight[s] for s in rest)
        above = [s for s in rest if weight[s] * level > epochs * size[s]]
        if not above:
            break
        capped |= set(above)
    target = {s: epochs * size[s] if s in capped else weight[s] * level for s in sources}
    out, before = [], defaultdict(int)
    for i, s, n in sorted(sized, key=lambda r: (hashlib.md5(f"0 {'' if r[0] is None else r[0]}".encode()).hexdigest()[:16], r[0] is not None, r[0] or 0, r[2])):
        whole = int(target[s] // size[s]) if size[s] else 0
        more = n > 0 and before[s] + n / 2 <= target[s] - whole * size[s]
        before[s] += n
        out.append((i, n, size[s], target[s], (whole + more) * n))
    return sorted(out, key=str)


def got(frame):
    return sorted(((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in frame.collect()), key=str)


def test_query_equals_plain_reading(spark):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    out = got(queries.op13_source_mix(spark, "/root/testdata/sf0.001"))
    assert out == plain(docs)
    assert out == got(queries.op13_source_mix(spark, "/root/testdata/sf0.001"))
    assert all(taken <= 2 * n for _, n, _, _, taken in out)


def test_edges(spark):
    docs = [(i, "w " * (i % 50), "hot") for i in range(300)] + [(i, "a b c", s) for i, s in enumerate(["b", "é", "Z", "", None, None, "~", "="])] + [(None, "x y", "b"), (None, "x y", "b"), (None, None, "b"), (3, "\x1c  z\t\n", "nowords"), (4, " \t", "blank"), (5, "", "blank")]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, source string, key string, size int")
    out = got(mix_sources(frame.repartition(7)))
    assert out == plain(docs)
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in mix_sources(frame).collect():
        a = by[r.source]
        a[0], a[1], a[2] = a[0] + r.taken, r.target, max(a[2], r["size"])
    assert all(abs(taken - target) <= most / 2 for taken, target, most in by.values())


@pytest.mark.parametrize("share", [0.0, 2.0, 3.0])
def test_no_room_and_too_much_room(spark, share):
    frame = spark.createDataFrame([(1, "a b", "x"), (2, "c", "y"), (3, None, None)], "doc_id long, text string, source string")
    assert sorted(r.taken for r in mix_sources(frame, share=share).collect()) == ([0, 0, 0] if not share else [0, 2, 4])


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_sources(empty).collect() == []
    frame = spark.createDataFrame([(1, None, "x"), (2, "", None)], empty.schema)
    assert got(mix_sources(frame)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_native(spark):
    plan = mix_sources(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
