import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import decontaminate
from lexmill.llm.decontaminate import _codes, align, drop_contaminated, find_contamination, find_passages, index_items, normalise


def best_match(pattern, text):
    """Least edits of the pattern against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=14), st.text("abc", max_size=30), st.integers(0, 14))
def test_alignment_within_the_band(pattern, text, budget):
    want = best_match(pattern, text)
    got = align(_codes(pattern), _codes(text), budget)
    assert (got is None) == (want > budget)
    if got:
        assert got[0] == want and best_match(pattern, text[got[1] : got[2]]) == want


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice([[], ["z"], [out[at], "y"]])
    return "".join(out)


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    words = ["the", "of", "straße", "漢字", "and", "tion"] + [f"w{i}" for i in range(40)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, prose(rng.randrange(6, 40))) for i in range(12)] + [(20, None), (21, ""), (22, "W1  W2"), (23, "zq"), (24, prose(3)), (24, "unmatched text here")]
    rows = [(1, None), (2, ""), (3, "xx ZQ yy")]
    for i in range(60):
        parts = [prose(rng.randrange(30))]
        if i % 3:
            text = normalise(rng.choice(items[:12])[1])
            parts.append(edited(rng, text, rng.choice([0, 1, len(text) // 20, len(text) // 10, len(text) // 6, len(text) // 3])).upper())
        parts.append(prose(rng.randrange(30)))
        rows.append((10 + i, "\n ".join(parts)))
    rows += [(10, rows[5][1]), (None, items[0][1])]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")

    def budget(m):
        return int(0.1 * m)

    want = sorted(
        (str(d), j, e) for d, t in rows for j, p in items if p for e in [best_match(normalise(p), normalise(t or ""))] if e <= budget(len(normalise(p)))
    )
    for size, step in ((decontaminate.BLOCK_CHARS, decontaminate.STEP_PLACES), (decontaminate.BLOCK_CHARS, 7), (300, 100)):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", size)
        monkeypatch.setattr(decontaminate, "STEP_PLACES", step)
        got = find_contamination(docs, bench).collect()
        assert sorted((str(r.doc_id), r.item_id, r.edits) for r in got) == want
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(normalise(t or ""))
    for r in got:
        assert min(best_match(normalise(p), t[r.start : r.end]) for j, p in items if j == r.item_id and p for t in texts[r.doc_id]) == r.edits
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    bad = {d for d, _, _ in want}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in rows if str(i) not in bad)


def test_short_items_keep_their_share_of_edits():
    rng = random.Random(9)
    for m in range(1, 45):
        pattern = "".join(rng.choice("abcdef") for _ in range(m))
        docs = ["".join(rng.choice("abcdef") for _ in range(rng.randrange(60))) + edited(rng, pattern, n) + "xyz" for n in (0, m // 10, m // 10, m // 10 + 1) for _ in range(3)]
        got = {d: e for d, _, _, _, e in find_passages(docs, index_items([("i", pattern)], 8, 0.1))}
        assert got == {d: e for d, t in enumerate(docs) if (e := best_match(pattern, t)) <= m // 10}


def test_a_step_is_bounded_where_everything_is_shared():
    import tracemalloc

    rng = random.Random(10)
    words = ["of the", "and so", "in this", "that is"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    benches = index_items([(i, prose(12)) for i in range(400)], 8, 0.01)
    docs = [prose(400) + " " + benches[0].patterns[7]]
    tracemalloc.start()
    found = {j for _, j, *_ in find_passages(docs, benches)}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 7 in found and peak < 120 << 20


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("a", "one two three four"), ("b", None)], "doc_id string, text string")
    bench = spark.createDataFrame([(2.5, "ONE  two three"), (None, None)], "item_id double, text string")
    assert [(r.doc_id, r.item_id, r.start, r.end) for r in find_contamination(docs, bench).collect()] == [("a", 2.5, 0, 13)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert find_contamination(docs, bench).collect() == []
    assert find_contamination(docs.limit(0), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).collect() == []
    assert np.array_equal(_codes("aß"), [97, 223])
