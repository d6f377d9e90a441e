import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from lexmill.llm.components import connected_components
from lexmill.llm.simhash import ball_links, fingerprint, keep_one_per_group, simhash_groups


def brute_fingerprint(text, width=3):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(ids, prints, radius=2):
    root = {i: i for i in range(len(ids))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(ids)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(ids))]


@pytest.mark.parametrize("text", ["", " \t\n", "one", "One two", "ÀB Cd  ef\x0bGH ij kl", "a b c d e", "x " * 500, "the cat sat on the mat " * 3])
def test_fingerprint(text):
    assert fingerprint(text.encode(), 3) == brute_fingerprint(text)


def test_groups_against_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(160):
        if i % 4 == 3:
            text = rows[rng.randrange(len(rows))][1] or ""
            parts = text.split()
            if parts and i % 8 == 7:
                parts[rng.randrange(len(parts))] = "changed"
            text = " ".join(parts)
        else:
            text = " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 5, 40, 120])))
        rows.append((i * 3, text if i % 40 else None))
    rows.append(rows[7])
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1))
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash_groups(docs).collect())
    prints = [brute_fingerprint(t) for _, t in rows]
    want = sorted((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, brute_components([i for i, _ in rows], prints), strict=True))
    assert got == want
    kept = keep_one_per_group(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in want}


def test_ball_reaches_every_pair(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = sorted({b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(6)} | set(base))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = ball_links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    roots = {r.node: r.root for r in connected_components(links).collect()}
    got = [roots.get(p, p) for p in signed]
    assert len(set(got)) == len(set(brute_components(signed, prints)))


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.root for r in connected_components(links).collect()} == {0}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_groups(docs).collect() == []
    with pytest.raises(ValueError):
        ball_links(docs.selectExpr("doc_id fp"), 3)


def test_long_text_by_blocks_of_shingles(monkeypatch):
    from lexmill.llm import simhash

    data = " ".join(f"w{i * i % 1009}" for i in range(5000)).encode()
    whole = simhash.fingerprint(data, 3)
    monkeypatch.setattr(simhash, "SHINGLES", 7)
    assert simhash.fingerprint(data, 3) == whole and simhash.fingerprint(b"a b", 3) == simhash.fingerprint(b"A  b", 3)
