"""The registered queries against plain readings of their contracts, over whole small tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from lexmill.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(frame):
    got = frame.collect()
    out = {r[0]: r for r in got}
    assert len(out) == len(got)
    return out


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_op1(spark, docs):
    datas = {i: t.encode() for i, t in docs.items()}
    count = Counter(xxhash.xxh3_128_digest(d[p : p + 200]) for d in datas.values() for p in range(len(d) - 199))
    got = rows(queries.op1_suffix_dedup(spark, SF))
    assert got.keys() == datas.keys()
    for i, d in datas.items():
        gone = np.zeros(len(d) + 1, int)
        for p in range(len(d) - 199):
            if count[xxhash.xxh3_128_digest(d[p : p + 200])] > 1:
                gone[p] += 1
                gone[p + 200] -= 1
        gone = np.cumsum(gone)[: len(d)] > 0
        spans = np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1)
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(d), gone.sum(), spans)
        assert r.kept_sha256 == sha(bytes(b for b, x in zip(d, gone.tolist(), strict=True) if not x))


def test_op2(spark, docs):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.no_truncation()
    tok.no_padding()
    got = rows(queries.op2_bpe(spark, SF))
    assert got.keys() == docs.keys()
    for i, t in docs.items():
        ids = tok.encode(t, add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()))
        assert got[i].decoded_sha256 == sha(tok.decode(ids, skip_special_tokens=False).encode())


def test_op5(spark, docs):
    prints = {}
    for i, t in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0
    root = {i: i for i in docs}
    changed = True
    while changed:
        changed = False
        for i in docs:
            least = min(root[j] for j in docs if (prints[i] ^ prints[j]).bit_count() <= 2)
            changed |= least != root[i]
            root[i] = least
    got = rows(queries.op5_simhash(spark, SF))
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{prints[i]:016x}", root[i]) for i in docs}


def test_op9(spark, docs):
    got = rows(queries.op9_quality_rules(spark, SF))
    assert got.keys() == docs.keys()
    for i, t in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        five = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        marked = {k + j for k in range(len(words) - 4) if five[tuple(words[k : k + 5])] > 1 for j in range(5)}
        want = (len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)
    assert any(r.kept for r in got.values())


def test_op10(spark, docs):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.no_truncation()
    tok.no_padding()
    got, start = rows(queries.op10_token_files(spark, SF)), 0
    assert got.keys() == docs.keys()
    for i in sorted(docs):
        ids = [*tok.encode(docs[i], add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op3_and_op7_cover_whole_tables(spark, docs):
    found = queries.op3_decontaminate(spark, SF).collect()
    items = {r.item_id: " ".join((r.text or "").lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    held = {(i, j) for i, t in docs.items() for j, p in items.items() if p and p in " ".join(t.lower().split())}
    assert held and held <= {(r.doc_id, r.item_id) for r in found}
    got = rows(queries.op7_toxicity(spark, SF))
    assert got.keys() == docs.keys() and all(r.toxic == (r.p_toxic >= 0.4) for r in got.values())


def test_every_query_is_registered(spark):
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 11)] + ["pipeline"]
    assert queries.oracle_sql().keys() <= queries.queries().keys()
