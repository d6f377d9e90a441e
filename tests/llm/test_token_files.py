import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexmill.llm import token_files, word_cache
from lexmill.llm.token_files import EliasFano, ShardReader, ef_encode, encode_texts, token_file_index, write_token_files
from lexmill.llm.word_cache import PieceTable

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(PATH)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=600), st.integers(0, 600), st.integers(0, 600))
def test_elias_fano(values, first, count):
    values = sorted(values)
    code = EliasFano.of(ef_encode(np.array(values, np.uint64)))
    first = min(first, len(values))
    assert code.slice(first, count).tolist() == values[first : first + count]
    for i in range(0, len(values), 97):
        assert code.select(i) == values[i]


def test_space_is_near_minimal():
    ends = np.cumsum(np.random.default_rng(0).integers(1, 2000, 100_000))
    assert 8 * len(ef_encode(ends)) / len(ends) < 2.6 + np.log2(ends[-1] / len(ends))


LEAD, REST = PieceTable(PATH, "<u2"), PieceTable(PATH, "<u2", True)
PARTS = st.sampled_from(["the", "Ça", "×", "÷", "é", "ÿ", "ı", "ĳ", "漢字", "’", "”", "«", "'s", "12", "<|endoftext|>", "<|endoftext", "|>", ".", "...", ",", "###", "\n", "\t", "\x1c", "\xa0", "\u3000", " ", " ", " ", "  ", "e\u0301", "😀", "\x00"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | st.lists(PARTS, max_size=12).map("".join) | st.text(max_size=8), max_size=8), st.sampled_from([pa.string(), pa.large_string()]), st.integers(0, 2))
def test_texts_encode_as_the_library_does(texts, kind, first):
    got = encode_texts(pa.array(texts, kind).slice(first), LEAD, REST)
    assert got == [np.array(TOK.encode(t or "", add_special_tokens=False).ids, "<u2").tobytes() for t in texts[first:]]


def test_a_word_is_tokenized_once_whatever_signs_follow():
    table, words, calls = PieceTable(PATH, "<u2", True), [f"{a}{b}" for a in ("Über", "stein", "lang") for b in "abcdefgh"], []

    class Counted:
        def tokenize(self, text):
            calls.append(text)
            return TOK.model.tokenize(text)

    table.model = Counted()
    text = " ".join(f"x {w} {w}, {w}. {w}!? {w}###" for w in words)
    assert encode_texts(pa.array([text] * 3), LEAD, table) == [np.array(TOK.encode(text, add_special_tokens=False).ids, "<u2").tobytes()] * 3
    assert len(calls) == len(set(calls)) == len(words) + 5  # x behind a space and four kinds of signs are the rest
    assert len(table.ids) == len(words) + 1


def test_runs_of_signs_do_not_pile_up(monkeypatch):
    monkeypatch.setattr(word_cache, "SIGN_ENTRIES", 20)
    table = PieceTable(PATH, "<u2", True)
    text = " ".join(f"ab{a}{b}{c}" for a in ".,;:" for b in "!?#*" for c in "$%&|")
    assert encode_texts(pa.array([text]), LEAD, table) == [np.array(TOK.encode(text, add_special_tokens=False).ids, "<u2").tobytes()]
    assert len(table.trails) <= 20 and len(table.ids) == 1


def test_files(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    parts = ["the", " the", "  ", "\n", " \n x", "é", "漢字", "'s", "12", "<|endoftext|>", "  a", "　", " ’q", "\x1c ", "😀"]
    texts = [None, "", " ", "a ", " a", "a  b", "\n a", *parts] + ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(300))) for _ in range(60)]
    rows = [(7 * i - 50, t) for i, t in enumerate(texts)] + [(-50, None), (None, "null id"), (27, "again"), *[(None, f"no id {i}") for i in range(40)]]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, start string")
    got = [tuple(r) for r in token_file_index(docs, PATH, f"file://{tmp_path}/a").orderBy("start").collect()]
    want, start = [], 0
    hashed = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]])):
        ids = [*TOK.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert len({s for s, *_ in write_token_files(docs.where("doc_id is null"), PATH, f"file://{tmp_path}/n")}) > 1  # rows without an id are dealt too
    monkeypatch.setattr(token_files, "READ_IDS", 5)
    again = token_files.read_token_files(spark, write_token_files(docs, PATH, f"file://{tmp_path}/d"))
    assert [tuple(r) for r in again.orderBy("start").collect()] == want
    short = token_file_index(docs.select(F.col("doc_id").cast("smallint"), "text"), PATH, f"file://{tmp_path}/e")
    assert short.schema["doc_id"].dataType.simpleString() == "smallint" and short.count() == len(rows)
    with pytest.raises(TypeError):
        token_file_index(docs.select(F.col("doc_id").cast("string"), "text"), PATH)
    shards = write_token_files(docs, PATH, f"file://{tmp_path}/b")
    assert sum(s[1] for s in shards) == len(rows)
    reader = ShardReader(shards[-1][0])
    assert reader.read(*reader.bounds(reader.n_docs - 1, 1)).tolist() == [*TOK.encode(sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] or ""))[-1][1] or "", add_special_tokens=False).ids, 2]
    assert token_file_index(docs.limit(0), PATH, f"file://{tmp_path}/c").collect() == []
