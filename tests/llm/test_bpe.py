import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexmill.llm.bpe import bpe_encode, encode_leaf, join_all, leaf_cuts

PATH = public_tokenizers.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)
PARTS = ["a", "the", "ing", "Straße", "é", "é", "漢字", "😀", "'s", "'", "!!", "12", " ", "\n", " ", "<|endoftext|>", "x" * 40, "don't", "ẛ̣", "İ", "ΟΔΟΣ", "\x1c", "\x85"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=120), st.integers(3, 40))
def test_tree_equals_whole(parts, leaf):
    text = "".join(parts)
    cuts = leaf_cuts(len(text), leaf)
    bounds = [0, *cuts, len(text)]
    leaves = [encode_leaf(PATH, text[s:e]) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
    assert join_all(PATH, text, cuts, leaves)[0].tolist() == TOK.encode(text, add_special_tokens=False).ids


def test_long_unsplit_text():
    rng = random.Random(5)
    text = "".join(rng.choice("aeioulstrnméß") for _ in range(30000))
    cuts = leaf_cuts(len(text), 1000)
    bounds = [0, *cuts, len(text)]
    leaves = [encode_leaf(PATH, text[s:e]) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
    assert join_all(PATH, text, cuts, leaves)[0].tolist() == TOK.encode(text, add_special_tokens=False).ids


def test_operator(spark):
    rng = random.Random(6)
    texts = [None, "", " ", "　", "a \x1c b", *PARTS, " ".join(PARTS), "".join(PARTS * 30), "z" * 5000]
    texts += ["".join(rng.choice(PARTS) + rng.choice(["", " "]) for _ in range(rng.randrange(400))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "null id"), (len(texts) - 1, texts[-1]), (None, "y " * 3000), (None, "y " * 3000)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, ids string")
    got = sorted(((str(r.doc_id), list(r.ids), r.decoded) for r in bpe_encode(docs, PATH, leaf_chars=100).collect()))
    want = []
    for i, t in rows:
        ids = TOK.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), ids, TOK.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    assert bpe_encode(docs.limit(0), PATH).collect() == []


def test_other_kind_of_tokenizer(spark):
    with pytest.raises(Exception, match="white space"):
        bpe_encode(spark.createDataFrame([(1, "a")], "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json")).collect()
