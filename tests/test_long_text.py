import os
import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators.chunking import _content_parts, _cut_at, chunk_markdown, estimate
from lexmill.operators.long_text import blocks_by_range, chunk_documents, chunk_long
from lexmill.operators.ordered import RANGE
from lexmill.plans.text import chunk_by_lines, chunk_pipeline

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PIECES = ["# One", "## Two", "### Three", "#### Four", "###### Six", "#no header", "```", "~~~", "```x```", "", "  ", "- item", "| a | b |", "|---|---|", "| c | d |", " padded text ", "\tTab ", "* [x](#y)", "***"]


def _text(rng, n):
    return "\n".join(rng.choice(PIECES) if rng.random() < 0.6 else " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 40))) for _ in range(n))


@pytest.fixture
def narrow(spark):
    """Many ranges even for small inputs."""
    keys = {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_ranges_equal_the_kernel(narrow):
    rng = random.Random(5)
    rows = [(i % 40, _text(rng, rng.choice([1, 3, 20, 80]))) for i in range(60)]
    rows += [(50, None), (51, ""), (52, " \n \n"), (53, "```\n" + "# inside\n" * 400), (54, "# a\n" * 300), (55, rows[0][1]), (0, rows[0][1]), (0, rows[0][1]), (56, _text(rng, 2000)), (57, "word " * 3000)]
    rows.append((58, "~~~ a\n" + "\n".join(f"```\n# t{i}\nx\n~~~\n## real {i}\ntext {i} and more words to keep" for i in range(150))))
    docs = narrow.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("chunk", F.lit(1))
    for stage in ("blocks", "merge", "split"):
        want, got = chunk_markdown(docs, stage=stage), chunk_long(docs, stage=stage)
        assert got.schema.simpleString() == want.schema.simpleString()
        assert _rows(got) == _rows(want), stage
    assert _rows(chunk_documents(docs, long_from=500)) == _rows(chunk_markdown(docs))
    assert chunk_long(docs.limit(0)).collect() == []


def test_one_text_is_dealt_to_many_tasks(narrow, monkeypatch):
    """No range of lines holds more than a small part of a text that is nearly the whole table."""
    import lexmill.operators.long_text as module

    seen = {}
    keep = module.staged
    monkeypatch.setattr(module, "discard", lambda *_: None)
    monkeypatch.setattr(module, "staged", lambda df, name: seen.setdefault(name, keep(df, name)))
    rng = random.Random(6)
    docs = narrow.createDataFrame([(1, _text(rng, 20000)), (2, "# x\nshort text of some words")], "doc_id long, text string")
    blocks_by_range(docs)
    counts = [r["count"] for r in seen["walked"].where("kind = 0").groupBy(RANGE).count().collect()]
    assert len(counts) == 13 and max(counts) < 20002 / 5


def _plain_parts(text, most):
    """Parts by the rules, each step on what is left as a text of its own."""
    out = []
    while estimate(text) > most:
        cut = 0
        for share in (0.75, 0.5):
            cut = _cut_at(text, 0, len(text), estimate(text), int(most * share))
            if 0 < cut < len(text) and text[:cut].strip() and estimate(text[:cut].strip()) <= most:
                break
            cut = 0
        if not cut:
            cut = max(1, int(len(text) * most * 0.75 / estimate(text)))
            space = text.rfind(" ", max(1, cut - 100), cut)
            cut = space if space > 0 else cut
        if text[:cut].strip():
            out.append(text[:cut].strip())
        text = text[cut:].strip()
    return [*out, text] if text else out


def test_parts_equal_the_plain_rules():
    rng = random.Random(7)
    texts = [_text(rng, n) for n in (5, 50, 300) for _ in range(30)] + ["x" * 5000, " a" * 3000 + "\n\n", "ab c\n" * 900, "\n\n  " + "y" * 2000 + "\n" + "z " * 900, "", " " * 4000]
    for text in texts:
        for most in (20, 180):
            assert _content_parts(text, most) == _plain_parts(text, most)


def test_whole_tables_equal_the_kernel(spark):
    assert _rows(chunk_by_lines(spark, SF)) == _rows(chunk_pipeline(spark, SF))


def test_short_texts_are_not_cut_into_lines(spark, monkeypatch):
    """Only texts that fill a range go by lines; the rows are those of the whole texts wherever that begins."""
    from lexmill.operators import long_text

    given, cut = [], long_text.chunk_long

    def spy(docs, id_col="doc_id", text_col="text", *args):
        given.append(docs.select(F.min(F.length(text_col))).first()[0])
        return cut(docs, id_col, text_col, *args)

    monkeypatch.setattr(long_text, "chunk_long", spy)
    want = sorted(map(tuple, chunk_pipeline(spark, SF).collect()))
    for least in (4 << 10, 1 << 30):
        monkeypatch.setattr(long_text, "RANGE_FROM", least, raising=False)
        given.clear()
        assert sorted(map(tuple, chunk_by_lines(spark, SF).collect())) == want
        assert given and all(n is None or n >= least for n in given) and any(given) == (least < 1 << 30)
