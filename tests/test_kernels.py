"""Kernels and rules that SQL does not check: chunking, MMR, JSON repair, headings, budgets, streams."""

import json
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill import sources
from lexmill.operators import graph, planning, selection, structure
from lexmill.operators.chunking import chunk_markdown, estimate, header_blocks, make_chunks
from lexmill.operators.generation import repair_json
from lexmill.operators.selection import add_neighbours, mmr_order, select_diverse, select_representative
from lexmill.operators.vectors import top_k_batch
from lexmill.streaming import document_stream, ingest, tumbling_counts


def words(text):
    return text.split()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["# A", "## B", "### C", "word word word", "longer line with several words in it", "", "- item", "| a | b |", "```", "x" * 40]), max_size=60))
def test_every_word_is_kept_by_splitting(rows):
    text = "\n".join(rows)
    merged = make_chunks(text, 40, 8, "merge")
    split = make_chunks(text, 40, 8)
    table = any("|" in c.text for c in merged)
    if not table:
        assert [w for c in split for w in words(c.text)] == [w for c in merged for w in words(c.text)]


def test_one_long_line_ends():
    text = "word " * 6000
    parts = make_chunks(text)
    assert all(c.size <= 180 for c in parts) and sum(len(words(c.text)) for c in parts) == 6000
    assert all(c.size <= 180 for c in make_chunks("x" * 20000))


def test_table_split_repeats_the_head():
    text = "before\n| n | k |\n|---|---|\n" + "\n".join(f"| row {i} with some words | {i} |" for i in range(200)) + "\nafter the table"
    parts = make_chunks(text)
    assert len(parts) > 3 and all("| n | k |  \n|---|---|" in p.text for p in parts)
    assert parts[0].text.startswith("before") and parts[-1].text.endswith("after the table")
    assert sum(p.text.count("| row ") for p in parts) == 200
    assert [p.part for p in parts][-1] == f"{len(parts)}/{len(parts)}"


def test_nested_headers():
    blocks = header_blocks("# One\n\ntext\n## Two\n### Three\ndeep\n```\n# not a header\n\n```\n# Four\nlast")
    assert [list(b.path.values()) for b in blocks] == [["One"], ["One", "Two", "Three"], ["Four"]]
    assert "# not a header" in blocks[1].text
    merged = make_chunks("# One\n" + "text " * 40 + "\n## Two\ntiny words here\n## Three\n" + "more " * 60, 180, 30, "merge")
    assert len(merged) == 2 and "tiny words here" in merged[0].text


def test_stale_parent_case():
    """Merging at one level does not shift the parents of the next."""
    text = "\n".join([f"# a\n{'w ' * 90}", "## b\nsmall text b", "### c\nsmall text c", "### d\nsmall text d", f"# e\n{'w ' * 90}", "## f\nsmall text f"])
    merged = make_chunks(text, 180, 100, "merge")
    assert [c.path[1] for c in merged] == ["a", "e"] and "small text d" in merged[0].text and "small text f" in merged[1].text


def test_chunks_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "long enough to stay as it is")], "doc_id long, text string")
    assert [r.doc for r in chunk_markdown(docs).collect()] == ["4"]
    assert estimate("") == 0


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 12), st.integers(1, 15), st.integers(0, 99))
def test_mmr_against_the_plain_definition(n, rows, seed):
    rng = np.random.default_rng(seed)
    score, vectors = rng.random(rows).round(3), rng.random((rows, 4))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    chosen = []
    while len(chosen) < min(n, rows):
        gains = [(0.7 * score[i] - 0.3 * 5 * max((float(unit[i] @ unit[j]) for j in chosen), default=0), -i) for i in range(rows) if i not in chosen]
        chosen.append(-max(gains)[1])
    assert mmr_order(score, vectors, n) == chosen


def test_bounded_rounds_pick_as_the_whole_would(spark, monkeypatch):
    """Few candidates a round, many ties, more picks than rows in one document."""
    rng = np.random.default_rng(5)
    rows = [(d, f"{d}{i}", i, 10, float(rng.integers(0, 4)) / 4, rng.integers(0, 3, 3).astype(float).tolist()) for d, m in (("a", 60), ("b", 5), ("c", 25)) for i in range(m)]
    table = spark.createDataFrame(rows, "document_id string, chunk_id string, chunk_index long, token_count long, score double, embedding array<double>")
    monkeypatch.setattr(selection, "CANDIDATES", 6)
    got = select_diverse(table, 9).orderBy("document_id", "pick").collect()
    for d in "abc":
        mine = [r for r in rows if r[0] == d]
        order = mmr_order(np.array([r[4] for r in mine]), np.array([r[5] for r in mine]), 9)
        assert [r.chunk_index for r in got if r.document_id == d] == order


def test_bounded_rounds_with_vectors_that_point_away(spark, monkeypatch):
    """A row beyond the candidates of the first round gains by its distance from the first choice."""
    rng = np.random.default_rng(8)
    rows = [("a", f"a{i}", i, 10, float(s), v.tolist()) for i, (s, v) in enumerate(zip(rng.random(40).round(2), rng.standard_normal((40, 3)), strict=True))]
    table = spark.createDataFrame(rows, "document_id string, chunk_id string, chunk_index long, token_count long, score double, embedding array<double>")
    monkeypatch.setattr(selection, "CANDIDATES", 6)
    got = [r.chunk_index for r in select_diverse(table, 9).orderBy("pick").collect()]
    assert got == mmr_order(np.array([r[4] for r in rows]), np.array([r[5] for r in rows]), 9)


def test_many_headers_take_linear_time():
    text = "\n".join(f"{'#' * (1 + i % 6)} header {i}\nsome words of text below it" for i in range(20_000))
    began = time.time()
    assert make_chunks(text, 180, 12, "merge") and time.time() - began < 15


def test_selection_budgets(spark):
    rng = random.Random(1)
    rows = [(d, f"{d}_{i}", i, 50 + rng.randrange(900), f"{d}_s{i // 4}", float(rng.random()), [rng.random() for _ in range(4)]) for d in "ab" for i in range(25 if d == "a" else 3)]
    chunks = spark.createDataFrame(rows, "document_id string, chunk_id string, chunk_index long, token_count long, section_id string, score double, embedding array<double>")
    got = select_representative(chunks, 10).toPandas()
    assert got[got.document_id == "a"].token_count.sum() <= 3000 and len(got[got.document_id == "b"]) == 3
    picked = chunks.where("chunk_index in (1, 5)").withColumn("selection_method", F.lit("search"))
    free, tight = (add_neighbours(picked, chunks, budget=b).toPandas() for b in (None, 2500))
    assert set(tight.chunk_id) <= set(free.chunk_id) and free.chunk_id.is_unique
    for _, part in tight.groupby("document_id"):
        assert part.token_count.sum() <= max(2500, part[part.selection_method == "search"].token_count.sum())


@pytest.mark.parametrize(
    ("text", "want"),
    [(None, None), ("", None), ("none", None), ("[1, 2]", [1, 2]), ('{"a": 1}', {"a": 1}), ('x {"a": "}{", "b": [1,2,],} y', {"a": "}{", "b": [1, 2]}), ('[{"a": 1}, {"b": {"c": 2}}, {"d": "cut', [{"a": 1}, {"b": {"c": 2}}]), ('[{"a": 1}', [{"a": 1}]), ("[{bad}, {\"a\": 1}]", None)],
)
def test_json_repair(text, want):
    got = repair_json(text)
    assert (got and json.loads(got)) == want


def test_markdown_of_pages(spark):
    doc = '{"pages": [{"items": [{"type": "heading", "value": "Chapter 1", "bBox": {"h": 20}}, {"type": "text", "value": " hello "}, {"type": "heading", "value": "1.1 Part", "bBox": {"h": 15}}]}, {"items": [{"type": "table", "md": "| a |"}, {"type": "heading", "value": "ok"}]}]}'
    rows = spark.createDataFrame([("d", doc)], "doc string, j string").select("doc", F.from_json("j", sources.PAGE_JSON).alias("p")).select("doc", "p.pages")
    assert structure.build_markdown(structure.page_items(rows)).first().markdown == "# Chapter 1\nhello\n\n## 1.1 Part\n| a |\n\nok"


def test_points_add_up(spark):
    counts = spark.createDataFrame([(1, 3, 4, 3, 5, 5), (2, 1, 0, 0, 1, 0), (3, 10, 10, 10, 15, 15), (4, 1, 1, 1, 2, 2), (5, 0, 0, 0, 0, 0)], "plan_id long, easy long, medium long, hard long, single long, multiple long")
    plan = planning.build_plan(counts)
    order = "".join(r.difficulty[0] for r in plan.where("plan_id = 1").orderBy("pos").collect())
    assert order == "mehmehmehm"
    for weighted in (False, True):
        totals = planning.points(plan, F.lit(7.0), weighted=weighted).groupBy("plan_id").agg(F.round(F.sum("point"), 2).alias("t")).collect()
        assert {r.plan_id: r.t for r in totals} == {1: 7.0, 2: 7.0, 3: 7.0}
    assert {r.plan_id for r in planning.violations(counts, "plan_id").collect()} == {4, 5}


def test_read_only_sql(spark):
    table = spark.createDataFrame([(1,), (2,)], "dataset_offset long")
    assert graph.read_only_sql(spark, "select sum(dataset_offset) as s from t", t=table).first().s == 3
    for bad in ("drop view t", "create table x (a int)", "insert into t values (1)", "with x as (select 1 a) insert into t select a from x", "from t insert into u select *", "select 1; drop view t", "explain select 1", "cache table t"):
        with pytest.raises(ValueError, match="only queries"):
            graph.read_only_sql(spark, bad, t=table)


def test_batched_search_blocks(spark, monkeypatch):
    from lexmill.operators import vectors

    rng = np.random.default_rng(3)
    data = rng.random((60, 5))
    rows = [(f"k{i % 50}", [float(x) for x in v]) for i, v in enumerate(data)]
    table = spark.createDataFrame([*rows, ("null", None)], "chunk_id string, embedding array<float>")
    queries = spark.createDataFrame([(q, data[q].tolist()) for q in range(7)], "qid long, embedding array<double>")
    monkeypatch.setattr(vectors, "QUERY_BYTES", 80)
    got = {(r.qid, r.rank): r.chunk_id for r in top_k_batch(table, queries, 3).collect()}
    narrow = data.astype(np.float32).astype(float)
    for q in range(7):
        best = {}
        for i, v in enumerate(narrow):
            best[f"k{i % 50}"] = max(best.get(f"k{i % 50}", -9), round(float(v @ data[q]), 6))
        assert [got[q, k] for k in (1, 2, 3)] == [k for k, _ in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:3]]
    assert top_k_batch(table, queries.limit(0), 3).collect() == []


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello\nworld")
    assert sources.read_texts(spark, str(tmp_path / "a.txt")).first().content == "# Document Content\n\nhello\nworld"
    vectors = spark.createDataFrame([("a", [1.0, 2.0])], "chunk_id string, embedding array<float>")
    sources.write_vectors(vectors, str(tmp_path / "v"))
    assert sources.read_vectors(spark, str(tmp_path / "v"), 2).count() == 1
    assert sources.read_vectors(spark, str(tmp_path / "v"), 3).count() == 0
    assert sources.read_vectors(spark, str(tmp_path / "none"), 3).count() == 0


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (2, "only", 1)], "id long, text string, seq long")
    rows.write.parquet(str(tmp_path / "in"))
    query = ingest(document_stream(spark, str(tmp_path / "in"), "id long, text string, seq long"), str(tmp_path / "out"), str(tmp_path / "ck"), "id", "seq")
    query.awaitTermination(60)
    assert sorted((r.id, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "new"), (2, "only")]
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert tumbling_counts(events, "ts", "1 day", "event_type").agg(F.sum("n")).first()[0] == events.count()


def test_neighbours_of_every_chunk(spark):
    from lexmill.operators.graph import neighbours

    rows = [(f"c{i}", f"d{i % 2}", None if i % 17 == 0 else f"d{i % 2}s{i // 40 if i % 5 else i % 3}", i) for i in range(160)]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, section_id string, chunk_index long")
    for same in (True, False):
        want = {(a, b[0]) for a, d, s, _ in rows for b in [r for r in rows if s and r[2] and r[0] != a and r[1] == d and (r[2] == s) == same][:5]}
        got = neighbours(chunks, chunks, same)
        assert {(r.of, r.chunk_id) for r in got.collect()} == want
        assert "rn" in got._jdf.queryExecution().optimizedPlan().toString().split("Join")[-1]  # ranked before the join


def test_main_path(spark):
    from lexmill.operators.quiz import make_quiz

    part = "\n\n".join(f"## Part {i}\n\n" + " ".join(f"word{i}x{j % (7 + i)}" for j in range(60)) for i in range(12))
    rows = [(1, "# Title\n\n" + part), (2, None), (3, "too short"), (4, "A plain text of one paragraph that is just long enough to be taken."), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk_id", F.lit("clash"))
    counts = {"easy": 2, "medium": 1, "hard": 1, "single": 3, "multiple": 1}
    quiz = make_quiz(docs, counts, F.lit(10.0))
    got = quiz.questions.orderBy("document_id", "pos").collect()
    assert [(r.document_id, r.pos) for r in got] == [(d, i) for d in "14" for i in range(1, 5)]
    for d in "14":
        mine = [r for r in got if r.document_id == d]
        assert round(sum(r.point for r in mine), 6) == 10.0 and len({r.question for r in mine}) == 4
        picked = [r.chunk_id for r in quiz.selected.where(F.col("document_id") == d).orderBy("chunk_index").collect()]
        assert [r.chunk_id for r in mine] == [picked[min(i, len(picked) - 1)] for i in range(4)]
    assert sorted(r.difficulty for r in got if r.document_id == "1") == ["easy", "easy", "hard", "medium"]
    assert quiz.sections.where("document_id = '1'").count() > 1
    assert make_quiz(docs.limit(0), counts, F.lit(10.0)).questions.collect() == []


def test_adapter_asks_the_model(spark):
    from lexmill.operators.generation import Adapter

    rows = spark.createDataFrame([(1, "A passage.", "en", 0, ["old"], 2, "- Q1: easy", "right", ["a", "b"])], "id long, passage string, language string, index long, existing array<string>, n long, plan_lines string, correct string, candidates array<string>")
    adapter = Adapter(lambda prompts: [p.upper() for p in prompts], "id")
    for ask, word in ((adapter.multiple_choice, "AVOID:\n- OLD"), (adapter.batch, "WRITE 2 QUESTIONS"), (adapter.distractors, "CORRECT: RIGHT"), (adapter.short_answer, "SHORT-ANSWER"), (adapter.true_false, "TRUE OR FALSE")):
        row = ask(rows).first()
        assert row.id == 1 and word in row.output and "A PASSAGE." in row.output


def test_encode(spark):
    from lexmill.operators.vectors import encode, hashing_encoder

    rows = spark.createDataFrame([("a", "x y y"), ("b", None), ("c", "")], "k string, t string")
    got = {r.k: r.embedding for r in encode(rows, hashing_encoder(16), "k", F.col("t")).collect()}
    assert abs(sum(x * x for x in got["a"]) - 1) < 1e-12 and not any(got["b"]) and not any(got["c"]) and len(got["b"]) == 16
    assert encode(rows.limit(0), hashing_encoder(16), "k", F.col("t")).collect() == []


def test_batched_search_takes_bounded_memory(spark, monkeypatch):
    """The scores of a whole Arrow batch and all queries are never there at once, and many equal scores are no matter."""
    import tracemalloc

    from lexmill.operators import vectors

    rng = np.random.default_rng(6)
    rows = np.repeat(rng.standard_normal((50, 8)), 200, axis=0)
    ids, matrix = np.arange(2000), rng.standard_normal((2000, 8))
    taken = {}

    def here(table, queries, kernel, schema, qid):
        batch = pa.RecordBatch.from_pydict({"chunk_id": [f"k{i}" for i in range(len(rows))], "embedding": pa.array(list(rows))})
        tracemalloc.start()
        taken["rows"] = [x for found in kernel(iter([batch]), ids, matrix) for x in found.to_pylist()]
        taken["peak"] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return spark.createDataFrame([], schema)

    monkeypatch.setattr(vectors, "_every_block", here)
    top_k_batch(spark.createDataFrame([], "chunk_id string, embedding array<double>"), None, 3)
    assert taken["peak"] < 150e6 < 10_000 * 2000 * 8
    scores = np.round(rows @ matrix[7], 6)
    want = sorted((-x, f"k{i}") for i, x in enumerate(scores))[:3]
    assert sorted((-x["score"], x["chunk_id"]) for x in taken["rows"] if x["qid"] == 7) == want
