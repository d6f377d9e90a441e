import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lexmill.functions.text import tokens
from lexmill.operators.prompted import asked_prompts, judge_prompts, search_documents
from lexmill.operators.quiz import make_quiz
from lexmill.operators.vectors import hashing_encoder

COUNTS = {"easy": 2, "medium": 1, "hard": 1, "single": 3, "multiple": 1}
CHUNK = "document_id string, chunk_id string, chunk_index long, token_count long, section_id string, text string"


def _chunks(spark):
    rows = []
    for d, n in (("a", 9), ("b", 7), ("c", 2), ("q", 5)):
        for i in range(n):
            text = " ".join(f"w{d}{i}x{j % (3 + i % 4)} common{j % 2}" for j in range(12)) + (" Rare" if i == 4 else "")
            rows.append((d, f"{d}{i}", i, 20, f"{d}s{i // 3}", text))
    rows.append(("a", "a9", 9, 20, "as3", ""))
    encoder = hashing_encoder(16)
    words = {t: w for t, w in spark.createDataFrame([(r[5],) for r in rows], "text string").distinct().select("text", tokens(F.col("text"))).collect()}
    vectors = encoder([" ".join(words[r[5]]) for r in rows])
    table = spark.createDataFrame([(*r, v.tolist()) for r, v in zip(rows, vectors, strict=True)], CHUNK + ", embedding array<double>")
    return rows, words, encoder, table


def _model(rows, words, encoder, prompt_words, doc):
    """Best chunks of a document by a loop over its chunks."""
    mine = [r for r in rows if r[0] == doc]
    lists = [words[r[5]] for r in mine]
    mean_length = sum(map(len, lists)) / len(mine)
    df = Counter(t for x in lists for t in set(x))
    raw = {t: math.log(len(mine) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: 0.25 * mean if x < 0 else x for t, x in raw.items()}
    wanted = encoder([" ".join(prompt_words)])[0]
    lexical = []
    for x in lists:
        tf = Counter(x)
        lexical.append(sum(idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(x) / mean_length)) for t in prompt_words if tf[t]))
    best = max(lexical)
    scores = []
    for r, x in zip(mine, lexical, strict=True):
        semantic = float(encoder([" ".join(words[r[5]])])[0] @ wanted)
        scores.append((-round(0.7 * round(semantic, 6) + 0.3 * round(x / (best if best > 0 else 1), 6), 7), r[1], r[5]))
    return sorted(scores)


def test_search_and_judgement_equal_a_plain_model(spark):
    rows, words, encoder, table = _chunks(spark)
    prompts = [("a", "wa4x1 rare rare common0"), ("a", None), ("b", "  "), ("c", "nothing of the kind"), ("c", "zzz"), ("gone", "x y"), ("q", "!")]
    asked = asked_prompts(spark.createDataFrame(prompts, "document_id string, prompt string"))
    wish = {r.document_id: r.prompt for r in asked.collect()}
    assert wish == {"a": "wa4x1 rare rare common0", "c": "nothing of the kind", "gone": "x y", "q": "!"}
    found = search_documents(asked, table, 6, encoder).cache()
    got = {}
    for r in found.orderBy("document_id", "rank").collect():
        got.setdefault(r.document_id, []).append((r.chunk_id, r.score))
    assert set(got) == {"a", "c", "q"} and len(got["a"]) == 6 and got["a"][0][0] == "a4"
    prompt_words = {"a": ["wa4x1", "rare", "rare", "common0"], "c": ["nothing", "of", "the", "kind"], "q": []}
    judged = {r.document_id: r for r in judge_prompts(asked, found, table, encoder).collect()}
    for doc in got:
        best = _model(rows, words, encoder, prompt_words[doc], doc)[:6]
        assert [c for c, _ in got[doc]] == [c for _, c, _ in best]
        scores = [-s for s, _, _ in best]
        assert np.allclose([s for _, s in got[doc]], scores, atol=2e-6)
        part = scores[0] * (0.8 if np.var(scores[:5]) > 0.15 else 1)
        first = "\n".join(r[5] for r in rows if r[0] == doc and r[2] < 3)[:1000]
        over = encoder([" ".join(spark.createDataFrame([(first,)], "t string").select(tokens(F.col("t")).alias("w")).first().w)])[0]
        parts = [(part, 0.4), (float(over @ encoder([" ".join(prompt_words[doc])])[0]), 0.3)]
        asked_words, seen = set(wish[doc].lower().split()), set(" ".join(t for _, _, t in best[:3]).lower().split())
        parts.append((len(asked_words & seen) / len(asked_words), 0.15))
        if len(scores) >= 5:
            parts.append((min(1.0, 3 * (scores[0] - np.mean(scores[1:5]))), 0.15))
        value = sum(p * w for p, w in parts) / sum(w for _, w in parts)
        assert abs(judged[doc].relevance - max(0.0, min(1.0, value))) < 1e-5
        strategy = "search" if value >= 0.65 and scores[0] >= 0.4 else "hybrid" if value >= 0.35 else "representative"
        assert judged[doc].strategy == strategy and judged[doc].is_relevant == (strategy != "representative") and (judged[doc].warning is None) == (strategy == "search")
    assert judged["a"].strategy != "representative" and judged["c"].strategy == "representative"
    assert search_documents(asked.limit(0), table, 6, encoder).collect() == [] and search_documents(asked, table.limit(0), 6, encoder).collect() == []


def test_main_path_takes_prompts(spark):
    part = lambda d: "\n\n".join(f"## Part {i}\n\n" + " ".join(f"word{d}{i}x{j % (7 + i)}" for j in range(60)) for i in range(12))
    docs = spark.createDataFrame([(d, "# Title\n\n" + part(d)) for d in (1, 2, 3)] + [(4, None)], "doc_id long, text string").withColumn("prompt", F.lit("clash"))
    prompts = spark.createDataFrame([(1, " ".join(f"word15x{j}" for j in range(7))), (2, "unrelated things"), (3, None), (4, "x"), (9, "x")], "doc_id long, prompt string")
    quiz = make_quiz(docs, COUNTS, F.lit(10.0), prompts=prompts)
    judged = {r.document_id: r.strategy for r in quiz.relevance.collect()}
    assert judged["1"] in ("search", "hybrid") and judged["2"] == "representative" and set(judged) == {"1", "2"}
    picked = {}
    for r in quiz.selected.collect():
        picked.setdefault(r.document_id, set()).add(r.selection_method)
    assert "search" in picked["1"] and picked["2"] == {"representative_fallback"} and "representative" in picked["3"] and set(picked) == {"1", "2", "3"}
    best = quiz.selected.where("document_id = '1' and selection_method = 'search'").orderBy(F.desc("score")).first()
    assert "word15x0" in quiz.chunks.where(F.col("chunk_id") == best.chunk_id).first().text
    assert quiz.questions.groupBy("document_id").count().where("count = 4").count() == 3
    plain = make_quiz(docs, COUNTS, F.lit(10.0))
    assert plain.relevance is None
    assert plain.selected.where("document_id = '3'").select("chunk_id").exceptAll(quiz.selected.where("document_id = '3'").select("chunk_id")).count() == 0


def test_scores_of_many_documents_store_no_postings(spark, monkeypatch):
    """Terms of a chunk meet where the chunk is; repeated asked words count again, chunks without them give no row."""
    from lexmill.operators import search

    monkeypatch.delattr(search, "staged")
    chunks = spark.createDataFrame([("a", "a0", "red red fox"), ("a", "a1", "blue fox"), ("a", "a2", "green owl"), ("a", "a3", None), ("a", "a4", "grey owl"), ("b", "b0", "red owl")], "document_id string, chunk_id string, text string")
    asked = spark.createDataFrame([("a", ["red", "red", "fox", "none"]), ("c", ["red"])], "document_id string, terms array<string>")
    got = {r.chunk_id: r.bm25 for r in search.bm25_each(chunks, asked, ["document_id"]).collect()}
    assert got["a0"] == 1.0 and 0 < got["a1"] < 1 and set(got) == {"a0", "a1"}
