"""The best of many queries by vectors and words together, exact, from two ranked lists that grow until nothing unseen can matter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import tokens
from lexmill.storage import staged

from .lexical_store import NEAR, LexicalStore
from .vectors import dot, top_k_batch

#: Length of the two lists in the first round, and what it is multiplied by from round to round.
FIRST, GROWTH = 50, 4


def hybrid_top_k(store: LexicalStore, vectors: DataFrame, queries: DataFrame, k: int = 10, weight: float = 0.7, first: int = FIRST, report: dict | None = None) -> DataFrame:
    """(qid, chunk_id, semantic_score, bm25_score, hybrid_score, rank): the k best of the fusion of all documents, for every query.

    vectors: (chunk_id, embedding); queries: (qid, query, embedding). A leg that a document or a query lacks
    counts as 0; documents with neither leg are no results. Each round takes every open query's best by
    vector and by words and completes both scores of what either list names. A document in neither list
    scores at most what the lists' ends fuse to; queries whose k-th result is above that are done, the
    others go on with lists GROWTH times as long. So no query meets all documents' scores unless it has to.
    """
    vectors = vectors.select("chunk_id", "embedding")
    words = tokens(F.col("query"))
    open_, most, out, rounds = staged(queries.select("qid", "query", "embedding"), "queries"), first, None, 0
    while not open_.isEmpty():
        rounds += 1
        by_vector = staged(top_k_batch(vectors, open_, most), "by-vector")
        by_words = staged(store.search(open_, most, toks=words), "by-words")
        seen = staged(by_vector.select("qid", "chunk_id").unionByName(by_words.select("qid", F.col("key").alias("chunk_id"))).distinct(), "seen")
        near = seen.join(vectors, "chunk_id").join(open_.select("qid", F.col("embedding").alias("q")), "qid").where("q is not null")
        near = near.groupBy("qid", "chunk_id").agg(F.max(F.round(dot(F.col("embedding"), F.col("q")), 6)).alias("semantic_score"))
        asked = store._asked(open_, "qid", words)
        best = by_words.where("rank = 1").select("qid", F.col("raw").alias("best"))
        said = store.score_documents(asked, seen.withColumnRenamed("chunk_id", "key")).join(best, "qid")
        said = said.select("qid", F.col("key").alias("chunk_id"), F.round(F.col("raw") / F.when(F.col("best") > 0, F.col("best")).otherwise(1.0), 6).alias("bm25_score"))
        both = seen.join(near, ["qid", "chunk_id"], "left").join(said, ["qid", "chunk_id"], "left").fillna(0.0, ["semantic_score", "bm25_score"])
        fused = both.withColumn("hybrid_score", F.round(weight * F.col("semantic_score") + (1 - weight) * F.col("bm25_score"), 7))
        ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("hybrid_score"), "chunk_id"))).where(F.col("rank") <= k)
        ranked = staged(ranked.select("qid", "chunk_id", "semantic_score", "bm25_score", "hybrid_score", "rank"), "fused")

        def end(list_: DataFrame, score: str, name: str) -> DataFrame:
            """The list's last score where it is full; what is beyond a list that is not full has no such leg."""
            return list_.groupBy("qid").agg(F.when(F.count("*") >= most, F.greatest(F.lit(0.0), F.min(score))).alias(name))  # noqa: B023

        limits = open_.select("qid").join(end(by_vector, "score", "s"), "qid", "left").join(end(by_words, "bm25", "b"), "qid", "left").join(ranked.where(F.col("rank") == k).select("qid", F.col("hybrid_score").alias("kth")), "qid", "left")
        whole = F.col("s").isNull() & F.col("b").isNull()
        sure = F.col("kth") > weight * F.coalesce("s", F.lit(0.0)) + (1 - weight) * F.coalesce("b", F.lit(0.0)) + NEAR
        done = limits.where(whole | sure).select("qid")
        found = ranked.join(done, "qid", "left_semi")
        out = found if out is None else out.unionByName(found)
        open_, most = staged(open_.join(done, "qid", "left_anti"), "queries"), most * GROWTH
    if report is not None:
        report["rounds"] = rounds
    empty = f"qid {queries.schema['qid'].dataType.simpleString()}, chunk_id string, semantic_score double, bm25_score double, hybrid_score double, rank int"
    return queries.sparkSession.createDataFrame([], empty) if out is None else out
