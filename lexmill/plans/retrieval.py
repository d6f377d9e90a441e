"""Queries on vectors, lexical and hybrid search, relevance, selection and retrieval measures."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions.text import raw_tokens, tokens
from lexmill.operators import search as S
from lexmill.operators import selection as L
from lexmill.operators import vectors as V
from lexmill.operators.cache import newest
from lexmill.operators.lexical_store import LexicalStore
from lexmill.operators.shard_search import LAYOUT, ShardIndex
from lexmill.operators.vector_index import VectorIndex
from lexmill.storage import exists, listed, shared_dir, staged

from . import fixtures as X

c = F.col
W = X.with_views
#: Query terms of the lexical tests: frequent, rarer and repeated ones, and one that occurs nowhere.
TERMS = ["the", "and", "license", "the", "idiot", "nowhereatall"]
K = 10


def _q0(s, sf):
    return list(map(float, X.table(s, sf, "embeddings").where("vec_id = 0").first().embedding))


_INDEXES: dict[tuple, S.LexicalIndex] = {}


def _stamp(s, sf) -> tuple:
    """What tells one state of the documents from another: the path with its files' names, lengths and times."""
    path = f"{sf}/documents.parquet"
    return (path, *listed(s, path))


def _index(s, sf, kind="docs", fresh=False):
    """The stored index of a session and state of the documents: built by the first query that searches it, as a search service would before it opens."""
    name = (s.sparkContext.applicationId, _stamp(s, sf), kind)
    if fresh or name not in _INDEXES:
        if kind == "scope":
            _INDEXES[name] = S.lexical_index(X.chunks(s, sf).withColumn("text", F.substring("text", 1, 500)), scope=["document_id"])
        else:
            _INDEXES[name] = S.lexical_index(_docs(s, sf), toks=raw_tokens(c("text")) if kind == "raw" else None)
    return _INDEXES[name]


def _store(s, sf) -> ShardIndex:
    """The index of the documents in the shared folder, by their state; a session that finds none builds it."""
    path = f"{shared_dir(s)}/index-{LAYOUT}-{hashlib.sha1(repr(_stamp(s, sf)).encode()).hexdigest()}"
    try:
        return ShardIndex.open(s, path)
    except ValueError:
        return ShardIndex.create(s, path if not exists(s, path) else f"{path}-{uuid.uuid4().hex}", _docs(s, sf))  # a folder without stats is another writer's


def _docs(s, sf):
    return X.table(s, sf, "documents").select(c("doc_id").cast("string").alias("chunk_id"), "source", "text")


def _semantic(s, sf):
    """(chunk_id, score) of every vector against the first one."""
    q = F.array(*[F.lit(x) for x in _q0(s, sf)])
    return X.vectors(s, sf).select("chunk_id", V.dot(c("embedding"), q).alias("score"))


def vec_normalize(s, sf):
    v = V.normalized(F.transform("embedding", lambda x: x.cast("double") * 4))
    return X.table(s, sf, "embeddings").select("vec_id", F.round(v[0], 6).alias("first"), F.round(V.norm(v), 6).alias("length"))


def vec_add_stats(s, sf):
    return V.add_stats(X.vectors(s, sf), _docs(s, sf))


def vec_topk(s, sf):
    return V.top_k(X.vectors(s, sf), _q0(s, sf), K)


def vec_topk_batch(s, sf):
    return V.top_k_batch(X.vectors(s, sf), X.query_vectors(s, sf), K)


def _cells(s, sf) -> VectorIndex:
    """The vector index of a state of the embeddings, built by the session that finds none."""
    stamp = (f"{sf}/embeddings.parquet", *listed(s, f"{sf}/embeddings.parquet"))
    path = f"{shared_dir(s)}/cells-{hashlib.sha1(repr(stamp).encode()).hexdigest()}"
    try:
        return VectorIndex.open(s, path)
    except ValueError:
        return VectorIndex.create(X.vectors(s, sf), path if not exists(s, path) else f"{path}-{uuid.uuid4().hex}")


def vec_topk_index(s, sf):
    return _cells(s, sf).search(X.query_vectors(s, sf), K).select("qid", c("key").alias("chunk_id"), "score", "rank")


def vec_topk_index_filtered(s, sf):
    """Every query among the vectors of one document: the filter comes before the search."""
    return _cells(s, sf).search(X.query_vectors(s, sf), K, where=c("document_id") == "d3").select("qid", c("key").alias("chunk_id"), "score", "rank")


def vec_topk_filtered(s, sf):
    return V.top_k(X.vectors(s, sf).where("document_id = 'd3'"), _q0(s, sf), K)


def vec_lookup(s, sf):
    wanted = s.createDataFrame([("0",), ("7",), ("nothing",)], "chunk_id string")
    return wanted.join(X.vectors(s, sf).select("chunk_id", "vec_id"), "chunk_id", "left").select("chunk_id", c("vec_id").alias("position"), c("vec_id").isNotNull().alias("present"))


def vec_stats(s, sf):
    v = X.vectors(s, sf)
    return V.index_stats(v.unionByName(v.where("vec_id % 10 = 0")))


def vec_doc_chunks(s, sf):
    return X.vectors(s, sf).where("document_id = 'd1'").select("chunk_id", "document_id")


def vec_delete(s, sf):
    return V.remove(X.vectors(s, sf), X.vectors(s, sf).where("document_id = 'd2'")).groupBy("document_id").agg(F.count("*").alias("n"))


def vec_rebuild(s, sf):
    return X.chunk_vectors(s, sf).select("chunk_id", "document_id", F.md5(F.substring("text", 1, 500)).alias("text_md5"), F.size("embedding").cast("long").alias("dimension"))


def vec_meta(s, sf):
    return X.chunks(s, sf).select("chunk_id", F.substring("text", 1, 500).alias("t"), "section_id", "token_count", "chunk_index").select("chunk_id", F.length("t").cast("long").alias("n"), "section_id", "token_count", "chunk_index")


def embed_hash(s, sf):
    return V.hashed_embedding(_docs(s, sf), tokens(c("text")), "chunk_id", 16)


def bm25_index(s, sf):
    return _index(s, sf, fresh=True).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_search(s, sf):
    return S.bm25(_index(s, sf), TERMS).select("chunk_id", F.round("bm25", 6).alias("bm25"))


def semantic_search(s, sf):
    out = _semantic(s, sf).select("chunk_id", F.round("score", 6).alias("semantic_score")).withColumn("bm25_score", F.lit(0.0)).withColumn("hybrid_score", c("semantic_score"))
    return S.top(out, K)


def hybrid_fuse(s, sf):
    return S.fuse(_semantic(s, sf), S.bm25(_index(s, sf), TERMS))


def hybrid_search(s, sf):
    return S.top(hybrid_fuse(s, sf), K)


def hybrid_left(s, sf):
    return S.top(S.fuse(_semantic(s, sf), S.bm25(_index(s, sf, "raw"), TERMS), how="left"), K)


def _asked(s, sf):
    """(qid, query, embedding): every id divisible by 50 asks the first five words of its document and its vector, or the one that it has."""
    return _query_text(s, sf).join(X.query_vectors(s, sf), "qid", "full").withColumn("query", F.coalesce("query", F.lit("")))


def bm25_topk_batch(s, sf):
    return _store(s, sf).search(_asked(s, sf), K).select("qid", c("key").alias("chunk_id"), "bm25", "rank")


def hybrid_topk_batch(s, sf):
    return _store(s, sf).hybrid(X.vectors(s, sf), _asked(s, sf), K)


def _changed(s, sf) -> LexicalStore:
    """An index of the documents to which the benchmark items are added, and from which toxic documents are deleted."""
    items = X.table(s, sf, "benchmark").select(F.concat(F.lit("b"), c("item_id").cast("string")).alias("chunk_id"), "text")
    toxic = X.table(s, sf, "labels").where("toxic = 1").select(c("doc_id").cast("string").alias("chunk_id"))
    return LexicalStore.create(s, f"{shared_dir(s)}/changed-{uuid.uuid4().hex}", _docs(s, sf)).add(items).remove(toxic)


def store_terms(s, sf):
    """Terms and weights after additions and deletions."""
    store = _changed(s, sf)
    out = staged(store.terms().select("term", "df", F.round("idf", 6).alias("idf")), "store-terms")
    store.drop()
    return out


def store_search(s, sf):
    """The five best for every benchmark item, whole, after additions and deletions."""
    store = _changed(s, sf)
    asked = X.table(s, sf, "benchmark").select(c("item_id").alias("qid"), c("text").alias("query"))
    out = staged(store.search(asked, 5).select("qid", c("key").alias("chunk_id"), "bm25", "rank"), "store-search")
    store.drop()
    return out


def hybrid_by_doc(s, sf):
    scored = S.bm25(_index(s, sf, "scope"), TERMS)
    return S.ranked(scored.select("document_id", "chunk_id", F.round("bm25", 6).alias("score")), "document_id").where(c("rank") <= 3)


def q_search_chunks(s, sf):
    best = V.top_k(X.vectors(s, sf), _q0(s, sf), K).select(c("chunk_id").cast("long").alias("vec_id"), "score")
    return best.join(X.chunks(s, sf), "vec_id", "left").select("vec_id", "score", "chunk_id", F.concat(F.substring("text", 1, 300), F.lit("...")).alias("shown")).withColumn("shown", F.md5("shown"))


# Queries for the expansion test.
QUERIES_TEXT = ["chọn cột trong bảng", "SQL với pandas", "không có gì", "lọc HÀNG"]


#: The same with words that the test tables hold.
EXPANDED_TEXT = [*QUERIES_TEXT[:2], "the license of SQL", "pandas and the"]


def query_expand(s, sf):
    """All turns of users, by turns with a word of the list behind them, and the fixed queries."""
    word = F.element_at(F.array(*map(F.lit, ["", *S.EXPANSIONS])), ((c("conv_id") + c("turn")) % (len(S.EXPANSIONS) + 1) + 1).cast("int"))
    asked = X.table(s, sf, "conversations").where("role = 'user'").select(F.concat_ws(" ", "text", word).alias("query"))
    return asked.unionByName(s.createDataFrame([(q,) for q in QUERIES_TEXT], "query string")).select("query", S.expand_query(c("query")).alias("expanded"))


def query_expand_search(s, sf):
    """The five best documents of each widened query, by hashed vectors of 64 buckets."""
    words = lambda text: F.array_join(tokens(text), " ")
    asked = s.createDataFrame([(i, q) for i, q in enumerate(EXPANDED_TEXT)], "qid long, query string")
    queries = V.encode(asked, V.hashing_encoder(), "qid", words(S.expand_query(c("query"))))
    return V.top_k_batch(V.encode(_docs(s, sf), V.hashing_encoder(), "chunk_id", words(c("text"))), queries, 5)


def mmr_search(s, sf):
    q = F.array(*[F.lit(x) for x in _q0(s, sf)])
    scored = X.vectors(s, sf).select(F.lit("all").alias("document_id"), "chunk_id", c("vec_id").alias("chunk_index"), F.lit(1).alias("token_count"), F.round(V.dot(c("embedding"), q), 6).alias("score"), "embedding")
    best = scored.orderBy(F.desc("score"), "chunk_index").limit(5 * K)
    return L.select_diverse(best, K, scale=1.0).select("chunk_id", "score", "pick")


def _ranked(s, sf):
    return vec_topk_batch(s, sf)


def rel_top_score(s, sf):
    return S.relevance_parts(_ranked(s, sf)).select("qid", "top_score", "variance", "top_part")


def rel_distribution(s, sf):
    return S.relevance_parts(_ranked(s, sf)).select("qid", "distribution_part")


def _query_text(s, sf):
    words = F.slice(F.filter(F.split("text", r"\s+"), lambda w: w != ""), 1, 5)
    return X.table(s, sf, "documents").where("doc_id % 50 = 0").select(c("doc_id").alias("qid"), F.array_join(words, " ").alias("query"))


def rel_overview(s, sf):
    """Cosine of each query vector with the mean of each document's first three vectors."""
    first = X.chunk_vectors(s, sf).withColumn("rn", F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index"))).where("rn <= 3")
    return V.cosines(V.mean_vectors(first, "document_id"), X.query_vectors(s, sf), "document_id")


def rel_overlap(s, sf):
    top = _ranked(s, sf).where("rank <= 3").join(X.table(s, sf, "documents").select(c("doc_id").cast("string").alias("chunk_id"), "text"), "chunk_id")
    joined = top.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda t: t["text"]), " ").alias("text"))
    return _query_text(s, sf).join(joined, "qid").select("qid", F.round(S.token_overlap(c("query"), c("text")), 6).alias("overlap"))


def _own_overview(s, sf):
    """(qid, overview): cosine of each query vector with the overview of the document that it belongs to."""
    first = X.chunk_vectors(s, sf).where("chunk_index < 3")
    means = V.mean_vectors(first, "document_id").withColumnRenamed("embedding", "mean")
    asked = X.query_vectors(s, sf).join(X.chunks(s, sf).select(c("vec_id").alias("qid"), "document_id"), "qid").join(means, "document_id")
    return asked.select("qid", F.round(V.cosine(c("embedding"), c("mean")), 6).alias("overview"))


def rel_own_overview(s, sf):
    return _own_overview(s, sf)


def rel_combined(s, sf):
    """All four parts, each where it is there."""
    parts = S.relevance_parts(_ranked(s, sf)).join(rel_overlap(s, sf), "qid", "left").join(_own_overview(s, sf), "qid", "left")
    score = S.combined_relevance(c("top_part"), c("overview"), c("overlap"), c("distribution_part"))
    return parts.select("qid", "top_score", F.round(score, 6).alias("relevance_score"))


def rel_strategy(s, sf):
    rows = rel_combined(s, sf)
    out = None
    for preset in S.PRESETS:
        part = rows.select("qid", F.lit(preset).alias("preset"), S.strategy(c("relevance_score"), c("top_score"), preset).alias("r")).select("qid", "preset", "r.*")
        out = part if out is None else out.unionByName(part)
    return out


def rel_quick(s, sf):
    return rel_combined(s, sf).select("qid", (c("top_score") >= S.PRESETS["normal"][2]).alias("is_relevant"))


def sel_chunks_needed(s, sf):
    """The numbers from 1 to 40, and the orders of each customer as questions."""
    per = X.table(s, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("id")).select("id")
    return s.range(1, 41).unionByName(per).select(c("id").alias("questions"), L.chunks_needed(c("id")).alias("needed"))


def _placed(s, sf):
    return V.centroid_distances(X.chunk_vectors(s, sf))


def _scored(s, sf):
    return L.representative_scores(_placed(s, sf))


def sel_centroid(s, sf):
    return _placed(s, sf).select("chunk_id", F.round("distance", 6).alias("distance"))


def sel_repr_score(s, sf):
    return _scored(s, sf).select("chunk_id", "score")


def sel_search_budget(s, sf):
    rows = newest(X.chunk_vectors(s, sf).join(_semantic(s, sf).withColumnRenamed("chunk_id", "v"), F.expr("v = cast(vec_id as string)")).select("document_id", "chunk_id", "token_count", F.round("score", 6).alias("score")), "chunk_id", "score")
    return L.budget_prefix(rows, "document_id", [F.desc("score"), c("chunk_id")], 13).select("document_id", "chunk_id", "place")


def sel_mmr(s, sf):
    return L.select_diverse(_scored(s, sf), 7)


def sel_representative(s, sf):
    return L.select_representative(_scored(s, sf), 13)


def sel_all(s, sf):
    return X.chunks(s, sf).select("chunk_id", F.lit(1.0).alias("score"), F.lit("all").alias("selection_method"))


def _picked(s, sf):
    """A selection that needs no kernel: the three leading chunks of each document by score."""
    rows = _scored(s, sf)
    w = Window.partitionBy("document_id").orderBy(F.desc("score"), "chunk_index")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("document_id", "chunk_id", "chunk_index", "token_count", "score", "section_id", F.lit("representative").alias("selection_method"))


def sel_repr_excl(s, sf):
    rest = _scored(s, sf).join(_picked(s, sf).select("chunk_id"), "chunk_id", "left_anti")
    return L.select_representative(rest, 5)


def sel_by_search(s, sf):
    """The hybrid branch: six tenths of the chunks from search, the rest representative, each with its own budget."""
    n = 10
    found = sel_search_budget(s, sf).where(c("place") <= int(0.6 * n)).select("document_id", "chunk_id", F.lit("search").alias("selection_method"))
    rest = L.select_representative(_scored(s, sf).join(found.select("chunk_id"), "chunk_id", "left_anti"), n - int(0.6 * n))
    return found.unionByName(rest.select("document_id", "chunk_id", "selection_method"))


#: Questions asked of each document, and the chunks that they need.
ASKED, NEEDED = 4, 6
#: Prompts of the strategy tests by the number of the source modulo four: how far the prompt's vector leans to the document's first chunk; none: no prompt.
LEANING = {0: 1.0, 1: 0.5, 2: 0.0, 3: None}


def _leaning():
    number = F.regexp_extract("document_id", r"(\d+)", 1).cast("int") % 4
    return F.element_at(F.create_map(*[x for k, v in LEANING.items() for x in (F.lit(k), F.lit(v).cast("double"))]), number)


def _prompts(s, sf):
    return X.chunks(s, sf).select("document_id").distinct().select("document_id", F.when(_leaning().isNotNull(), "a prompt").otherwise("  ").alias("prompt"))


def _found(s, sf):
    """Hybrid results of each document's prompt, twice as many as are needed."""
    rows = X.chunk_vectors(s, sf)
    own = rows.groupBy("document_id").agg(F.min_by("embedding", "chunk_index").alias("own")).withColumn("lean", _leaning()).where("lean is not null")
    q = F.transform(F.arrays_zip("own", F.array(*[F.lit(x) for x in _q0(s, sf)]).alias("other")), lambda z: c("lean") * z["own"] + (1 - c("lean")) * z["other"])
    score = rows.join(own.select("document_id", q.alias("q")), "document_id").withColumn("score", V.dot(c("embedding"), c("q")))
    fused = S.fuse(score.select("chunk_id", "score"), S.bm25(_index(s, sf, "scope"), TERMS), how="left").select("chunk_id", c("hybrid_score").alias("score"))
    return S.ranked(rows.select("document_id", "chunk_id", "chunk_index", "token_count", "section_id").join(fused, "chunk_id"), "document_id").where(c("rank") <= 2 * NEEDED)


def _decided(s, sf):
    parts = S.relevance_parts(_found(s, sf), "document_id")
    score = S.combined_relevance(c("top_part"), F.lit(None).cast("double"), F.lit(None).cast("double"), c("distribution_part"))
    return parts.select("document_id", S.strategy(F.round(score, 6), c("top_score"))["strategy"].alias("strategy"))


def sel_strategy(s, sf):
    """All three branches of the switch, each document by what its prompt is judged to be."""
    out = L.select_by_strategy(_decided(s, sf), _found(s, sf), _scored(s, sf), X.chunk_vectors(s, sf), NEEDED)
    return out.select("document_id", "chunk_id", "token_count", "selection_method")


def sel_dispatch(s, sf):
    """Documents with a prompt by its strategy, the others representative and covered; summed up."""
    rows = X.chunk_vectors(s, sf)
    return L.selection_summary(L.select_candidates(_prompts(s, sf), _decided(s, sf), _found(s, sf), _scored(s, sf), rows, NEEDED))


def sel_adjacent(s, sf):
    return L.add_neighbours(_picked(s, sf), X.chunks(s, sf)).select("document_id", "chunk_id", "score", "selection_method")


def sel_adjacent_budget(s, sf):
    return L.add_neighbours(_picked(s, sf), X.chunks(s, sf), budget=L.BUDGET).select("document_id", "chunk_id", "selection_method")


def sel_coverage(s, sf):
    return L.cover_sections(_picked(s, sf).where("section_id like '%en'"), _placed(s, sf)).select("document_id", "chunk_id", "selection_method")


def sel_summary(s, sf):
    return L.add_neighbours(_picked(s, sf), X.chunks(s, sf)).groupBy("document_id", "selection_method").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))


def _judged(s, sf):
    label = X.table(s, sf, "embeddings").select(c("vec_id").cast("string").alias("chunk_id"), "label")
    mine = X.table(s, sf, "embeddings").select(c("vec_id").alias("qid"), c("label").alias("own"))
    return _ranked(s, sf).join(label, "chunk_id").join(mine, "qid").select("qid", "rank", (c("label") == c("own")).alias("relevant"), "chunk_id")


def _qids(s, sf):
    return X.query_vectors(s, sf).select("qid")


def ir_judge(s, sf):
    """Documents that hold two of three key words, or name the section."""
    low = F.lower("text")
    hits = sum(low.contains(w).cast("int") for w in ("the", "license", "idiot"))
    return X.table(s, sf, "documents").select("doc_id", ((hits >= 2) | c("source").contains("src7")).alias("relevant"))


def ir_precision(s, sf):
    return S.precision_and_mrr(_judged(s, sf), _qids(s, sf)).agg(*[F.round(F.avg(p), 6).alias(p) for p in ("p1", "p3", "p5")])


def ir_mrr(s, sf):
    return S.precision_and_mrr(_judged(s, sf), _qids(s, sf)).select("qid", "rr")


def ir_keyword(s, sf):
    low = F.lower("text")
    hits = sum(low.contains(w).cast("int") for w in ("the", "license", "idiot"))
    return X.table(s, sf, "documents").groupBy("source").agg(F.round(F.sum(hits) / 3.0, 6).alias("keyword_match"))


def _methods(s, sf):
    """(method, qid, rank, relevant): vectors alone and hybrid, each for every query that has a vector; relevant is a result with the query's label."""
    label = X.table(s, sf, "embeddings").select(c("vec_id").cast("string").alias("chunk_id"), "label")
    mine = X.table(s, sf, "embeddings").select(c("vec_id").alias("qid"), c("label").alias("own"))
    lists = _ranked(s, sf).select(F.lit("semantic").alias("method"), "qid", "rank", "chunk_id").unionByName(hybrid_topk_batch(s, sf).select(F.lit("hybrid").alias("method"), "qid", "rank", "chunk_id"))
    return lists.join(mine, "qid").join(label, "chunk_id", "left").select("method", "qid", "rank", F.coalesce(c("label") == c("own"), F.lit(False)).alias("relevant"))


def ir_methods(s, sf):
    """Precision and mean reciprocal rank of both methods, and how far hybrid is ahead."""
    rows = _methods(s, sf)
    out = None
    for name in ("semantic", "hybrid"):
        row = S.precision_and_mrr(rows.where(c("method") == name), _qids(s, sf)).agg(*[F.round(F.avg(p), 6).alias(n) for p, n in (("p1", "p1"), ("p3", "p3"), ("p5", "p5"), ("rr", "mrr"))]).withColumn("method", F.lit(name))
        out = row if out is None else out.unionByName(row)
    ahead = F.max(F.when(c("method") == "hybrid", c("mrr"))).over(Window.partitionBy()) - F.max(F.when(c("method") == "semantic", c("mrr"))).over(Window.partitionBy())  # two rows
    return out.withColumn("gain", F.round(ahead, 6)).select("method", "p1", "p3", "p5", "mrr", "gain")


def ir_best_method(s, sf):
    """Which method has the higher mean reciprocal rank, first name on a tie."""
    return ir_methods(s, sf).agg(F.min(F.struct((-c("mrr")).alias("m"), "method")).alias("b")).select("b.method", (-c("b.m")).alias("mrr"))


_DOT = "list_dot_product({0}::double[], {1}::double[])"
_Q0 = "(select embedding from embeddings where vec_id = 0)"
SEM = f"sem as (select chunk_id, {_DOT.format('embedding', _Q0)} score from vectors)"
_TIMES = "times as (select unnest([{}]) term, unnest([{}]) times)".format(", ".join(f"'{t}'" for t in sorted(set(TERMS))), ", ".join(f"{TERMS.count(t)}.0::double" for t in sorted(set(TERMS))))
BM = """post as (select {g} chunk_id, term, count(*) tf, any_value(dl) dl from (select {g} chunk_id, unnest(t) term, len(t) dl from ({src})) group by all),
corpus as (select {g} count(*) n, avg(len(t)) avgdl from ({src}) group by all),
df as (select {g} term, count(*) df from post group by all),
raw as (select df.*, avgdl, ln(n - df + 0.5) - ln(df + 0.5) raw from df {j} corpus {u}),
idf as (select {g} term, df, avgdl, case when raw < 0 then 0.25::double * avg(raw) over ({w}) else raw end idf from raw),
{times}, hits as (select {g} chunk_id, sum(times * idf * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl))) raw from post join idf using ({g} term) join times using (term) group by all),
bm as (select {g} chunk_id, raw / case when max(raw) over ({w}) > 0 then max(raw) over ({w}) else 1 end bm25 from hits)"""


def _bm(src: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    return BM.format(g=g, src=src, j="join" if group else "cross join", u=f"using ({group})" if group else "", w=f"partition by {group}" if group else "", times=_TIMES)


BM_DOCS = _bm(f"select doc_id::varchar chunk_id, {X.TOK.format('text', 2)} t from documents")
BM_RAW = _bm(r"select doc_id::varchar chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+') t from documents")
BM_SCOPE = _bm(f"select document_id, chunk_id, {X.TOK.format('text[1:500]', 2)} t from chunks", "document_id")
FUSE = "fused as (select chunk_id, semantic_score, bm25_score, round(0.7::double * semantic_score + (1 - 0.7::double) * bm25_score, 7) hybrid_score from (select chunk_id, round(coalesce(score, 0), 6) semantic_score, round(coalesce(bm25, 0), 6) bm25_score from sem {how} join bm using (chunk_id)))"
RANK = f"""found as (select q.vec_id qid, v.chunk_id, round({_DOT.format('v.embedding', 'q.embedding')}, 6) score from vectors v, embeddings q where q.vec_id % 50 = 0),
ranked as (select qid, chunk_id, score, rank from (select *, row_number() over (partition by qid order by score desc, chunk_id) rank from found) where rank <= {K})"""
REL = RANK + """, agg as (select qid, max(score) top_score, coalesce(var_pop(score) filter (rank <= 5), 0) variance, count(*) n, avg(score) filter (rank between 2 and 5) rest from ranked group by 1),
parts as (select qid, top_score, round(variance, 6) variance, round(case when variance > 0.15 then top_score * 0.8 else top_score end, 6) top_part, round(case when n >= 5 then least(1, 3 * (top_score - rest)) end, 6) distribution_part from agg)"""
OVER = REL + r""", qt as (select doc_id qid, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')[1:5], ' ') query from documents where doc_id % 50 = 0),
tt as (select qid, string_agg(text, ' ' order by rank) t from ranked join (select doc_id::varchar chunk_id, text from documents) using (chunk_id) where rank <= 3 group by 1),
sets as (select qid, list_distinct(list_filter(regexp_split_to_array(lower(query), '\s+'), lambda w: w <> '')) q, list_distinct(list_filter(regexp_split_to_array(lower(t), '\s+'), lambda w: w <> '')) t from qt join tt using (qid)),
overlap as (select qid, round(case when len(q) > 0 then len(list_intersect(q, t)) / len(q)::double else 0 end, 6) overlap from sets)"""
OWN = """own_first as (select * from chunk_vectors where chunk_index < 3), own_mean as (select document_id, list(m order by p) o from (select document_id, p, avg(embedding[p]::double) m from (select document_id, embedding, unnest(range(1, 65)) p from own_first) group by all) group by 1),
own as (select q.vec_id qid, round(list_dot_product(q.embedding::double[], o) / sqrt(list_dot_product(q.embedding::double[], q.embedding::double[]) * list_dot_product(o, o)), 6) overview from embeddings q join chunks c on c.vec_id = q.vec_id join own_mean using (document_id) where q.vec_id % 50 = 0)"""
COMB = OVER + ", " + OWN + """, comb as (select qid, top_score, round((0.4::double * top_part + coalesce(0.3::double * overview, 0) + coalesce(0.15::double * overlap, 0) + coalesce(0.15::double * distribution_part, 0))
  / (0.4::double + case when overview is null then 0 else 0.3::double end + case when overlap is null then 0 else 0.15::double end + case when distribution_part is null then 0 else 0.15::double end), 6) relevance_score from parts left join overlap using (qid) left join own using (qid))"""
CENT = """mean as (select document_id, list(m order by p) centroid from (select document_id, p, avg(embedding[p]::double) m from (select document_id, embedding, unnest(range(1, 65)) p from chunk_vectors) group by all) group by 1),
placed as (select c.*, sqrt(list_sum(list_transform(list_zip(embedding::double[], centroid), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) distance from chunk_vectors c join mean using (document_id))"""
SCORE = CENT + """, scored as (select *, round(3::double * (1 - distance / (max(distance) over (partition by document_id) + 1e-9)) + case when token_count between 50 and 150 then 2 when token_count between 30 and 180 then 1 else 0 end + 1
  + case when chunk_index / count(*) over (partition by document_id) between 0.15 and 0.85 then 2 when chunk_index / count(*) over (partition by document_id) between 0.05 and 0.95 then 1 else 0 end, 6) score from placed)"""
PICK = SCORE + ", picked as (select * from scored qualify row_number() over (partition by document_id order by score desc, chunk_index) <= 3)"
ADJ = PICK + """, sides as (select document_id, chunk_index as_of, score base, section_id, unnest([-1, 1]) side from picked),
added as (select s.document_id, c.chunk_id, c.token_count, as_of, side, round(base * 0.8::double, 6) score, 'context_expansion' selection_method from sides s join chunks c on c.document_id = s.document_id and c.section_id = s.section_id and c.chunk_index = as_of + side
  where c.chunk_id not in (select chunk_id from picked) qualify row_number() over (partition by s.document_id, c.chunk_id order by as_of, side) = 1)"""
JUDGE = RANK + ", judged as (select r.qid, rank, e.label = q.label relevant from ranked r join embeddings e on e.vec_id::varchar = r.chunk_id join embeddings q on q.vec_id = r.qid)"
PREC = "per as (select qid, count(*) filter (relevant and rank <= 1) / 1 p1, count(*) filter (relevant and rank <= 3) / 3 p3, count(*) filter (relevant and rank <= 5) / 5 p5, coalesce(round(1.0::double / min(rank) filter (relevant), 6), 0) rr from {} group by 1)"
_HITS = "(contains(lower(text), 'the')::int + contains(lower(text), 'license')::int + contains(lower(text), 'idiot')::int)"
_KEYS = "[" + ", ".join(f"'{k}'" for k in ["", *S.EXPANSIONS]) + "]"
_EXP = " || ".join("case when contains(lower(query), '{}') then [{}] else [] end".format(k, ", ".join(f"'{x}'" for x in v)) for k, v in S.EXPANSIONS.items())


def _v(names: str, ctes: str, body: str) -> str:
    return W(*names.split(), body="").rstrip() + ", " + ctes + "\n" + body


def _mmr(base: str, n: int, scale: str = "5", name: str = "m") -> str:
    """The greedy order as a recursion: a step adds to each document's picks the row with the highest gain."""
    return f"""{name}_b as materialized (select document_id, chunk_id, chunk_index, token_count, score, list_transform(embedding::double[], lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[]))) u from {base}),
{name}_r as (select document_id, 1 pick, [first(chunk_index order by score desc, chunk_index)] ids, [first(u order by score desc, chunk_index)] us from {name}_b group by 1
  union all select document_id, pick + 1, list_append(ids, x.i), list_append(us, x.u) from (select r.document_id, r.pick, r.ids, r.us,
    first(struct_pack(i := b.chunk_index, u := b.u) order by 0.7::double * b.score - (1 - 0.7::double) * {scale} * list_max(list_transform(r.us, lambda v: list_dot_product(v, b.u))) desc, b.chunk_index) x
    from {name}_r r join {name}_b b on b.document_id = r.document_id where r.pick < {n} and not list_contains(r.ids, b.chunk_index) group by r.document_id, r.pick, r.ids, r.us)),
{name}_o as (select document_id, unnest(ids) chunk_index, unnest(range(1, len(ids) + 1)) pick from {name}_r qualify row_number() over (partition by document_id order by {name}_r.pick desc) = 1),
{name} as (select document_id, chunk_id, chunk_index, token_count, score, o.pick from {name}_o o join {name}_b using (document_id, chunk_index))"""


def _representative(base: str, n: int, name: str = "rep") -> str:
    sized = f"{name}_sized as (select *, count(*) over (partition by document_id) n_chunks from {base}), {name}_large as (select * from {name}_sized where n_chunks > {n})"
    return f"""{sized}, {_mmr(name + '_large', n, name=name + '_m')}, {name}_fits as (select *, sum(token_count) over (partition by document_id order by pick) spent from {name}_m),
{name} as (select document_id, chunk_id, chunk_index, token_count, 1.0::double score, 'representative' selection_method from {name}_sized where n_chunks <= {n} union all select document_id, chunk_id, chunk_index, token_count, score, 'representative' from {name}_fits where spent <= 3000)"""


def _room(rows: str, used: str) -> str:
    """taken: rows (document_id, chunk_id, token_count, turn, side) in order, each if it still fits beside what is used."""
    return f"""line as (select *, row_number() over (partition by document_id order by turn, side) i from {rows}),
walk as (select document_id, 0::bigint i, (3000 - used)::bigint room, '' chunk_id, false kept from {used}
  union all select w.document_id, l.i, (w.room - case when l.token_count <= w.room then l.token_count else 0 end)::bigint, l.chunk_id, l.token_count <= w.room from walk w join line l on l.document_id = w.document_id and l.i = w.i + 1),
taken as (select l.* from line l join walk w using (document_id, chunk_id) where w.kept)"""


def _recursive(names: str, ctes: str, body: str) -> str:
    return "with recursive " + _v(names, ctes, body).removeprefix("with ")


FOUND = SEM + """, r as (select c.document_id, c.chunk_id, token_count, round(score, 6) score from chunk_vectors c join sem on sem.chunk_id = c.vec_id::varchar),
  b as (select *, row_number() over w place, sum(token_count) over w spent from r window w as (partition by document_id order by score desc, chunk_id)),
  found as (select document_id, chunk_id from b where spent <= 3000 and place <= 6)"""
BUDGETED = ADJ + """, used as (select document_id, sum(token_count) used from picked group by 1), near as (select document_id, chunk_id, token_count, as_of turn, side from added), """ + _room("near", "used")
_NUMBER = "regexp_extract(document_id, '([0-9]+)', 1)::int % 4"
_LEANS = " ".join(f"when {k} then {v}::double" for k, v in LEANING.items() if v is not None)
DECIDED = f"""own as (select document_id, embedding::double[] own, case {_NUMBER} {_LEANS} end lean from chunk_vectors qualify row_number() over (partition by document_id order by chunk_index) = 1),
q as (select document_id, list_transform(list_zip(own, {_Q0}::double[]), lambda z: lean * z[1] + (1 - lean) * z[2]) q from own where lean is not null),
hyb as (select v.document_id, v.chunk_id, chunk_index, token_count, section_id, round(0.7::double * round(list_dot_product(embedding::double[], q), 6) + (1 - 0.7::double) * round(coalesce(bm25, 0), 6), 7) score from chunk_vectors v join q using (document_id) left join bm using (chunk_id)),
found as (select * from (select *, row_number() over (partition by document_id order by score desc, chunk_id) rank from hyb) where rank <= {2 * NEEDED}),
agg as (select document_id, max(score) top_score, coalesce(var_pop(score) filter (rank <= 5), 0) variance, count(*) n, avg(score) filter (rank between 2 and 5) rest from found group by 1),
parts as (select document_id, top_score, round(case when variance > 0.15 then top_score * 0.8 else top_score end, 6) top_part, round(case when n >= 5 then least(1, 3 * (top_score - rest)) end, 6) spread from agg),
judged as (select document_id, top_score, round((0.4::double * top_part + coalesce(0.15::double * spread, 0)) / (0.4::double + case when spread is null then 0 else 0.15::double end), 6) score from parts),
decided as (select document_id, case when score >= 0.65 and top_score >= 0.40 then 'search' when score >= 0.35 then 'hybrid' else 'representative' end strategy from judged)"""
SWITCH = f"""{SCORE}, {BM_SCOPE}, {DECIDED},
placed_found as (select f.*, strategy, row_number() over w place, sum(token_count) over w spent from found f join decided using (document_id) window w as (partition by document_id order by score desc, chunk_id)),
heads as (select * from placed_found where spent <= 3000 and place <= case strategy when 'search' then {NEEDED} when 'hybrid' then {int(0.6 * NEEDED)} else 0 end),
used as (select document_id, sum(token_count) used from heads where strategy = 'search' group by 1 having count(*) < {NEEDED}),
near as (select s.document_id, v.chunk_id, v.token_count, place turn, side from (select l.*, unnest([-1, 1]) side from heads l semi join used using (document_id)) s join chunk_vectors v on v.document_id = s.document_id and v.section_id = s.section_id and v.chunk_index = s.chunk_index + side
  where v.chunk_id not in (select chunk_id from heads) qualify row_number() over (partition by v.document_id, v.chunk_id order by place, side) = 1),
{_room("near", "used")},
mixed as (select s.* from scored s join decided using (document_id) where strategy = 'hybrid' and chunk_id not in (select chunk_id from heads)), {_representative("mixed", NEEDED - int(0.6 * NEEDED), "reph")},
strange as (select s.* from scored s join decided using (document_id) where strategy = 'representative'), {_representative("strange", NEEDED, "repf")},
switched as (select document_id, chunk_id, token_count, 'search' selection_method from heads union all select document_id, chunk_id, token_count, 'context_expansion' from taken
  union all select document_id, chunk_id, token_count, selection_method from reph union all select document_id, chunk_id, token_count, 'representative_fallback' from repf)"""
DISPATCH = f"""{SWITCH}, quiet as (select * from scored where document_id not in (select document_id from q)), {_representative("quiet", NEEDED, "repq")},
mine as (select r.*, section_id from repq r join chunk_vectors using (document_id, chunk_id)), sec as (select document_id, section_id, min(chunk_index) fi from quiet group by all), cov as (select distinct document_id, section_id from mine),
share as (select document_id, count(c.section_id) / count(*) coverage from sec s left join cov c using (document_id, section_id) group by 1), spent as (select document_id, sum(token_count) spent from mine group by 1),
best as (select p.*, fi from quiet p join sec using (document_id, section_id) join share using (document_id) where coverage < 0.7 and (p.document_id, p.section_id) not in (select document_id, section_id from cov) qualify row_number() over (partition by p.document_id, p.section_id order by distance, chunk_index) = 1),
tot as (select b.*, sum(token_count) over (partition by document_id order by fi) + coalesce(spent, 0) total from best b left join spent using (document_id))"""
ASKED_TERMS = r"qt as (select doc_id qid, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')[1:5], ' ') query from documents where doc_id % 50 = 0)"


def _bm_many(src: str, queries: str) -> str:
    """bmq: (qid, chunk_id, bm25) of every document of src with a term of the query."""
    return f"""post as (select chunk_id, term, count(*) tf, any_value(dl) dl from (select chunk_id, unnest(t) term, len(t) dl from ({src})) group by all), corpus as (select count(*) n, avg(len(t)) avgdl from ({src})),
df as (select term, count(*) df from post group by all), rawidf as (select df.*, avgdl, ln(n - df + 0.5) - ln(df + 0.5) raw from df cross join corpus), idf as (select term, df, avgdl, case when raw < 0 then 0.25::double * avg(raw) over () else raw end idf from rawidf),
asked as (select qid, unnest({X.TOK.format('query', 2)}) term from ({queries})), hits as (select qid, chunk_id, sum(idf * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl))) raw from asked join post using (term) join idf using (term) group by all),
bmq as (select qid, chunk_id, raw / case when max(raw) over (partition by qid) > 0 then max(raw) over (partition by qid) else 1 end bm25 from hits)"""


_DOC_TOKENS = f"select doc_id::varchar chunk_id, {X.TOK.format('text', 2)} t from documents"
_LIVE_TOKENS = f"{_DOC_TOKENS} where doc_id not in (select doc_id from labels where toxic = 1) union all select 'b' || item_id, {X.TOK.format('text', 2)} from benchmark"
HYBRID = f"""{ASKED_TERMS}, {_bm_many(_DOC_TOKENS, 'select * from qt')}, semq as (select q.vec_id qid, v.chunk_id, round({_DOT.format('v.embedding', 'q.embedding')}, 6) score from vectors v, embeddings q where q.vec_id % 50 = 0),
fusedq as (select qid, chunk_id, round(coalesce(score, 0), 6) semantic_score, round(coalesce(bm25, 0), 6) bm25_score from semq full join bmq using (qid, chunk_id)),
hybridq as (select *, row_number() over (partition by qid order by hybrid_score desc, chunk_id)::int as rank from (select *, round(0.7::double * semantic_score + (1 - 0.7::double) * bm25_score, 7) hybrid_score from fusedq) qualify rank <= {K})"""
METHODS = f"""{HYBRID}, {RANK}, lists as (select 'semantic' as method, qid, rank, chunk_id from ranked union all select 'hybrid', qid, rank, chunk_id from hybridq),
judged as (select l.method, l.qid, l.rank, coalesce(e.label = q.label, false) relevant from lists l join embeddings q on q.vec_id = l.qid left join embeddings e on e.vec_id::varchar = l.chunk_id),
per as (select method, qid, count(*) filter (relevant and rank <= 1) / 1 p1, count(*) filter (relevant and rank <= 3) / 3 p3, count(*) filter (relevant and rank <= 5) / 5 p5, coalesce(round(1.0::double / min(rank) filter (relevant), 6), 0) rr from judged group by all),
methods as (select method, round(avg(round(p1, 6)), 6) p1, round(avg(round(p3, 6)), 6) p3, round(avg(round(p5, 6)), 6) p5, round(avg(rr), 6) mrr from per group by 1)"""
SQL = {
    "bm25_topk_batch": f"with {ASKED_TERMS}, {_bm_many(_DOC_TOKENS, 'select * from qt')} select qid, chunk_id, round(bm25, 6) bm25, (row_number() over (partition by qid order by round(bm25, 6) desc, chunk_id))::int as rank from bmq qualify rank <= {K}",
    "hybrid_topk_batch": _v("vectors", HYBRID, "select * from hybridq"),
    "store_terms": f"with {_bm_many(_LIVE_TOKENS, 'select item_id qid, text query from benchmark')} select term, df, round(idf, 6) idf from idf",
    "store_search": f"with {_bm_many(_LIVE_TOKENS, 'select item_id qid, text query from benchmark')} select qid, chunk_id, round(bm25, 6) bm25, (row_number() over (partition by qid order by round(bm25, 6) desc, chunk_id))::int as rank from bmq qualify rank <= 5",
    "ir_methods": _v("vectors", METHODS, "select *, round(max(mrr) filter (method = 'hybrid') over () - max(mrr) filter (method = 'semantic') over (), 6) gain from methods"),
    "vec_normalize": "with n as (select vec_id, list_transform(embedding::double[], lambda x: x * 4) v from embeddings) select vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) as first, 1.0::double as length from n",
    "vec_add_stats": "select count(*) n_added, count(*) filter (vec_id is null) n_new, count(vec_id) n_duplicate from documents left join embeddings on vec_id = doc_id",
    "vec_topk": _v("vectors", SEM, f"select chunk_id, round(score, 6) score from sem order by 2 desc, 1 limit {K}"),
    "vec_topk_batch": _v("vectors", RANK, "select qid, chunk_id, score, rank::int rank from ranked"),
    "vec_topk_index": _v("vectors", RANK, "select qid, chunk_id, score, rank::int rank from ranked"),
    "vec_topk_index_filtered": _v("vectors", RANK.replace("from vectors v,", "from (select * from vectors where document_id = 'd3') v,"), "select qid, chunk_id, score, rank::int rank from ranked"),
    "vec_topk_filtered": _v("vectors", SEM, f"select chunk_id, round(score, 6) score from sem join vectors using (chunk_id) where document_id = 'd3' order by 2 desc, 1 limit {K}"),
    "vec_lookup": W("vectors", body="select w.chunk_id, vec_id as position, vec_id is not null present from (values ('0'), ('7'), ('nothing')) w(chunk_id) left join vectors v on v.chunk_id = w.chunk_id"),
    "vec_stats": W("vectors", body=", u as (select * from vectors union all select * from vectors where vec_id % 10 = 0) select count(*) total, count(distinct chunk_id) unique_keys, count(distinct document_id) documents, max(len(embedding)) dimension, count(*) - count(distinct chunk_id) duplicates, printf('%.1f%%', 100.0::double * (count(*) - count(distinct chunk_id)) / count(*)) duplicate_rate from u").replace("\n, u", ", u"),
    "vec_doc_chunks": W("vectors", body="select chunk_id, document_id from vectors where document_id = 'd1'"),
    "vec_delete": W("vectors", body="select document_id, count(*) n from vectors where document_id <> 'd2' group by 1"),
    "vec_rebuild": W("chunk_vectors", body="select chunk_id, document_id, md5(text[1:500]) text_md5, len(embedding) dimension from chunk_vectors"),
    "vec_meta": W("chunks", body="select chunk_id, length(text[1:500]) n, section_id, token_count, chunk_index from chunks"),
    "embed_hash": f"with t as (select doc_id::varchar chunk_id, unnest({X.TOK.format('text', 2)}) t from documents), b as (select chunk_id, (('0x' || md5(t)[1:6])::bigint % 16) bucket, count(*)::double n from t group by all) select chunk_id, bucket, round(n / sqrt(sum(n * n) over (partition by chunk_id)), 6) as value from b",
    "bm25_index": f"with {BM_DOCS} select term, df, round(idf, 6) idf from idf",
    "bm25_search": f"with {BM_DOCS} select chunk_id, round(bm25, 6) bm25 from bm",
    "semantic_search": _v("vectors", SEM, f"select chunk_id, round(score, 6) semantic_score, 0.0::double bm25_score, round(score, 6) hybrid_score from sem order by 2 desc, 1 limit {K}"),
    "hybrid_fuse": _v("vectors", f"{SEM}, {BM_DOCS}, {FUSE.format(how='full')}", "select * from fused"),
    "hybrid_search": _v("vectors", f"{SEM}, {BM_DOCS}, {FUSE.format(how='full')}", f"select * from fused order by hybrid_score desc, chunk_id limit {K}"),
    "hybrid_left": _v("vectors", f"{SEM}, {BM_RAW}, {FUSE.format(how='left')}", f"select * from fused order by hybrid_score desc, chunk_id limit {K}"),
    "hybrid_by_doc": _v("chunks", BM_SCOPE, "select document_id, chunk_id, score, rank::int rank from (select document_id, chunk_id, round(bm25, 6) score, row_number() over (partition by document_id order by round(bm25, 6) desc, chunk_id) rank from bm) where rank <= 3"),
    "q_search_chunks": _v("vectors chunks", SEM + f", best as (select chunk_id::bigint vec_id, round(score, 6) score from sem order by 2 desc, chunk_id limit {K})", "select vec_id, score, c.chunk_id, md5(text[1:300] || '...') shown from best left join chunks c using (vec_id)"),
    "query_expand": f"select query, query || ' ' || array_to_string(([query] || {_EXP})[1:5], ' ') expanded from (select concat_ws(' ', text, {_KEYS}[((conv_id + turn) % {len(S.EXPANSIONS) + 1} + 1)::int]) as query from conversations where role = 'user' union all select * from (values " + ", ".join(f"('{q}')" for q in QUERIES_TEXT) + ") v(query))",
    "query_expand_search": f"""with asked as (select i qid, query || ' ' || array_to_string(([query] || {_EXP})[1:5], ' ') x from (values {', '.join(f"({i}::bigint, '{q}')" for i, q in enumerate(EXPANDED_TEXT))}) v(i, query)),
words as (select 'q' || qid k, unnest({X.TOK.format('x', 2)}) t from asked union all select 'd' || doc_id, unnest({X.TOK.format('text', 2)}) from documents),
counted as (select k, ('0x' || md5(t)[1:6])::bigint % 64 bucket, count(*)::double n from words group by all), unit as (select k, bucket, n / sqrt(sum(n * n) over (partition by k)) u from counted),
scored as (select a.k[2:]::bigint qid, b.k[2:] chunk_id, round(sum(a.u * b.u), 6) score from unit a join unit b using (bucket) where a.k[1] = 'q' and b.k[1] = 'd' group by all)
select qid, chunk_id, score, rank::int rank from (select *, row_number() over (partition by qid order by score desc, chunk_id) rank from scored) where rank <= 5""",
    "mmr_search": _recursive("vectors", SEM + ", best as (select 'all' document_id, chunk_id, vec_id chunk_index, 1 token_count, round(score, 6) score, embedding from sem join vectors using (chunk_id) order by round(score, 6) desc, vec_id limit 50), " + _mmr("best", K, "1"), "select chunk_id, score, pick from m"),
    "rel_top_score": _v("vectors", REL, "select qid, top_score, variance, top_part from parts"),
    "rel_distribution": _v("vectors", REL, "select qid, distribution_part from parts"),
    "rel_overview": _v("chunk_vectors", """f as (select * from chunk_vectors qualify row_number() over (partition by document_id order by chunk_index) <= 3),
  mean as (select document_id, list(m order by p) o from (select document_id, p, avg(embedding[p]::double) m from (select document_id, embedding, unnest(range(1, 65)) p from f) group by all) group by 1)""", "select vec_id qid, document_id, round(list_dot_product(embedding::double[], o) / sqrt(list_dot_product(embedding::double[], embedding::double[]) * list_dot_product(o, o)), 6) similarity from mean, embeddings where vec_id % 50 = 0"),
    "rel_own_overview": _v("vectors chunk_vectors", OWN, "select * from own"),
    "rel_overlap": _v("vectors", OVER, "select * from overlap"),
    "rel_combined": _v("vectors chunk_vectors", COMB, "select * from comb"),
    "rel_strategy": _v("vectors chunk_vectors", COMB, """select qid, preset, case when relevance_score >= h and top_score >= t then 'search' when relevance_score >= l then 'hybrid' else 'representative' end strategy,
  case when relevance_score >= h and top_score >= t then 0.9 when relevance_score >= l then 0.6 else 0.3 end::double confidence, greatest(0, least(1, relevance_score)) relevance from comb, (values ('normal', 0.65, 0.35, 0.40), ('strict', 0.75, 0.45, 0.50)) p(preset, h, l, t)"""),
    "rel_quick": _v("vectors chunk_vectors", COMB, "select qid, top_score >= 0.40 is_relevant from comb"),
    "sel_chunks_needed": "select questions, greatest(3, least(30, case when questions <= 5 then floor(questions * 1.5) when questions <= 15 then floor(questions * 1.3) else floor(questions * 1.2) end))::bigint needed from (select unnest(range(1, 41)) questions union all select count(*) from orders group by o_custkey)",
    "sel_centroid": _v("chunk_vectors", CENT, "select chunk_id, round(distance, 6) distance from placed"),
    "sel_repr_score": _v("chunk_vectors", SCORE, "select chunk_id, score from scored"),
    "sel_search_budget": _v("chunk_vectors vectors", SEM + """, r as (select c.document_id, c.chunk_id, token_count, round(score, 6) score from chunk_vectors c join sem on sem.chunk_id = c.vec_id::varchar),
  b as (select *, row_number() over w place, sum(token_count) over w spent from r window w as (partition by document_id order by score desc, chunk_id))""", "select document_id, chunk_id, place::int place from b where spent <= 3000 and place <= 13"),
    "sel_mmr": _recursive("chunk_vectors", SCORE + ", " + _mmr("scored", 7), "select * from m"),
    "sel_representative": _recursive("chunk_vectors", SCORE + ", " + _representative("scored", 13), "select * from rep"),
    "sel_repr_excl": _recursive("chunk_vectors", PICK + ", rest as (select * from scored where chunk_id not in (select chunk_id from picked)), " + _representative("rest", 5), "select * from rep"),
    "sel_by_search": _recursive("chunk_vectors vectors", f"{SCORE}, {FOUND}, rest as (select * from scored where chunk_id not in (select chunk_id from found)), " + _representative("rest", 4), "select document_id, chunk_id, selection_method from rep union all select document_id, chunk_id, 'search' from found"),
    "sel_adjacent_budget": _recursive("chunk_vectors", BUDGETED, "select document_id, chunk_id, 'context_expansion' selection_method from taken union all select document_id, chunk_id, 'representative' from picked"),
    "sel_strategy": _recursive("chunk_vectors", SWITCH, "select * from switched"),
    "sel_dispatch": _recursive("chunk_vectors", DISPATCH, """select document_id, selection_method, count(*) chunks, sum(token_count)::bigint tokens from (select * from switched union all select document_id, chunk_id, token_count, 'representative' from repq
  union all select document_id, chunk_id, token_count, 'section_coverage' from tot where total <= 3000) group by all"""),
    "sel_all": W("chunks", body="select chunk_id, 1.0::double score, 'all' selection_method from chunks"),
    "sel_adjacent": _v("chunk_vectors", ADJ, "select document_id, chunk_id, score, 'context_expansion' selection_method from added union all select document_id, chunk_id, score, 'representative' from picked"),
    "sel_coverage": _v("chunk_vectors", PICK + """, mine as (select * from picked where section_id like '%en'), sec as (select document_id, section_id, min(chunk_index) fi from placed group by all), cov as (select distinct document_id, section_id from mine),
  share as (select document_id, count(c.section_id) / count(*) coverage from sec s left join cov c using (document_id, section_id) group by 1), used as (select document_id, sum(token_count) used from mine group by 1),
  best as (select p.*, fi from placed p join sec using (document_id, section_id) join share using (document_id) where coverage < 0.7 and (p.document_id, p.section_id) not in (select document_id, section_id from cov) qualify row_number() over (partition by p.document_id, p.section_id order by distance, chunk_index) = 1),
  tot as (select b.*, sum(token_count) over (partition by document_id order by fi) + coalesce(used, 0) total from best b left join used using (document_id))""", "select document_id, chunk_id, 'section_coverage' selection_method from tot where total <= 3000"),
    "sel_summary": _v("chunk_vectors", ADJ, "select document_id, selection_method, count(*) chunks, sum(token_count)::bigint tokens from (select document_id, token_count, selection_method from added union all select document_id, token_count, 'representative' from picked) group by all"),
    "ir_judge": f"select doc_id, {_HITS} >= 2 or contains(source, 'src7') relevant from documents",
    "ir_precision": _v("vectors", JUDGE + ", " + PREC.format("judged"), "select round(avg(round(p1, 6)), 6) p1, round(avg(round(p3, 6)), 6) p3, round(avg(round(p5, 6)), 6) p5 from per"),
    "ir_mrr": _v("vectors", JUDGE + ", " + PREC.format("judged"), "select qid, rr from per"),
    "ir_keyword": f"select source, round(sum({_HITS}) / 3.0::double, 6) keyword_match from documents group by 1",
    "ir_best_method": _v("vectors", METHODS, "select method, mrr from methods order by mrr desc, method limit 1"),
}
QUERIES = {name: (globals()[name], sql) for name, sql in SQL.items()}
