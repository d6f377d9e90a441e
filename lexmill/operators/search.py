"""BM25, fusion with vector scores, query expansion, relevance of results, retrieval measures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import tokens
from lexmill.storage import staged

K1, B, EPSILON = 1.5, 0.75, 0.25
# Terms that a query with the key word is widened by.
EXPANSIONS = {
    "chọn": ["select", "lấy", "pick"],
    "lọc": ["filter", "where", "điều kiện"],
    "cột": ["column", "trường", "field"],
    "hàng": ["row", "bản ghi", "record"],
    "bảng": ["table", "dataframe"],
    "pandas": ["python", "dataframe"],
    "sql": ["query", "truy vấn", "database"],
}


def postings(chunks: DataFrame, key: str = "chunk_id", toks: Column | None = None, scope: list[str] | None = None) -> DataFrame:
    """(scope..., key, term, tf, dl)."""
    scope = scope or []
    listed = chunks.select(*scope, key, (toks if toks is not None else tokens(F.col("text"))).alias("t"))
    return listed.select(*scope, key, F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy(*scope, key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def term_weights(posts: DataFrame, corpus: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """(scope..., term, df, idf, avgdl) with the floor of a quarter of the mean idf for terms in over half the chunks.

    corpus: (scope..., n, avgdl), one row for each scope; there may be many scopes, so how it is joined is left to their measured size.
    """
    scope = scope or []
    df = posts.groupBy(*scope, "term").agg(F.count("*").alias("df"))
    df = df.join(corpus, scope) if scope else df.crossJoin(F.broadcast(corpus))  # without a scope one row
    raw = df.withColumn("raw", raw_idf(F.col("n"), F.col("df")))
    mean = raw.groupBy(*scope).agg(F.avg("raw").alias("mean_idf"))
    raw = raw.join(mean, scope) if scope else raw.crossJoin(F.broadcast(mean))
    return raw.withColumn("idf", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw"))).select(*scope, "term", "df", "idf", "avgdl")


def raw_idf(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def corpus_stats(chunks: DataFrame, toks: Column | None = None, scope: list[str] | None = None) -> DataFrame:
    size = F.size(toks if toks is not None else tokens(F.col("text")))
    return chunks.groupBy(*(scope or [])).agg(F.count("*").alias("n"), F.avg(size).alias("avgdl"))


@dataclass
class LexicalIndex:
    """Stored postings (scope..., key, term, tf, dl) and terms (scope..., term, df, idf, avgdl), both in ranges of the term."""

    postings: DataFrame
    terms: DataFrame
    key: str
    scope: list[str]


def lexical_index(chunks: DataFrame, key: str = "chunk_id", scope: list[str] | None = None, toks: Column | None = None) -> LexicalIndex:
    """Tokenise the corpus once and write its postings and term weights; each scope has its own statistics.

    Files are sorted by term, so a search reads the row groups of its own terms.
    """
    scope = scope or []
    posts = staged(postings(chunks, key, toks, scope).repartitionByRange("term", *scope, key).sortWithinPartitions("term"), "postings")
    return LexicalIndex(posts, staged(term_weights(posts, corpus_stats(chunks, toks, scope), scope).sortWithinPartitions("term"), "terms"), key, scope)


def bm25(index: LexicalIndex, query_terms: list[str]) -> DataFrame:
    """(scope..., key, bm25): scores of chunks with a query term, over the best score of the scope; repeated query terms count again."""
    scope, key = index.scope, index.key
    if not query_terms:
        return index.postings.limit(0).select(*scope, key, F.lit(0.0).alias("bm25"))
    mine = F.col("term").isin(sorted(set(query_terms)))
    times = index.terms.sparkSession.createDataFrame([(t, float(query_terms.count(t))) for t in sorted(set(query_terms))], "term string, times double")
    weights = index.terms.where(mine).join(F.broadcast(times), "term")  # a row a query term
    hits = index.postings.where(mine).join(weights, [*scope, "term"])
    scored = hits.groupBy(*scope, key).agg(F.sum(_impact(*map(F.col, ("times", "idf", "tf", "dl", "avgdl")))).alias("raw"))
    best = scored.groupBy(*scope).agg(F.max("raw").alias("best"))
    scored = scored.join(best, scope) if scope else scored.crossJoin(F.broadcast(best))
    return scored.select(*scope, key, (F.col("raw") / F.when(F.col("best") > 0, F.col("best")).otherwise(1.0)).alias("bm25"))


def bm25_each(chunks: DataFrame, asked: DataFrame, scope: list[str], key: str = "chunk_id") -> DataFrame:
    """(scope..., key, bm25) as ``bm25``, but with a query for each scope. asked: (scope..., terms), repeated terms count again. Keys are unique.

    Postings are neither stored nor shuffled: only the number of chunks of each term of a scope is, and a chunk counts the asked terms in its own tokens.
    """
    listed = chunks.select(*scope, key, tokens(F.col("text")).alias("t"))
    weights = term_weights(listed.select(*scope, F.explode(F.array_distinct("t")).alias("term")), corpus_stats(chunks, scope=scope), scope)
    wanted = asked.select(*scope, F.explode("terms").alias("term")).groupBy(*scope, "term").agg(F.count("*").alias("times"))
    wanted = wanted.join(weights, [*scope, "term"]).groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct("term", "times", "idf", "avgdl"))).alias("wanted"))
    tf = lambda w: F.size(F.filter("t", lambda x: x == w["term"]))
    raw = F.aggregate("wanted", F.lit(0.0).cast("double"), lambda sum_, w: sum_ + _impact(w["times"], w["idf"], tf(w), F.size("t"), w["avgdl"]))
    hits = listed.join(wanted, scope).where(F.exists("wanted", lambda w: F.array_contains("t", w["term"])))
    scored = hits.select(*scope, key, raw.alias("raw")).groupBy(*scope, key).agg(F.max("raw").alias("raw"))
    best = scored.groupBy(*scope).agg(F.max("raw").alias("best"))
    return scored.join(best, scope).select(*scope, key, (F.col("raw") / F.when(F.col("best") > 0, F.col("best")).otherwise(1.0)).alias("bm25"))


def _impact(times: Column, idf: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
    return times * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def fuse(semantic: DataFrame, lexical: DataFrame, weight: float = 0.7, key: str = "chunk_id", how: str = "full") -> DataFrame:
    """(key, semantic_score, bm25_score, hybrid_score): weighted sum over the full outer join, missing scores 0."""
    both = semantic.join(lexical, key, how).select(key, F.round(F.coalesce("score", F.lit(0.0)), 6).alias("semantic_score"), F.round(F.coalesce("bm25", F.lit(0.0)), 6).alias("bm25_score"))
    return both.withColumn("hybrid_score", F.round(weight * F.col("semantic_score") + (1 - weight) * F.col("bm25_score"), 7))


def top(scored: DataFrame, k: int, score: str = "hybrid_score", key: str = "chunk_id") -> DataFrame:
    return scored.orderBy(F.desc(score), key).limit(k)


def expand_query(query: Column) -> Column:
    """The query, then up to five terms of the list that starts with the query itself."""
    low = F.lower(query)
    parts = [F.when(low.contains(k), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in EXPANSIONS.items()]
    terms = F.concat(F.array(query), *parts)
    return F.concat(query, F.lit(" "), F.array_join(F.slice(terms, 1, 5), " "))


# ---- relevance of a query to a document, from ranked results (columns of group, rank, score)

# Bounds of the two presets, and weights of the four parts.
PRESETS = {"normal": (0.65, 0.35, 0.40, 0.15), "strict": (0.75, 0.45, 0.50, 0.12)}  # high, low, least top score, most variance
WEIGHTS = (0.4, 0.3, 0.15, 0.15)


def relevance_parts(ranked: DataFrame, group: str = "qid", preset: str = "normal") -> DataFrame:
    """(group, top_score, variance, top_part, distribution_part): from the best five results."""
    most = PRESETS[preset][3]
    first = F.col("rank") <= 5
    out = ranked.groupBy(group).agg(
        F.max("score").alias("top_score"), F.coalesce(F.var_pop(F.when(first, F.col("score"))), F.lit(0.0)).alias("variance"), F.count("*").alias("n"), F.avg(F.when(F.col("rank").between(2, 5), F.col("score"))).alias("rest")
    )
    part = F.when(F.col("variance") > most, F.col("top_score") * 0.8).otherwise(F.col("top_score"))
    spread = F.when(F.col("n") >= 5, F.least(F.lit(1.0), 3 * (F.col("top_score") - F.col("rest"))))
    return out.select(group, "top_score", F.round("variance", 6).alias("variance"), F.round(part, 6).alias("top_part"), F.round(spread, 6).alias("distribution_part"))


def combined_relevance(*parts: Column) -> Column:
    """Weighted mean of the parts that are present; one half if none is."""
    total = sum(F.when(p.isNotNull(), F.lit(w)).otherwise(0.0) for p, w in zip(parts, WEIGHTS, strict=True))
    value = sum(F.coalesce(p, F.lit(0.0)) * w for p, w in zip(parts, WEIGHTS, strict=True))
    return F.when(total > 0, value / total).otherwise(0.5)


def strategy(score: Column, top_score: Column, preset: str = "normal") -> Column:
    """Struct (strategy, confidence, relevance) with the relevance held within 0 and 1."""
    high, low, least, _ = PRESETS[preset]
    name = F.when((score >= high) & (top_score >= least), "search").when(score >= low, "hybrid").otherwise("representative")
    sure = F.when(name == "search", 0.9).when(name == "hybrid", 0.6).otherwise(0.3)
    return F.struct(name.alias("strategy"), sure.alias("confidence"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("relevance"))


def token_overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that the text has; 0 for a query without words."""
    q = F.array_distinct(F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != ""))
    t = F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(0.0)


# ---- retrieval measures over (qid, rank, relevant)


def precision_and_mrr(judged: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, p1, p3, p5, rr) of every query, also of those without results."""
    hit = F.col("relevant")
    per = judged.groupBy("qid").agg(*[(F.count_if(hit & (F.col("rank") <= k)) / float(k)).alias(f"p{k}") for k in (1, 3, 5)], (1.0 / F.min(F.when(hit, F.col("rank")))).alias("rr"))
    return queries.select("qid").distinct().join(per, "qid", "left").select("qid", *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("p1", "p3", "p5", "rr")])


def ranked(scored: DataFrame, group: str, score: str = "score", key: str = "chunk_id") -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), key)))
