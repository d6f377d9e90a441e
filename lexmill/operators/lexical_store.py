"""A stored lexical index that takes additions and deletions, and exact top-k BM25 for many queries with block-max pruning.

Layout below one folder that all executors share: ``segments/<name>`` holds blocks and terms of what one
call added, ``deleted/<name>`` the documents and term counts that one call took away, ``versions/<number>``
the names that are live. Nothing is changed in place: a call writes what is new, then a version; readers
of earlier versions go on, and of two writers of one version the later fails.

A block holds the postings of one term in one range of documents, and the greatest of their impacts under
an average length a little above that of the index. Impacts grow with the average length, so this bounds
them until the average has grown past it; beyond, the highest count and the least length among the
postings do. Blocks lie in ranges of the term. The documents of a range are a block of the empty term.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions.text import tokens
from lexmill.storage import delete, discard, exists, listed, staged

from .search import EPSILON, K1, B, raw_idf

#: Number of the layout; a folder's name should hold it, so that code never opens what another layout wrote.
LAYOUT = 3
#: Documents of a range.
RANGE_DOCS = 64
#: Ranges of the highest bounds that are scored first, to learn how high a query's results reach.
FIRST_RANGES = 16
#: A block's greatest impact is that under so many times the average length; the index may grow longer texts by as much before bounds get loose.
ROOM = 1.1
#: Scores are rounded to six places before they are ordered, so what is this near to a result may be one.
NEAR = 1e-6
DOCS = ""
BLOCKS = "range long, term string, n int, max_tf int, min_dl int, slots array<int>, tfs array<int>, dls array<int>, keys array<string>"
STORED = f"{BLOCKS}, reach double, impact double"
#: Rows of a version: segments and deletions with their documents and total length, and one row "corpus" with the mean of the terms' raw weights.
VERSION = "kind string, name string, n long, total long, mean double"


def _gather(segment: int, range_docs: int):
    """Kernel from (key, t) to blocks: ranges are rows of one Arrow batch, in order of their lengths, as bounds of like documents are tight. Nothing is shuffled."""

    def kernel(batches):
        made = (segment << 48) | (TaskContext.get().partitionId() << 24)
        for batch in batches:
            batch = batch.take(pc.array_sort_indices(pc.fill_null(pc.list_value_length(batch.column("t")), 0)))
            for at in range(0, batch.num_rows, range_docs):
                yield _blocks(batch.slice(at, range_docs), made)
                made += 1

    return kernel


def _blocks(docs: pa.RecordBatch, number: int) -> pa.RecordBatch:
    size = pc.fill_null(pc.list_value_length(docs.column("t")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = docs.column("t").flatten().dictionary_encode()
    slot, term = np.repeat(np.arange(len(size)), size), words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pairs, tf = np.unique(term * len(size) + slot, return_counts=True)
    term, slot = pairs // len(size), pairs % len(size)
    starts = np.searchsorted(term, np.arange(len(words.dictionary) + 1))
    high, low = (f.reduceat(x, starts[:-1]) if len(tf) else x for f, x in ((np.maximum, tf), (np.minimum, size[slot])))
    n = len(words.dictionary) + 1

    def lists(values: np.ndarray, docs_row: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.append(starts, starts[-1] + len(docs_row)), pa.int32()), pa.array(np.concatenate([values, docs_row]), pa.int32()))

    ends = pa.array(np.append(np.zeros(n, np.int64), len(size)), pa.int32())
    columns = [
        pa.array(np.full(n, number), pa.int64()), pa.concat_arrays([words.dictionary.cast(pa.string()), pa.array([DOCS])]), pa.array(np.append(np.diff(starts), len(size)), pa.int32()), pa.array(np.append(high, 0), pa.int32()), pa.array(np.append(low, 0), pa.int32()),
        lists(slot, np.arange(len(size))), lists(tf, np.zeros(len(size), int)), lists(size[slot], size), pa.ListArray.from_arrays(ends, docs.column("key").cast(pa.string())),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in BLOCKS.split(", ")])


@dataclass
class LexicalStore:
    """The index in ``path`` at one version. ``add``, ``remove`` and ``compact`` return the next one."""

    spark: SparkSession
    path: str
    version: int

    # ---- versions

    @classmethod
    def create(cls, spark: SparkSession, path: str, docs: DataFrame | None = None, **add) -> LexicalStore:
        """An index that is empty or holds ``docs``, complete with its first version. A folder that holds one is refused."""
        if exists(spark, f"{path}/versions"):
            raise ValueError(f"there is an index in {path}")
        new = cls(spark, path, -1)
        return new._commit([]) if docs is None else new.add(docs, **add)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LexicalStore:
        """The latest whole version, whichever session wrote it."""
        whole = [int(name) for name, _, _ in listed(spark, f"{path}/versions") if name.isdigit() and exists(spark, f"{path}/versions/{name}/_SUCCESS")]
        if not whole:
            raise ValueError(f"there is no index in {path}")
        return cls(spark, path, max(whole))

    @property
    def parts(self) -> list:
        """Rows (kind, name, n, total) of live segments and deletions: as many as there were calls since the last compaction."""
        return self.spark.read.schema(VERSION).parquet(f"{self.path}/versions/{self.version}").collect() if self.version >= 0 else []

    def _commit(self, parts: list[tuple]) -> LexicalStore:
        parts = [tuple(p) for p in parts if p[0] != "corpus"]
        n, _ = _sums(parts)
        mean = self._frequencies(parts).agg(F.avg(raw_idf(F.lit(n), F.col("df")))).first()[0]  # one pass over the terms a change, so that a search reads its own terms only
        parts = [*parts, ("corpus", "", n, 0, mean or 0.0)]
        self.spark.createDataFrame(parts, VERSION).coalesce(1).write.parquet(f"{self.path}/versions/{self.version + 1}")  # fails if another writer was first
        return LexicalStore(self.spark, self.path, self.version + 1)

    def drop(self) -> None:
        """Delete the index with all versions."""
        delete(self.spark, self.path)

    # ---- tables

    def _read(self, parts: list, kind: str, table: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{kind}/{p[1]}/{table}" for p in parts if p[0] == kind]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _frequencies(self, parts: list, only: DataFrame | None = None) -> DataFrame:
        """(term, df) over all parts, or of the terms in ``only``."""
        df = self._read(parts, "segments", "terms", "term string, df long").unionByName(self._read(parts, "deleted", "terms", "term string, df long").withColumn("df", -F.col("df")))
        df = df if only is None else df.join(only, "term", "left_semi")
        return df.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    @property
    def blocks(self) -> DataFrame:
        return self._read(self.parts, "segments", "blocks", STORED)

    @property
    def gone(self) -> DataFrame:
        """(range, slot) of deleted documents."""
        return self._read(self.parts, "deleted", "docs", "range long, slot int")

    def keys(self) -> DataFrame:
        """(key, range, slot, dl) of the live documents."""
        rows = self.blocks.where(F.col("term") == DOCS).select("range", F.inline(F.arrays_zip("keys", "slots", "dls"))).select(F.col("keys").alias("key"), "range", F.col("slots").alias("slot"), F.col("dls").alias("dl"))
        return rows.join(self.gone, ["range", "slot"], "left_anti") if self._has("deleted") else rows

    def _has(self, kind: str) -> bool:
        return any(p.kind == kind for p in self.parts)

    def terms(self, only: DataFrame | None = None) -> DataFrame:
        """(term, df, idf, avgdl) as of an index of the live documents alone, of all terms or those in ``only``."""
        parts = self.parts
        n, avgdl = _sums(parts)
        raw = raw_idf(F.lit(n), F.col("df"))
        mean = next((p.mean for p in parts if p.kind == "corpus"), 0.0)
        return self._frequencies(parts, only).select("term", "df", F.when(raw < 0, EPSILON * F.lit(mean)).otherwise(raw).alias("idf"), F.lit(avgdl).alias("avgdl"))

    # ---- changes

    def add(self, docs: DataFrame, key: str = "chunk_id", text: str = "text", toks: Column | None = None, range_docs: int = RANGE_DOCS) -> LexicalStore:
        """Index documents; those whose key is there already replace it. Null texts have no terms, null keys are refused.

        Rows with one key are documents of their own. Texts are read once; only blocks are shuffled, to ranges of their term.
        """
        parts = self.parts
        if any(p.kind == "segments" for p in parts):
            parts = parts + self._gone_rows(docs.select(F.col(key).cast("string").alias("key")).distinct())
        docs = docs.select(key, text) if toks is None else docs
        cores = self.spark.sparkContext.defaultParallelism
        if docs.rdd.getNumPartitions() < cores:  # one large file on many cores
            docs = docs.repartition(cores)
        listed_ = docs.select(F.assert_true(F.col(key).isNotNull(), F.lit("a key is null")).alias("checked"), F.col(key).cast("string").alias("key"), F.coalesce(toks if toks is not None else tokens(F.col(text)), F.array().cast("array<string>")).alias("t"))
        made = staged(listed_.where("checked is null").select("key", "t").mapInArrow(_gather(self.version + 1, range_docs), BLOCKS), "blocks")
        out = self._commit([*parts, self._segment(made, parts)])
        discard(made)
        return out

    def _segment(self, made: DataFrame, parts: list) -> tuple:
        """Write staged blocks as a segment beside ``parts``."""
        name = uuid.uuid4().hex
        folder = f"{self.path}/segments/{name}"
        size = F.aggregate("dls", F.lit(0).cast("long"), lambda s, x: s + x)
        n, total = made.where(F.col("term") == DOCS).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(size), F.lit(0))).first()
        part = ("segments", name, int(n), int(total), 0.0)
        reach = ROOM * max(_sums([part])[1], _sums([*parts, part])[1])
        impact = F.array_max(F.zip_with("tfs", "dls", lambda tf, dl: tf_part(tf, dl, F.lit(reach))))
        full = made.withColumn("reach", F.lit(reach)).withColumn("impact", F.when(F.col("term") != DOCS, impact))
        full.repartitionByRange("term", "range").sortWithinPartitions("term", "range").write.option("compression", "zstd").parquet(f"{folder}/blocks")
        blocks = self.spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
        blocks.where(F.col("term") != DOCS).groupBy("term").agg(F.sum("n").alias("df")).write.parquet(f"{folder}/terms")
        return part

    def _gone_rows(self, keys: DataFrame) -> list[tuple]:
        """Write the deletion of the live documents with these keys; its version row, or none if there is none."""
        name = uuid.uuid4().hex
        folder = f"{self.path}/deleted/{name}"
        self.keys().join(keys, "key", "left_semi").select("range", "slot", "dl").write.parquet(f"{folder}/docs")
        gone = self.spark.read.schema("range long, slot int, dl int").parquet(f"{folder}/docs")
        n, total = gone.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        if not n:
            return []
        held = self.blocks.where(F.col("term") != DOCS).select("term", "range", F.explode("slots").alias("slot")).join(gone.select("range", "slot"), ["range", "slot"], "left_semi")
        held.groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{folder}/terms")
        return [("deleted", name, int(n), int(total), 0.0)]

    def remove(self, keys: DataFrame, key: str = "chunk_id") -> LexicalStore:
        """Delete all documents with these keys; unknown and null keys are passed over."""
        return self._commit([*self.parts, *self._gone_rows(keys.select(F.col(key).cast("string").alias("key")).distinct())])

    def compact(self, range_docs: int = RANGE_DOCS) -> LexicalStore:
        """One segment of the live documents in place of all parts, without their texts: blocks are taken apart and dealt anew.

        A document's postings meet by (range, slot), at most as many as it has terms.
        """
        live = self.blocks.where(F.col("term") != DOCS).select("range", "term", F.inline(F.arrays_zip("slots", "tfs"))).withColumnsRenamed({"slots": "slot", "tfs": "tf"})
        by_doc = live.groupBy("range", "slot").agg(F.flatten(F.collect_list(F.array_repeat("term", F.col("tf")))).alias("t"))
        rows = self.keys().join(by_doc, ["range", "slot"], "left").select("key", F.coalesce("t", F.array().cast("array<string>")).alias("t"))
        made = staged(rows.mapInArrow(_gather(self.version + 1, range_docs), BLOCKS), "blocks")
        out = self._commit([self._segment(made, [])])
        discard(made)
        return out

    # ---- search

    def _asked(self, queries: DataFrame, qid: str, toks: Column) -> DataFrame:
        """(qid, term, weight, avgdl) of the queries' terms that the index knows; repeated terms weigh more."""
        words = queries.select(F.col(qid).alias("qid"), F.explode(toks).alias("term")).groupBy("qid", "term").agg(F.count("*").cast("double").alias("times"))
        words = staged(words, "words")
        return words.join(self.terms(words.select("term")), "term").select("qid", "term", (F.col("times") * F.col("idf")).alias("weight"), "avgdl")

    def plan(self, asked: DataFrame) -> DataFrame:
        """(qid, range, bound, place): no document of the range scores above bound; places go from the highest bound down."""
        heads = self.blocks.where(F.col("term") != DOCS).select("term", "range", "max_tf", "min_dl", "reach", "impact")
        most = F.when(F.col("reach") >= F.col("avgdl"), F.col("impact")).otherwise(tf_part(F.col("max_tf"), F.col("min_dl"), F.col("avgdl")))
        bounds = asked.join(heads, "term").groupBy("qid", "range").agg(F.sum(F.greatest(F.lit(0.0), F.col("weight")) * most).alias("bound"))
        return bounds.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bound"), "range")))

    def score(self, asked: DataFrame, pairs: DataFrame) -> DataFrame:
        """(qid, range, slot, raw): scores of all documents of the given (qid, range) that hold a term of the query."""
        wanted = asked.join(pairs.select("qid", "range"), "qid")
        hits = wanted.join(self.blocks.where(F.col("term") != DOCS).select("term", "range", "slots", "tfs", "dls"), ["term", "range"]).select("qid", "range", "weight", "avgdl", F.inline(F.arrays_zip("slots", "tfs", "dls")))
        scored = hits.groupBy("qid", "range", F.col("slots").alias("slot")).agg(F.sum(F.col("weight") * tf_part(F.col("tfs"), F.col("dls"), F.col("avgdl"))).alias("raw"))
        return scored.join(self.gone, ["range", "slot"], "left_anti") if self._has("deleted") else scored

    def score_documents(self, asked: DataFrame, pairs: DataFrame) -> DataFrame:
        """(qid, key, raw) of the given (qid, key): only these documents' places of their blocks are looked at."""
        placed = pairs.select("qid", "key").join(self.keys(), "key")
        hits = asked.join(placed, "qid").join(self.blocks.where(F.col("term") != DOCS).select("term", "range", "slots", "tfs", "dls"), ["term", "range"]).withColumn("at", F.array_position("slots", F.col("slot")).cast("int")).where("at > 0")
        return hits.select("qid", "key", "range", "slot", "weight", "avgdl", F.element_at("tfs", F.col("at")).alias("tf"), "dl").groupBy("qid", "key").agg(F.sum(F.col("weight") * tf_part(F.col("tf"), F.col("dl"), F.col("avgdl"))).alias("raw"))

    def search(self, queries: DataFrame, k: int = 10, qid: str = "qid", toks: Column | None = None, report: dict | None = None) -> DataFrame:
        """(qid, key, raw, bm25, rank): the k best documents of every query, bm25 over the query's best score; ties by key.

        Each query first scores the FIRST_RANGES ranges with the highest bounds. Of the others only those
        are scored whose bound reaches the k-th of these scores; the result is that of scoring all.
        Queries without a known term give no row. report gets the numbers of (query, range) pairs and how many were scored.
        """
        asked = staged(self._asked(queries, qid, toks if toks is not None else tokens(F.col("query"))), "asked")
        plan = staged(self.plan(asked), "plan")
        first = staged(self.score(asked, plan.where(F.col("place") <= FIRST_RANGES)), "scores")
        order = Window.partitionBy("qid").orderBy(F.desc("raw"), "range", "slot")
        reach = first.withColumn("i", F.row_number().over(order)).where(F.col("i") == k).select("qid", F.col("raw").alias("reach"))
        top = plan.where("place = 1").select("qid", F.col("bound").alias("highest"))
        left = plan.where(F.col("place") > FIRST_RANGES).join(top, "qid").join(reach, "qid", "left")
        left = staged(left.where(F.col("reach").isNull() | (F.col("bound") >= F.col("reach") - NEAR * F.col("highest"))).select("qid", "range"), "left")
        if report is not None:
            report |= {"pairs": plan.count(), "scored": plan.where(F.col("place") <= FIRST_RANGES).count() + left.count()}
        scored = first.unionByName(self.score(asked, left))
        best = F.max("raw").over(Window.partitionBy("qid"))
        bm25 = F.round(F.col("raw") / F.when(F.col("best") > 0, F.col("best")).otherwise(1.0), 6)
        # a tie at the end may be decided by the key, so all that is near to the k-th is named first
        ranked = scored.withColumn("best", best).withColumn("bm25", bm25).withColumn("i", F.rank().over(Window.partitionBy("qid").orderBy(F.desc("bm25")))).where(F.col("i") <= k)
        named = ranked.join(self.keys().select("key", "range", "slot"), ["range", "slot"])
        place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bm25"), "key"))
        return named.withColumn("rank", place).where(F.col("rank") <= k).select("qid", "key", F.round("raw", 6).alias("raw"), "bm25", "rank")


def tf_part(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What a term's count in a document of length dl multiplies its weight by; grows with tf and avgdl and falls with dl."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _sums(parts: list) -> tuple[int, float]:
    """(n, avgdl) of the live documents."""
    sign = {"segments": 1, "deleted": -1}
    n, total = (sum(sign.get(p[0], 0) * p[i] for p in parts) for i in (2, 3))
    return n, total / n if n else 0.0
