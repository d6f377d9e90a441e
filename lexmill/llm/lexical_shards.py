"""Ranked lexical search over document shards: postings in CSR form with integer impacts, dense accumulators, top k by shard."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.storage import discard, staged

from .common import KERNEL_BYTES, text_slices, utf8

#: Weights are floor(WEIGHT * ln(...)); an impact is (IMPACT * tf) div (1000 * tf + 12 * m), m = 75 + (25 * n * N) div L.
WEIGHT, IMPACT = 1000, 1_000_000_000
#: Bounds of a shard: text bytes (a longer document is a shard of its own) and documents.
SHARD_BYTES, SHARD_DOCS = 16 << 20, 1 << 16
#: Bytes of a long text that are cut into terms at a time.
PIECE = 4 << 20
#: UTF-8 bytes of query texts that one pass over the shards takes.
QUERY_BYTES = 1 << 20
#: Groups in which a query's results are merged first.
SALTS = 64

#: Separators become spaces, A-Z lower case; all bytes of characters beyond ASCII belong to terms.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(data: bytes) -> list[bytes]:
    """The terms of a text's UTF-8 bytes, in order."""
    return data.translate(_CLEAN).split()


def _pieces(data: bytes) -> Iterator[bytes]:
    """``data`` in pieces of about PIECE bytes that end at a separator."""
    at = 0
    while len(data) - at > PIECE:
        stop, reach = at + PIECE, 1024
        while True:
            gap = data[stop : stop + reach].translate(_CLEAN).find(b" ")
            if gap >= 0 or stop + reach >= len(data):
                break
            reach *= 8
        stop = stop + gap if gap >= 0 else len(data)
        yield data[at:stop]
        at = stop
    yield data[at:]


def _starts(data: bytes) -> np.ndarray:
    """Whether a term starts at each byte."""
    inside = np.frombuffer(data.translate(_CLEAN), np.uint8) != 32
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    return starts


def lengths(datas: list[bytes]) -> np.ndarray:
    """The number of terms of each text, from the starts of terms in the bytes of all; a long text goes by pieces."""
    if len(datas) == 1:
        return np.array([sum(int(np.count_nonzero(_starts(p))) for p in _pieces(datas[0]))])
    before = np.concatenate([[0], np.cumsum(_starts(b" ".join(datas)))])
    ends = np.cumsum([0, *(len(d) + 1 for d in datas)])
    return np.diff(before[np.minimum(ends, len(before) - 1)])


@dataclass
class ShardIndex:
    """Stored shards, one row each: ids (ascending, nulls last), terms (sorted, joined by spaces), starts, docs and impacts of the postings by term."""

    shards: DataFrame
    n_docs: int
    n_terms: int

    def discard(self) -> None:
        discard(self.shards)


class _Shard:
    """Documents gathered until a shard is full."""

    def __init__(self, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.clear()

    def clear(self) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list = []
        self.keys: list[np.ndarray] = []  # term << 32 | document
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: list, datas: list[bytes]) -> None:
        number = self.vocabulary
        taken, held, done = [], 0, []

        def unite() -> None:
            nonlocal taken, held
            done.append(np.unique(np.concatenate(taken), return_counts=True))
            taken, held = [], 0

        for i, data in enumerate(datas, len(self.ids)):
            for piece in _pieces(data):
                words = terms_of(piece)
                for w in words:
                    if w not in number:
                        number[w] = len(number)
                taken.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)) << 32 | i)
                held += len(words)
                if held > PIECE:
                    unite()
        if taken:
            unite()
        keys, counts = (np.concatenate(x) for x in zip(*done, strict=True))
        if len(done) > 1:  # a document may be in several
            keys, of = np.unique(keys, return_inverse=True)
            counts = np.bincount(of, weights=counts).astype(np.int64)
        self.ids += ids
        self.size += sum(map(len, datas))
        self.keys.append(keys)
        self.counts.append(counts)

    def rows(self, kind: pa.DataType) -> pa.RecordBatch:
        """The shard as a row: documents in order of their ids, impacts from term counts and lengths."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] if self.ids[i] is not None else 0))
        keys, tf = np.concatenate(self.keys), np.concatenate(self.counts)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc, term = place[keys & 0xFFFFFFFF], keys >> 32
        words = list(self.vocabulary)
        by_name = sorted(range(len(words)), key=words.__getitem__)
        name = np.empty(len(words), np.int64)
        name[by_name] = np.arange(len(words))
        term = name[term]
        length = np.bincount(doc, weights=tf, minlength=len(order)).astype(np.int64).tolist()
        m = np.array([75 + (25 * n * self.n_docs) // self.n_terms if self.n_terms else 75 for n in length], np.int64)
        by = np.lexsort((doc, term))
        doc, term, tf = doc[by], term[by], tf[by].astype(np.int64)
        impact = (IMPACT * tf) // (1000 * tf + 12 * m[doc])
        starts = np.searchsorted(term, np.arange(len(words) + 1))
        columns = [
            pa.array([[self.ids[i] for i in order]], pa.list_(kind)),
            *[pa.array([x], pa.binary()) for x in (b" ".join(words[i] for i in by_name), starts.astype(np.uint32).tobytes(), doc.astype(np.uint32).tobytes(), impact.astype(np.uint32).tobytes())],
        ]
        return pa.RecordBatch.from_arrays(columns, ["ids", "terms", "starts", "docs", "impacts"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> ShardIndex:
    """Count terms over all documents, then write the shards; texts are read twice and never shuffled.

    A task closes a shard at ``shard_bytes`` of text or SHARD_DOCS documents. Null and empty texts hold no
    term; rows with a null or repeated id are documents of their own.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def count(batches):
        n = total = 0
        for part in text_slices(batches):
            found = lengths(utf8(part.column("text")))
            n += int(np.count_nonzero(found))
            total += int(found.sum())
        yield pa.RecordBatch.from_pydict({"n": [n], "total": [total]})

    n_docs, n_terms = narrow.select("text").mapInArrow(count, "n long, total long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()

    def build(batches):
        shard = _Shard(n_docs, n_terms)
        id_type = None
        for part in text_slices(batches, limit=min(KERNEL_BYTES, shard_bytes)):
            id_type = part.schema.field("doc_id").type
            datas = utf8(part.column("text"))
            if shard.ids and (shard.size + sum(map(len, datas)) > shard_bytes or len(shard.ids) + len(datas) > SHARD_DOCS):
                yield shard.rows(id_type)
                shard.clear()
            shard.add(part.column("doc_id").to_pylist(), datas)
        if shard.ids:
            yield shard.rows(id_type)

    kind = narrow.schema["doc_id"].dataType.simpleString()
    shards = narrow.mapInArrow(build, f"ids array<{kind}>, terms binary, starts binary, docs binary, impacts binary")
    return ShardIndex(staged(shards, "shards"), n_docs, n_terms)


def _blocks(queries: DataFrame, query_bytes: int) -> Iterator[list[tuple]]:
    """(number, id, terms) of the queries that have terms, a block at a time; the driver never holds more than a block."""
    block, size = [], 0
    for n, (item, text) in enumerate(queries.orderBy("id", "text").toLocalIterator()):
        words = terms_of((text or "").encode())
        if not words:
            continue
        if block and size + len(text) > query_bytes:
            yield block
            block, size = [], 0
        block.append((n, item, Counter(words)))
        size += len(text)
    if block:
        yield block


def _lookup(terms: bytes, wanted: dict[bytes, int]) -> dict[int, int]:
    """Wanted terms of a shard: number of the wanted term -> place in the shard."""
    return {wanted[t]: at for at, t in enumerate(terms.split(b" ")) if t in wanted}


def _frequencies(shards: DataFrame, wanted: dict[bytes, int]) -> dict[int, int]:
    """Documents that hold each wanted term; of the shards, only the terms and starts are read."""
    shared = shards.sparkSession.sparkContext.broadcast(wanted)

    def kernel(batches):
        found = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for terms, starts in zip(batch.column("terms").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                ends = np.frombuffer(starts, np.uint32).astype(np.int64)
                for number, at in _lookup(terms, shared.value).items():
                    found[number] += ends[at + 1] - ends[at]
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(found[held], pa.int64())], ["term", "df"])

    counts = shards.select("terms", "starts").mapInArrow(kernel, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r.term: r.df for r in counts.collect()}  # a row for each term of the block at most


def best_of(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0; of equal ones those that come first."""
    if len(scores) > k:
        least = scores[np.argpartition(scores, len(scores) - k)[len(scores) - k :]].min()
        if least > 0:
            above = np.flatnonzero(scores > least)
            taken = np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])
        else:
            taken = np.flatnonzero(scores > 0)
    else:
        taken = np.flatnonzero(scores > 0)
    return taken[np.lexsort((taken, -scores[taken]))]


def _search_block(shards: DataFrame, block: list[tuple], weights: dict[int, int], wanted: dict[bytes, int], k: int) -> DataFrame:
    """(query, doc_id, score): a task's k best documents for each query of the block."""
    kind = shards.schema["ids"].dataType.elementType.simpleString()
    asked = [(n, [(wanted[t], times * weights[wanted[t]]) for t, times in words.items() if weights.get(wanted[t])]) for n, _, words in block]
    shared = shards.sparkSession.sparkContext.broadcast((asked, wanted))

    def kernel(batches):
        asked, wanted = shared.value
        held: dict[int, list[tuple]] = {}
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("ids").type.value_type
            for row in range(batch.num_rows):
                ids = batch.column("ids")[row].values
                terms, starts, docs, impacts = (batch.column(c)[row].as_py() for c in ("terms", "starts", "docs", "impacts"))
                starts, docs, impacts = (np.frombuffer(x, np.uint32) for x in (starts, docs, impacts))
                places = _lookup(terms, wanted)
                scores = np.zeros(len(ids), np.int64)
                for n, weighted in asked:
                    here = [(places[t], w) for t, w in weighted if t in places]
                    if not here:
                        continue
                    scores[:] = 0
                    for at, w in here:
                        span = slice(int(starts[at]), int(starts[at + 1]))
                        scores[docs[span]] += w * impacts[span].astype(np.int64)  # a document is once in a term's postings
                    best = best_of(scores, k)
                    if len(best):
                        rows = held.setdefault(n, [])
                        rows += zip(ids.take(pa.array(best)).to_pylist(), scores[best].tolist(), strict=True)
                        if len(rows) > 2 * k:
                            held[n] = sorted(rows, key=_rank_key)[:k]
        flat = [(n, *r) for n, rows in held.items() for r in sorted(rows, key=_rank_key)[:k]]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], id_type), pa.array([x[2] for x in flat], pa.int64())], ["query", "doc_id", "score"])

    return shards.mapInArrow(kernel, f"query long, doc_id {kind}, score long")


def _rank_key(row: tuple) -> tuple:
    return -row[1], row[0] is None, row[0] if row[0] is not None else 0


def search(index: ShardIndex, queries: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each query with a score above 0, equal scores by ascending id, null ids last.

    Queries are a stated set that meets all shards in blocks of ``query_bytes`` of their texts; a block costs
    a pass over the shards' terms for the document frequencies and one over the postings. Terms repeated
    in a query count as often. A query without a term that a document holds gives no row, as does a null
    one; every row of ``queries`` is a query of its own, whatever its id. Ranks are merged in SALTS groups
    a query first, so no task gets all tasks' results of a query. Other columns are ignored.
    """
    shards, out = index.shards, None
    items = queries.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind, doc_kind = items.schema["id"].dataType.simpleString(), shards.schema["ids"].dataType.elementType.simpleString()
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    for block in _blocks(items, query_bytes):
        wanted = {t: i for i, t in enumerate(sorted({t for _, _, words in block for t in words}))}
        weights = {t: math.floor(WEIGHT * math.log((2 * index.n_docs + 2) / (2 * df + 1))) for t, df in _frequencies(shards, wanted).items()}
        found = _search_block(shards, block, weights, wanted, k)
        salted = Window.partitionBy("query", F.pmod(F.hash("doc_id"), F.lit(SALTS))).orderBy(*order)
        found = found.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= k).drop("rank")
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
        names = shards.sparkSession.createDataFrame([(n, item) for n, item, _ in block], f"query long, item_id {kind}")
        done = staged(found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"), "ranked")  # names: a block
        out = done if out is None else out.unionByName(done)
    return shards.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id {doc_kind}, score long") if out is None else out


def lexical_search(docs: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``search`` over an index of its own, which is deleted after the search."""
    index = build_index(docs)
    found = search(index, queries, k)
    index.discard()
    return found


def oracle(k: int = 20) -> str:
    """The same in DuckDB."""
    terms = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""with held as (select doc_id, unnest({terms}) term from documents),
post as (select doc_id, term, count(*) tf from held group by all), sizes as (select doc_id, sum(tf)::bigint n from post group by 1),
corpus as (select count(*) n_docs, sum(n)::bigint n_terms from sizes),
weighted as (select term, floor({WEIGHT}::double * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint w from post, corpus group by term, n_docs),
asked as (select item_id, unnest({terms}) term from benchmark),
scored as (select item_id, doc_id, sum(w * (({IMPACT} * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::bigint score from asked join weighted using (term) join post using (term) join sizes using (doc_id), corpus group by all),
ranked as (select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from scored where score > 0)
select * from ranked where rank <= {k}"""
