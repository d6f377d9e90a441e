"""Benchmark decontamination: q-gram lemma filter over overlapping diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import id_type, keyed_text, staged, text_column, text_slices, texts

Q = 8
#: Shorter q-grams for items that are too short for Q: with e edits, an item of m characters needs q * (e + 1) <= m.
SHORT_Q = (5, 3, 2, 1)
#: Length of the q-grams that are counted once more inside a candidate region: shorter ones leave fewer false candidates.
REGION_Q = 4
#: Edits allowed, as a share of a passage's characters.
EDITS = 0.1
#: Benchmark characters of one pass over the documents. What is broadcast is at most about 40 bytes for each,
#: plus one item; a larger benchmark takes more passes.
BLOCK_CHARS = 2 << 20
#: Places of q-grams in the benchmark that one step looks at; bounds a step's memory, whatever the passages have in common.
STEP_PLACES = 1 << 19
_BITS = 22
_ODD = np.uint64(0x9E3779B97F4A7C15)


def normalise(text: str) -> str:
    """Lower case, white space runs as one space, trimmed."""
    return " ".join(text.replace("\0", " ").lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = codes.astype(np.uint64)
    out = wide[:n].copy()
    for i in range(1, q):
        out *= np.uint64(1_000_003)
        out += wide[i : i + n]
    out ^= out >> np.uint64(31)
    out *= _ODD
    return out


@dataclass
class Benchmark:
    """Items that q-grams of one length serve: hash -> (item, place), with each item's edit budget and least count."""

    q: int
    ids: list
    patterns: list[str]
    budget: np.ndarray
    least: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    bitmap: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple], q: int, edits: float) -> Benchmark:
        """q = 0: items that are looked for as they are."""
        ids, patterns = [r[0] for r in rows], [r[1] for r in rows]
        size = np.array([len(p) for p in patterns], np.int64)
        budget = (edits * size).astype(np.int64)
        codes = [gram_hashes(_codes(p), q) if q else np.zeros(0, np.uint64) for p in patterns]
        counts = np.array([len(c) for c in codes], np.int64)
        flat = np.concatenate([np.zeros(0, np.uint64), *codes])
        item = np.repeat(np.arange(len(rows)), counts)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
        by = np.argsort(flat, kind="stable")
        grams, first = np.unique(flat[by], return_index=True)
        bitmap = np.zeros(1 << _BITS, bool)
        bitmap[grams >> np.uint64(64 - _BITS)] = True
        return cls(q, ids, patterns, budget, size - q + 1 - q * budget, grams, np.append(first, len(flat)), item[by].astype(np.int32), place[by].astype(np.int32), bitmap)


def index_items(rows: list[tuple], q: int, edits: float) -> list[Benchmark]:
    """Items (id, normalised text) by the longest q-grams, of ``q`` and SHORT_Q, that their edit budget leaves some of."""
    tiers: dict[int, list[tuple]] = {}
    for row in rows:
        m, e = len(row[1]), int(edits * len(row[1]))
        if m:
            fits = [x for x in (q, *SHORT_Q) if x <= q and x * (e + 1) <= m]
            tiers.setdefault(fits[0] if fits and (e or m >= q) else 0, []).append(row)
    return [Benchmark.of(part, tier, edits) for tier, part in sorted(tiers.items())]


def align(pattern: np.ndarray, region: np.ndarray, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best match of the whole pattern inside the region, if within the budget.

    The band: diagonals from -budget to what the lengths leave, plus the budget. Among equal edits the
    earliest end, then the earliest start.
    """
    m, n = len(pattern), len(region)
    width = n - m + 2 * budget
    if n + budget < m:
        return None
    lead = np.arange(width + 1, dtype=np.int64)
    big = 1 << 32
    padded = np.concatenate([np.full(budget, 0xFFFFFFFF, np.uint32), region, np.full(m + width + 2, 0xFFFFFFFF, np.uint32)])
    row = np.where((lead >= budget) & (lead - budget <= n), lead - budget, big * (m + n + 1))  # edits * big + start
    for i in range(m):
        step = row + big * (padded[i : i + width + 1] != pattern[i])
        step[:-1] = np.minimum(step[:-1], row[1:] + big)
        row = np.minimum.accumulate(step - lead * big) + lead * big
    row = row[: n - m + budget + 1]
    at = int(np.argmin(row // big))
    edits, start = divmod(int(row[at]), big)
    return (edits, start, m + at - budget) if edits <= budget else None


def may_match(pattern: np.ndarray, region: np.ndarray, budget: int) -> bool:
    """q-gram lemma inside a region: whether enough of the pattern's REGION_Q-grams occur there."""
    grams = gram_hashes(pattern, REGION_Q)
    return int(np.isin(grams, gram_hashes(region, REGION_Q)).sum()) >= len(grams) - REGION_Q * budget


def _candidates(bench: Benchmark, pos: np.ndarray, gram: np.ndarray) -> Iterator[tuple[int, int]]:
    """(item, band) of neighbouring bands with enough hits. pos: rising places of hits, gram: their number in the benchmark.

    Hits are taken in steps of about STEP_PLACES places; a band's count is carried on until the text has passed it.
    """
    offset = max(map(len, bench.patterns)) + 1
    size = np.array([len(p) for p in bench.patterns], np.int64)
    n = bench.first[gram + 1] - bench.first[gram]
    upto = np.cumsum(n)
    keys, counts, at = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    while at < len(pos):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STEP_PLACES, side="right")))
        m = n[at:stop]
        where = np.repeat(bench.first[gram[at:stop]] - np.cumsum(m) + m, m) + np.arange(int(m.sum()))
        item = bench.item[where].astype(np.int64)
        band = (np.repeat(pos[at:stop], m) - bench.place[where] + offset) // (bench.budget[item] + 1)
        found, times = np.unique(item << 40 | band, return_counts=True)
        keys, back = np.unique(np.concatenate([keys, found]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([counts, times]), len(keys)).astype(np.int64)
        item, band = keys >> 40, keys & ((1 << 40) - 1)
        passed = (band + 2) * (bench.budget[item] + 1) - offset + size[item] < (pos[stop] if stop < len(pos) else np.iinfo(np.int64).max)
        follows = np.append(keys[1:] == keys[:-1] + 1, False)
        both = counts + np.where(follows, np.append(counts[1:], 0), 0)
        for key in keys[passed & (both >= bench.least[item])].tolist():
            yield key >> 40, key & ((1 << 40) - 1)
        keys, counts, at = keys[~passed], counts[~passed], stop


def find_passages(docs: list[str], benches: list[Benchmark]) -> Iterator[tuple[int, object, int, int, int]]:
    """(document, item id, start, end, edits) of passages in normalised documents: the best one for each pair."""
    codes = _codes("\0".join(docs) + "\0")
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    begins = np.cumsum(sizes + 1) - sizes - 1
    for bench in benches:
        for (d, j), (edits, s, t) in sorted(_in_tier(docs, codes, sizes, begins, bench).items()):
            yield d, bench.ids[j], s, t, edits


def _in_tier(docs: list[str], codes: np.ndarray, sizes: np.ndarray, begins: np.ndarray, bench: Benchmark) -> dict[tuple[int, int], tuple[int, int, int]]:
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    if not bench.q:
        for j, pattern in enumerate(bench.patterns):
            for d, text in enumerate(docs):
                if (at := text.find(pattern)) >= 0:
                    found[d, j] = (0, at, at + len(pattern))
        return found
    hashes = gram_hashes(codes, bench.q)
    pos = np.flatnonzero(bench.bitmap[hashes >> np.uint64(64 - _BITS)])
    gram = np.minimum(np.searchsorted(bench.grams, hashes[pos]), len(bench.grams) - 1)
    ok = bench.grams[gram] == hashes[pos]
    del hashes
    offset = max(map(len, bench.patterns)) + 1
    for j, b in _candidates(bench, pos[ok], gram[ok]):
        # bands b and b+1 overlap those before and after by half, so one pair holds all hits of a match
        e, pattern = int(bench.budget[j]), bench.patterns[j]
        lo, hi = b * (e + 1) - offset - e, (b + 2) * (e + 1) - offset + len(pattern) + e
        d = max(0, int(np.searchsorted(begins, lo, side="right")) - 1)
        while d < len(docs) and begins[d] < hi:
            s, t = max(0, lo - int(begins[d])), min(int(sizes[d]), hi - int(begins[d]))
            if t > s and found.get((d, j), (e + 1,))[0]:
                exact = docs[d].find(pattern, s, t)
                if exact >= 0:
                    got = (0, exact - s, exact - s + len(pattern))
                else:
                    region, symbols = codes[begins[d] + s : begins[d] + t], _codes(pattern)
                    got = align(symbols, region, e) if may_match(symbols, region, e) else None
                if got and got < found.get((d, j), (e + 1,)):
                    found[d, j] = (got[0], got[1] + s, got[2] + s)
            d += 1
    return found


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """Items in blocks of at most BLOCK_CHARS normalised characters, or one item."""
    held, size = [], 0
    for row in benchmark.toLocalIterator():
        pattern = normalise(row[1] or "")
        if held and size + len(pattern) > BLOCK_CHARS:
            yield held
            held, size = [], 0
        held.append((row[0], pattern))
        size += len(pattern)
    if held:
        yield held


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", q: int = Q, edits: float = EDITS
) -> DataFrame:
    """(doc_id, item_id, start, end, edits): benchmark items that a document holds, one row for each pair.

    A document holds an item if some part of it differs by at most ``edits`` times the item's length
    in characters, after ``normalise`` of both; start and end count characters of the normalised
    document and give the best match. q-gram lemma: with e edits, at least m - q + 1 - q*e of the
    item's q-grams stay, on diagonals at most e apart; pairs of neighbouring bands of e+1 diagonals
    that share fewer are discarded, the rest is verified by banded alignment. Items too short for q
    take shorter q-grams, with the same share of edits; those too short for any edit are looked for as they are.
    Null or empty items match nothing; null and empty documents hold nothing; an empty table gives no row.
    Repeated rows, and repeated items, each give rows. Ids may be of any type; other columns of either table are
    not read. Documents are read once for each block of the benchmark (``BLOCK_CHARS``) and never shuffled.
    """
    source = keyed_text(docs, id_col, text_col)
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    kinds = id_type(source), id_type(items, "item_id")
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, start long, end long, edits int"
    spark = docs.sparkSession
    item_type = to_arrow_type(items.schema["item_id"].dataType)

    def one_pass(rows: list[tuple]) -> DataFrame:
        shared = spark.sparkContext.broadcast(index_items(rows, q, edits))

        def kernel(batches):
            bench = shared.value
            for part in text_slices(batches):
                rows = list(find_passages([normalise(x) for x in texts(part.column("text"))], bench))
                if rows:
                    d, j, s, t, e = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(d)), pa.array(j, item_type), pa.array(s, pa.int64()), pa.array(t, pa.int64()), pa.array(e, pa.int32())], ["doc_id", "item_id", "start", "end", "edits"])

        return source.mapInArrow(kernel, schema)

    out = None
    for rows in _blocks(items):
        found = one_pass(rows)
        out = found if out is None else staged(out, "leaks").unionByName(staged(found, "leaks"))
    return out if out is not None else spark.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", q: int = Q, edits: float = EDITS) -> DataFrame:
    """The rows of ``docs`` whose own text holds no benchmark item, whatever other rows share their id; all columns as they were.

    ``find_contamination`` says what holding an item is. Each block of the benchmark reads what the block before it left.
    """
    spark = docs.sparkSession

    def without(rows: list[tuple], left: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(index_items(rows, q, edits))

        def start():
            bench = shared.value

            def clean(part: pa.Array) -> pa.Array:
                out = np.ones(len(part), bool)
                out[[d for d, *_ in find_passages([normalise(x) for x in texts(part)], bench)]] = False
                return pa.array(out)

            return clean

        return left.where(text_column(start, "boolean")(F.col(text_col).cast("string")))

    out = docs
    for n, rows in enumerate(_blocks(benchmark.select(item_col, item_text_col))):
        out = without(rows, staged(out, "clean") if n else out)
    return out
