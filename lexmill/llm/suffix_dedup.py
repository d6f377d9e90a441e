"""Removal of repeated byte strings by column-wise construction of a collection's BWT and common prefixes.

The collection is dealt out before it is sorted. Every window of ``min_bytes`` bytes names an anchor:
the least hash among its ``ANCHOR`` byte strings, leftmost among equals. Equal windows name equal
anchors at equal places, so (a) windows of a document that name one anchor form a run, whose bytes
are a *piece*; (b) only pieces of one anchor key can hold equal windows, at the same distance from the
anchor. Pieces are grouped by their bytes; different pieces of a key are the documents of the
construction: each round inserts one symbol of every piece, from right to left, columns counted from
the anchor. A key with more different pieces than one construction takes is dealt by further columns:
its windows fall into a left and a right half by distance from the anchor, the windows of a half all
share more bytes than the anchor, and those bytes are the new key. Halving ends at single windows,
where equal keys are equal windows, so any key comes down to constructions of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free_prefix, id_type, often, release, split_rows, staged, text_slices, utf8

ANCHOR = 32
#: Piece bytes that one construction holds (whole groups; a group has at most GROUP pieces).
BATCH_BYTES = 4 << 20
#: Different pieces of a key that one construction takes; a key with more is dealt by further columns first.
GROUP = 2048

_RNG = np.random.default_rng(20_240_501)
_TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = _RNG.integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of every ``width`` byte string, by doubling."""
    if len(data) < width:
        return np.zeros(0, np.uint64)
    power, size, level = _TABLE[data], 1, 0
    out, done = None, 0
    while True:
        if width & size:  # strings of done+size bytes: those so far, then a power of two
            n = len(data) - done - size + 1
            out = power[:n] if out is None else out[: n] * _STEP[32 + level] + power[done : done + n]
            done += size
        if done == width:
            break
        power = power[:-size] * _STEP[level] + power[size:]
        size, level = 2 * size, level + 1
    out = out ^ (out >> np.uint64(29))
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def anchor_runs(joined: np.ndarray, sizes: np.ndarray, min_bytes: int) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, anchor, key) of each run in documents laid end to end; places count from the document's start."""
    empty = tuple(np.zeros(0, np.int64) for _ in range(5))
    hashes = window_hashes(joined, ANCHOR)
    width = min_bytes - ANCHOR + 1
    if len(hashes) < width:
        return empty
    bits = np.uint64(32)  # the same in every batch: equal windows then choose alike, ties of the upper half go to the left
    least = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: len(hashes) - width + 1], least[width - size :][: len(hashes) - width + 1])
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    begins = np.cumsum(sizes) - sizes
    windows = np.maximum(sizes - min_bytes + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), windows)
    if not len(doc):
        return empty
    window = np.arange(len(doc)) + np.repeat(begins - np.cumsum(windows) + windows, windows)  # starts of windows inside one document
    at = at[window]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(doc)))
    d = doc[first]
    return d, window[first] - begins[d], count, at[first] - begins[d], hashes[at[first]].view(np.int64)


def repeated_starts(pieces: list[bytes], group: np.ndarray, rel: np.ndarray, min_bytes: int) -> np.ndarray:
    """Which columns of which pieces begin a string of ``min_bytes`` that another piece of the group has there too.

    group: rising numbers; rel: place of the anchor in each piece. Column-wise construction: a round
    takes the BWT column (the symbol left of every suffix, in suffix order), moves each suffix to its
    new place by a stable sort on (group, symbol), as the LF mapping does, and updates the common
    prefix of neighbours to one more than the least over the places between them. Since equal
    windows lie in the same column, symbols count as different in different columns, so a round
    reads and writes one column only. Returns booleans [column, piece] and the column of the anchor.
    """
    m = len(pieces)
    size = np.fromiter(map(len, pieces), np.int64, m)
    left = int(rel.max())
    columns = left + int((size - rel).max())
    symbols = np.zeros((m, columns), np.uint16)
    place = np.repeat(np.arange(m) * columns + left - rel - np.cumsum(size) + size, size) + np.arange(size.sum())
    symbols.ravel()[place] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint16) + 1  # 0: no symbol
    symbols = np.ascontiguousarray(symbols.T)
    order = np.arange(m)
    lcp = np.zeros(m, np.int64)
    hit = np.zeros((columns, m), bool)
    for x in range(columns - 1, -1, -1):
        bwt = symbols[x][order]
        key = group[order] * 512 + bwt
        by = np.argsort(key, kind="stable")
        order, key = order[by], key[by]
        same = np.flatnonzero((key[1:] == key[:-1]) & (bwt[by[1:]] > 0)) + 1
        new = np.zeros(m, np.int64)
        if len(same):
            lo, hi = by[same - 1] + 1, by[same] + 1
            edges = np.stack([lo, hi], 1).ravel()
            padded = np.append(lcp, 0)
            new[same] = 1 + np.minimum.reduceat(padded, edges)[::2]
        lcp = new
        long = lcp >= min_bytes
        hit[x, order] = long | np.append(long[1:], False)
    return hit


def _runs(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"a": int(a), "b": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)]


_RUNS = "array<struct<a: int, b: int>>"


def _construct(kinds: DataFrame, min_bytes: int) -> DataFrame:
    """(key, p1, p2, runs): offsets of windows that another piece of the key has too."""

    def batches_of(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(x).to_pylist() for x in ("key", "p1", "p2", "rel", "piece")), strict=True):
                if size >= BATCH_BYTES and row[0] != last:
                    yield held
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
                last = row[0]
        if held:
            yield held

    def kernel(batches):
        for rows in batches_of(batches):
            key = np.array([r[0] for r in rows], np.int64)
            edge = key[1:] != key[:-1]
            several = ~(np.append(True, edge) & np.append(edge, True))  # a piece alone has no partner
            rows = [r for r, more in zip(rows, several.tolist(), strict=True) if more]
            if not rows:
                continue
            keys, p1, p2, rel, pieces = zip(*rows, strict=True)
            key, rel = np.array(keys, np.int64), np.array(rel)
            group = np.cumsum(np.append(0, key[1:] != key[:-1]))
            hit = repeated_starts(list(pieces), group, rel, min_bytes)
            left = int(rel.max())
            out = [_runs(hit[left - r : left - r + len(p) - min_bytes + 1, i]) for i, (r, p) in enumerate(zip(rel.tolist(), pieces, strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(p1, pa.int64()), pa.array(p2, pa.int64()), pa.array(out, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], ["key", "p1", "p2", "runs"])

    return split_rows(kinds.select("key", "p1", "p2", "rel", "piece"), [F.col("key")]).sortWithinPartitions("key").mapInArrow(kernel, f"key long, p1 long, p2 long, runs {_RUNS}").where(F.size("runs") > 0)


def _digest(data: bytes) -> tuple[int, int]:
    """Two signed halves of the 128-bit XXH3 of some bytes."""
    import xxhash

    value = xxhash.xxh3_128_intdigest(data)
    return (value >> 64) - (1 << 63), (value & ((1 << 64) - 1)) - (1 << 63)


def _halves(kinds: DataFrame, min_bytes: int) -> DataFrame:
    """Rows of ``kinds`` cut to the windows left and right of the middle of their range (lo..hi), under keys of the bytes that those windows share."""

    def kernel(batches):
        import xxhash

        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for r in batch.to_pylist():
                piece, rel, mid = r["piece"], r["rel"], (r["lo"] + r["hi"]) // 2
                for lo, hi in ((r["lo"], mid), (mid + 1, r["hi"])):
                    if max(lo, -rel) <= min(hi, len(piece) - min_bytes - rel):
                        cut = max(0, rel + lo)
                        part = piece[cut : rel + hi + min_bytes]
                        shared = piece[rel + hi : rel + lo + min_bytes]
                        out.append((r["key"], r["p1"], r["p2"], cut, xxhash.xxh64_intdigest(shared, lo & 0xFFFF) - (1 << 63), *_digest(part), rel - cut, part, lo, hi))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds_of, strict=True)], names)

    names = ["up_key", "up_p1", "up_p2", "cut", "key", "p1", "p2", "rel", "piece", "lo", "hi"]
    kinds_of = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 3 + [pa.int32(), pa.binary(), pa.int32(), pa.int32()]
    return split_rows(kinds).mapInArrow(kernel, "up_key long, up_p1 long, up_p2 long, cut int, key long, p1 long, p2 long, rel int, piece binary, lo int, hi int")


def _flags(kinds: DataFrame, min_bytes: int, group: int) -> DataFrame:
    """(key, p1, p2, runs) of all windows that occur more than once; a piece may have several rows.

    kinds: key, p1, p2, piece, rel, copies, lo, hi: different pieces by their bytes, p1 and p2 their digest.
    """
    whole = F.array(F.struct(F.lit(0).alias("a"), (F.length("piece") - min_bytes).cast("int").alias("b")))
    flags = kinds.where("copies > 1").select("key", "p1", "p2", whole.alias("runs"))
    big = staged(kinds.where("lo < hi").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > group).select("key"), "big")
    if big.isEmpty():
        return flags.unionByName(_construct(kinds, min_bytes))
    flags = flags.unionByName(_construct(kinds.join(big, "key", "left_anti"), min_bytes))
    halves = staged(_halves(kinds.join(big, "key", "left_semi"), min_bytes), "halves")
    below = _flags(_different(halves, F.lit(1)), min_bytes, group)
    moved = F.transform("runs", lambda r: F.struct((r["a"] + F.col("cut")).cast("int").alias("a"), (r["b"] + F.col("cut")).cast("int").alias("b")))
    joined = halves.drop("piece").join(staged(below, "flags"), ["key", "p1", "p2"])
    return flags.unionByName(joined.select(F.col("up_key").alias("key"), F.col("up_p1").alias("p1"), F.col("up_p2").alias("p2"), moved.alias("runs")))


def _different(pieces: DataFrame, copies: Column) -> DataFrame:
    """Pieces grouped by their bytes, combined before they are shuffled: copies counted, rows counted in ``n``."""
    return staged(pieces.groupBy("key", "p1", "p2", "lo", "hi", "piece").agg(F.sum(copies).alias("copies"), F.first("rel").alias("rel"), F.count("*").alias("n")), "kinds")


def _spans(docs: DataFrame, min_bytes: int, group: int) -> DataFrame:
    """(doc_id, th, spans): repeated byte ranges of documents that have any; docs: doc_id, th, text."""
    kind = id_type(docs)

    def anchor_kernel(batches):
        for part in text_slices(batches):
            datas = utf8(part.column("text"))
            sizes = np.fromiter(map(len, datas), np.int64, len(datas))
            d, s, n, at, key = anchor_runs(np.frombuffer(b"".join(datas), np.uint8), sizes, min_bytes)
            by = np.lexsort((s, key, d))  # a row for each key of a document, with all its runs
            d, s, n, at, key = d[by], s[by], n[by], at[by], key[by]
            first = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (key[1:] != key[:-1]))[: len(d)])
            runs = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (s, at - s, n)], ["s", "rel", "n"])
            runs = pa.ListArray.from_arrays(pa.array(np.append(first, len(d)), pa.int32()), runs)
            who = pa.array(d[first])
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(who), part.column("th").take(who), pa.array(key[first], pa.int64()), runs], ["doc_id", "th", "key", "at"])

    who = f"doc_id {kind}, th long"
    anchors = staged(docs.mapInArrow(anchor_kernel, f"{who}, key long, at array<struct<s: int, rel: int, n: int>>"), "anchors")
    twice = staged(anchors.groupBy("key").agg(F.sum(F.size("at")).alias("c"), F.count("*").alias("n")).where("c > 1").drop("c"), "twice")
    # hot keys are known to be repeated: their rows need no join that would bring them together
    hot = F.broadcast(often(twice, anchors).select("key"))
    repeated = anchors.join(hot, "key", "left_semi").unionByName(anchors.join(hot, "key", "left_anti").join(twice.select("key"), "key", "left_semi"))
    per_doc = staged(repeated.groupBy("doc_id", "th").agg(F.collect_set(F.struct("key", "at")).alias("hits")), "hits")
    discard(anchors, twice)
    release(docs.sparkSession)

    def cut_kernel(batches):
        for part in text_slices(batches):
            found: dict[tuple[int, int, bytes], tuple[int, list[int]]] = {}  # equal pieces of a document are one row
            for i, (data, hits) in enumerate(zip(utf8(part.column("text")), part.column("hits").to_pylist(), strict=True)):
                for h in hits:
                    for r in h["at"]:
                        found.setdefault((i, h["key"], data[r["s"] : r["s"] + r["n"] - 1 + min_bytes]), (r["rel"], []))[1].append(r["s"])
            row_of, key, piece = zip(*found, strict=True) if found else ((), (), ())
            rel, starts = zip(*found.values(), strict=True) if found else ((), ())
            p1, p2 = zip(*map(_digest, piece), strict=True) if found else ((), ())
            at = pa.array(row_of, pa.int64())
            longs = [pa.array(x, pa.int64()) for x in (key, p1, p2)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), part.column("th").take(at), *longs, pa.array(rel, pa.int32()), pa.array(starts, pa.list_(pa.int32())), pa.array(piece, pa.binary())], ["doc_id", "th", "key", "p1", "p2", "rel", "starts", "piece"])

    joined = docs.join(per_doc.select(F.col("doc_id").alias("i"), F.col("th").alias("t"), "hits"), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t"))).select("doc_id", "th", "text", "hits")
    pieces = staged(joined.mapInArrow(cut_kernel, f"{who}, key long, p1 long, p2 long, rel int, starts array<int>, piece binary"), "pieces")
    discard(per_doc)
    release(docs.sparkSession)

    kinds = _different(pieces.withColumns({"lo": F.lit(ANCHOR - min_bytes), "hi": F.lit(0)}), F.size("starts"))
    flags = staged(_flags(kinds, min_bytes, group), "flags")
    where = pieces.select("doc_id", "th", "key", "p1", "p2", "starts")
    same = ["key", "p1", "p2"]
    hot = often(kinds, pieces).select(*same)  # their flags, at most HOT_SHARE pieces' worth, go to the rows
    spans = where.join(F.broadcast(flags.join(F.broadcast(hot), same, "left_semi")), same).unionByName(where.join(F.broadcast(hot), same, "left_anti").join(flags, same))
    spans = spans.select("doc_id", "th", "runs", F.explode("starts").alias("s")).select("doc_id", "th", "s", F.explode("runs").alias("r"))
    spans = spans.select("doc_id", "th", F.struct((F.col("s") + F.col("r.a")).alias("start"), (F.col("s") + F.col("r.b") + min_bytes).alias("end")).alias("span"))
    spans = staged(spans.groupBy("doc_id", "th").agg(F.collect_set("span").alias("spans")), "spans")
    discard(pieces, kinds, flags)
    release(docs.sparkSession)
    return spans


def merge_spans(spans: list[dict]) -> list[tuple[int, int]]:
    """Sorted, touching and overlapping ranges united."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in spans or []):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 200, group: int = GROUP) -> DataFrame:
    """``docs`` with three more columns: ``removed_spans`` (maximal removed byte ranges), ``kept_bytes``, ``text_bytes``.

    A byte is removed if a string of ``min_bytes`` bytes that covers it also starts anywhere else in
    the table, the same text included. Judged on the input. Each row is a document of its own:
    repeated rows, and rows with a null id, count as copies of each other. A null text is empty and
    loses nothing; texts shorter than ``min_bytes`` lose nothing. Columns of ``docs`` with those three
    names are replaced. Whole texts of any length; the only table gathered per text is its own spans.
    An empty table gives an empty table. ``group`` bounds a construction, whatever the input's size.
    """
    if min_bytes < ANCHOR:
        raise ValueError(f"min_bytes has to be at least {ANCHOR}")
    columns = [c for c in docs.columns if c not in ("removed_spans", "kept_bytes", "text_bytes")]
    text, th, i, t, found = (free_prefix(docs.columns) + x for x in ("text", "th", "i", "t", "found"))
    whole = docs.select(*columns, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text)).withColumn(th, F.xxhash64(text))
    spans = _spans(whole.select(F.col(id_col).alias("doc_id"), F.col(th).alias("th"), F.col(text).alias("text")), min_bytes, group)
    spans = spans.select(F.col("doc_id").alias(i), F.col("th").alias(t), F.col("spans").alias(found))
    joined = whole.join(spans, F.col(id_col).eqNullSafe(F.col(i)) & (F.col(th) == F.col(t)), "left").drop(i, t, th)
    schema = ", ".join(f"`{c}` {joined.schema[c].dataType.simpleString()}" for c in columns)

    def kernel(batches):
        for part in text_slices(batches, text):
            spans_of, kept, sizes = [], [], []
            for data, spans in zip(utf8(part.column(text)), part.column(found).to_pylist(), strict=True):
                merged = merge_spans(spans)
                edges = [0, *(x for s in merged for x in s), len(data)]
                spans_of.append([{"start": s, "end": e} for s, e in merged])
                kept.append(b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)))
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(spans_of, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64())], [*columns, "removed_spans", "kept_bytes", "text_bytes"])

    return joined.mapInArrow(kernel, f"{schema}, removed_spans array<struct<start: bigint, end: bigint>>, kept_bytes binary, text_bytes bigint")
