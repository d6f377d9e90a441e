"""Word-level BPE encoding and decoding, with tree concatenation for long texts."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, keyed_text, split_rows, text_slices, utf8
from .word_cache import load_tokenizer, piece_table

#: Characters of a leaf of the tree; texts (and white-space-free runs) of over two leaves are encoded by halves.
LEAF_CHARS = 16_384
#: Characters on each side of a join that are encoded anew at first; doubled until both sides agree.
FIRST_WINDOW = 64

Tokens = tuple[np.ndarray, np.ndarray, np.ndarray]  # ids, starts, ends in characters


def encode_leaf(path: str, text: str) -> Tokens:
    e = load_tokenizer(path).encode(text, add_special_tokens=False)
    spans = np.array(e.offsets, np.int64).reshape(-1, 2)
    return np.array(e.ids, np.int64), spans[:, 0], spans[:, 1]


def _first_common(a: Tokens, b: Tokens, backwards: bool) -> tuple[int, int] | None:
    """Places of a token that stands in both lists with the same id, start and end: the last one, or the first."""
    where = {t: i for i, t in enumerate(zip(*(x.tolist() for x in b), strict=True))}
    rows = list(zip(*(x.tolist() for x in a), strict=True))
    for i in range(len(rows) - 1, -1, -1) if backwards else range(len(rows)):
        if (j := where.get(rows[i])) is not None:
            return i, j
    return None


def join_tokens(path: str, text: str, cut: int, left: Tokens, right: Tokens) -> Tokens:
    """Tokens of ``text`` from those of text[:cut] and text[cut:].

    A window around the cut is encoded anew. Where it has a token in common with the left side and
    one with the right side, tokens before the one and after the other stay: every pair of
    neighbours is then one that the merge rules allow, and only one such sequence exists. The
    window doubles until both sides agree, or reaches the ends of the text.
    """
    right = (right[0], right[1] + cut, right[2] + cut)
    reach = FIRST_WINDOW
    while True:
        lo, hi = max(0, cut - reach), min(len(text), cut + reach)
        ids, starts, ends = encode_leaf(path, text[lo:hi])
        window = (ids, starts + lo, ends + lo)
        near_left = int(np.searchsorted(left[1], lo))
        near_right = int(np.searchsorted(right[2], hi, side="right"))
        head = (0, 0) if lo == 0 else _first_common(tuple(x[near_left:] for x in left), window, True)
        tail = (0, 0) if hi == len(text) else _first_common(tuple(x[:near_right] for x in right), window, False)
        if head is not None and tail is not None:
            i, j = (0, 0) if lo == 0 else (near_left + head[0], head[1])
            k, m = (len(right[0]), len(ids)) if hi == len(text) else tail
            if j <= m:
                return tuple(np.concatenate([a[:i], w[j:m], b[k:]]) for a, w, b in zip(left, window, right, strict=True))
        reach *= 2


def join_all(path: str, text: str, cuts: list[int], parts: list[Tokens]) -> Tokens:
    """Tokens of ``text`` from those of its slices: neighbours are joined pairwise, level by level."""
    bounds = [0, *cuts, len(text)]
    spans = list(zip(bounds[:-1], bounds[1:], strict=True))
    while len(parts) > 1:
        next_parts, next_spans = [], []
        for i in range(0, len(parts) - 1, 2):
            (s, c), (_, e) = spans[i], spans[i + 1]
            next_parts.append(join_tokens(path, text[s:e], c - s, parts[i], parts[i + 1]))
            next_spans.append((s, e))
        if len(parts) % 2:
            next_parts.append(parts[-1])
            next_spans.append(spans[-1])
        parts, spans = next_parts, next_spans
    return parts[0]


def leaf_cuts(n: int, leaf: int) -> list[int]:
    """Cuts of n characters by repeated halving until no slice is over a leaf."""
    slices = 1
    while n > slices * leaf:
        slices *= 2
    return [n * i // slices for i in range(1, slices)]


@lru_cache(maxsize=4)
def _check_kind(path: str) -> None:
    tokenizer = load_tokenizer(path)
    if tokenizer.decoder is not None or tokenizer.encode(" \t\n\r\f\v", add_special_tokens=False).ids:
        raise ValueError("the tokenizer has to drop white space and to decode to space-joined tokens")


def bpe_encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every whole text.

    The tokenizer drops white space, so texts of up to two leaves are encoded word by word, each
    distinct word once. Longer texts are cut into a tree of halves wherever the cuts fall; leaves are
    rows of their own that tasks encode in parallel, and each text's leaves are then joined pairwise
    (``join_tokens``). Null and empty texts give no ids and an empty decoded text. Rows are never
    merged: repeated rows each give a row, also those with a null id. An empty table gives an empty table;
    other columns are ignored, whatever their names.
    """
    source = keyed_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    kind = id_type(source)

    def words_kernel(batches):
        _check_kind(tokenizer_path)
        table = piece_table(tokenizer_path, "<i4", False, True)
        for part in text_slices(batches):
            lists = [x.split() for x in utf8(part.column("text"))]
            table.learn(set().union(*lists))
            ids, words, blank = table.ids, table.words, table.blank
            if blank:
                lists = [[w for w in x if w not in blank] for x in lists]
            packed = [b"".join(map(ids.__getitem__, x)) for x in lists]
            offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed)) // 4)])
            values = pa.array(np.frombuffer(b"".join(packed), "<i4"))
            decoded = pa.array([" ".join(map(words.__getitem__, x)) for x in lists], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), decoded], ["doc_id", "ids", "decoded"])

    def leaf_kernel(frames):
        for frame in frames:
            got = [encode_leaf(tokenizer_path, x) for x in frame["piece"]]
            yield frame.assign(ids=[x[0] for x in got], starts=[x[1] for x in got], ends=[x[2] for x in got])

    def join_kernel(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("at")
        text = "".join(frame["piece"])
        cuts = frame["at"].tolist()[1:]
        parts = list(zip(frame["ids"], frame["starts"], frame["ends"], strict=True))
        ids = join_all(tokenizer_path, text, cuts, parts)[0]
        decoded = load_tokenizer(tokenizer_path).decode(ids.tolist(), skip_special_tokens=False)
        return pd.DataFrame({"doc_id": frame["doc_id"].iloc[:1].array, "copies": frame["copies"].iloc[:1].array, "ids": [ids.astype(np.int32)], "decoded": [decoded]})

    out = f"doc_id {kind}, ids array<int>, decoded string"
    long = F.length("text") > 2 * leaf_chars
    short = source.where(~long).mapInArrow(words_kernel, out)

    def cut_kernel(frames):
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                bounds = [0, *leaf_cuts(len(row.text), leaf_chars), len(row.text)]
                rows += [(row.doc_id, row.digest, row.copies, s, row.text[s:e]) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pd.DataFrame(rows, columns=["doc_id", "digest", "copies", "at", "piece"]).astype({"doc_id": frame["doc_id"].dtype})

    whole = source.where(long).groupBy("doc_id", "text").agg(F.count("*").alias("copies")).withColumn("digest", F.sha2("text", 256))
    columns = f"doc_id {kind}, digest string, copies long, at long, piece string"
    leaves = split_rows(whole.mapInPandas(cut_kernel, columns), [F.col("digest"), F.col("at")]).mapInPandas(leaf_kernel, columns + ", ids array<long>, starts array<long>, ends array<long>")
    joined = leaves.groupBy("doc_id", "digest").applyInPandas(join_kernel, f"doc_id {kind}, copies long, ids array<int>, decoded string")
    return short.unionByName(joined.select("doc_id", "ids", "decoded", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc_id", "ids", "decoded"))
