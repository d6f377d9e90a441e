"""Quality rules: counts over words and lines, and suffix-array repetition inside each text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, keyed_text, text_slices, utf8

_SPACE, _SYMBOL, _FOLLOW = np.zeros((3, 256), bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL[list(b"#*$%&|<>")] = True
_FOLLOW[128:192] = True  # UTF-8 continuation bytes
_PIECE = 1 << 20
_GAP, _BREAK = re.compile(rb"[ \t-\r]"), re.compile(rb"\n")


def _pieces(data: bytes, at_gap: re.Pattern) -> Iterator[bytes]:
    """The text in pieces of about a mebibyte that end before a gap."""
    start = 0
    while start < len(data):
        gap = at_gap.search(data, max(start + 1, start + _PIECE))
        stop = gap.start() if gap else len(data)
        yield data[start:stop]
        start = stop


def _count(table: np.ndarray, data: bytes) -> int:
    view = np.frombuffer(data, np.uint8)
    return sum(int(np.count_nonzero(table[view[i : i + _PIECE]])) for i in range(0, len(view), _PIECE))


def _dup_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier one. A piece behind the first begins with the line break before it, so its first line is empty."""
    seen, n = set(), 0
    for piece in _pieces(data, _BREAK):
        kept = [y for y in piece.split(b"\n") if y.strip()]
        seen.update(kept)
        n += len(kept)
    return n - len(seen)


def suffix_order(words: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix array of many short sequences at once, by prefix doubling; sequence by sequence, a suffix before those that go on from it.

    words: word numbers, doc: the sequence that each belongs to (rising), ends: per word, the end of its sequence.
    Suffixes are compared inside their own sequence only. A round sorts only the suffixes that still tie.
    """
    n = len(words)
    key = doc.astype(np.int64) * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable").astype(np.int32)
    head = np.ones(n + 1, bool)
    head[1:n] = key[order[1:]] != key[order[:-1]]
    del key
    rank, k = np.empty(n, np.int32), 1
    starts = np.flatnonzero(head[:n]).astype(np.int32)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    while True:
        head[1:n] = rank[order[1:]] != rank[order[:-1]]
        slots = np.flatnonzero(~(head[:n] & head[1:])).astype(np.int32)  # places of suffixes that tie
        if not len(slots):
            return order
        p = order[slots]
        inside = p < ends[p] - k
        both = np.zeros(len(p), np.int64)
        both[inside] = rank[p[inside] + k] + 1
        both += rank[p] * np.int64(n + 1)
        by = np.argsort(both, kind="stable")
        p, both = p[by], both[by]
        del by
        order[slots] = p
        new = np.ones(len(p), bool)
        new[1:] = both[1:] != both[:-1]
        del both
        first = np.flatnonzero(new)
        rank[p] = np.repeat(slots[first], np.diff(np.append(first, len(p))))
        k *= 2


def common_prefixes(words: np.ndarray, doc: np.ndarray, ends: np.ndarray, order: np.ndarray) -> np.ndarray:
    """lcp[i]: common prefix of order[i-1] and order[i] in words, 0 across sequences.

    Where the words before a suffix and before its predecessor in the order are equal, its common prefix is that of the suffix one
    word earlier, less one. Only the others are compared word by word; their lengths sum to at most 2 n log n.
    """
    n = len(words)
    before = np.full(n, -1, np.int32)  # predecessor in the order, by place
    same = doc[order[1:]] == doc[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    fixed = np.ones(n, bool)
    fixed[1:] = (before[1:] <= 0) | (doc[1:] != doc[:-1]) | (words[:-1] != words[before[1:] - 1])
    other = np.flatnonzero(~fixed & (before >= 0)) if n else np.empty(0, np.int64)
    fixed[other[doc[before[other] - 1] != doc[other]]] = True  # the predecessor begins its sequence
    del other
    length = np.zeros(n, np.int32)
    p = np.flatnonzero(fixed & (before >= 0)).astype(np.int32)
    q = before[p]
    for step in range(32):
        room = np.maximum(p, q) < ends[p] - step
        p, q = p[room], q[room]
        equal = words[p + step] == words[q + step]
        p, q = p[equal], q[equal]
        length[p] += 1
    for a, b in zip(p.tolist(), q.tolist(), strict=True):
        most, at, block = int(ends[a]) - max(a, b), 32, 64
        while at < most:
            take = min(block, most - at)
            differ = words[a + at : a + at + take] != words[b + at : b + at + take]
            if differ.any():
                at += int(differ.argmax())
                break
            at, block = at + take, block * 2 if block < _PIECE else block
        length[a] = at
    base = np.maximum.accumulate(np.where(fixed, np.arange(n, dtype=np.int32), 0))
    length = length[base] - (np.arange(n, dtype=np.int32) - base)
    return length[order]


def _covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any [start, start+length)."""
    edge = np.bincount(start, minlength=n + 1)
    edge -= np.bincount(start + length, minlength=n + 1)
    return np.cumsum(edge[:n], out=edge[:n]) > 0


def measure(datas: list[bytes], min_repeat: int) -> dict[str, np.ndarray]:
    """The counts of each UTF-8 text; min_repeat: words from which a repeat counts as a long one."""
    m = len(datas)
    numbers, seen, n_words = [], {}, np.zeros(m, np.int64)
    for i, data in enumerate(datas):
        for piece in _pieces(data, _GAP):
            words = piece.split()
            numbers.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words)))
            n_words[i] += len(words)
    each = lambda count: np.fromiter(map(count, datas), np.int64, m)
    out = {
        "n_words": n_words,
        "word_chars": each(lambda x: len(x) - _count(_FOLLOW, x) - _count(_SPACE, x)),
        "n_symbols": each(lambda x: _count(_SYMBOL, x)),
        "n_dup_lines": each(_dup_lines),
        "n_repeat_words": np.zeros(m, np.int64), "covered_words": np.zeros(m, np.int64), "longest_repeat": np.zeros(m, np.int64),
    }
    del seen
    if total := int(n_words.sum()):
        number = np.concatenate(numbers)
        del numbers
        doc = np.repeat(np.arange(m, dtype=np.int32), n_words)
        ends = np.repeat(np.cumsum(n_words).astype(np.int32), n_words)
        order = suffix_order(number, doc, ends)
        lcp = common_prefixes(number, doc, ends, order)
        best = np.empty(total, np.int32)  # longest repeat that starts at each word
        best[order] = np.maximum(lcp, np.append(lcp[1:], np.int32(0)))
        del number, ends, order, lcp
        for name, least, fixed in (("n_repeat_words", 5, 5), ("covered_words", min_repeat, None)):
            start = np.flatnonzero(best >= least)
            out[name] = np.bincount(doc[_covered(start, fixed or best[start], total)], minlength=m)
        np.maximum.at(out["longest_repeat"], doc, best)
    return out


def repetition_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = 10, max_covered: float = 0.15, max_longest: int = 100
) -> DataFrame:
    """Word and line counts of every text and the verdict of the repetition rules.

    Inside each text, common-prefix intervals of the word suffix array give the maximal repeated
    word sequences. A text is kept if the base rules pass, repeats of at least ``min_repeat`` words
    cover at most ``max_covered`` of its words, and no repeat is longer than ``max_longest`` words.
    Null and empty texts have no words, so the base rules fail. Repeated rows each give a row. A text
    is never cut; a text of any length is one array of its own words. An empty table gives an empty table;
    other columns are ignored, whatever their names.
    """
    source = keyed_text(docs, id_col, text_col)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]

    def kernel(batches):
        for part in text_slices(batches):
            got = measure(utf8(part.column("text")), min_repeat)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(got[x]) for x in names)], ["doc_id", *names])

    out = source.mapInArrow(kernel, f"doc_id {id_type(source)}, " + ", ".join(f"{x} long" for x in names))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    verdict = (F.col("covered_words") <= max_covered * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict)
