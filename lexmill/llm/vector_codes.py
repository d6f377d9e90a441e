"""Product codes of vectors: integer codebooks fitted on all rows, entries found by partial-distance search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components become floor(SCALE * x).
SCALE = 4096
#: Sizes of integer components from which the squares of a vector could leave 64 bits; such a table is refused.
TOO_LARGE = 1 << 28
#: Rows that a kernel takes at a time.
ROWS = 4096


@dataclass
class Codebooks:
    """books[p]: the entries of part p as rows of integers."""

    books: list[np.ndarray]

    @property
    def dimension(self) -> int:
        return sum(b.shape[1] for b in self.books)

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for b in self.books for x in b.ravel().tolist()).encode()).hexdigest()

    def cuts(self) -> Iterator[tuple[int, int]]:
        at = 0
        for b in self.books:
            yield at, at + b.shape[1]
            at += b.shape[1]


def usable(vector: Column) -> Column:
    """Whether a vector is there and holds finite components only."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def integers(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kept, fitting, matrix): rows without a null or non-finite component, those of them with ``dimension`` components, and the integers of the latter."""
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    kept = valid & (np.bincount(of[~np.isfinite(flat)], minlength=len(sizes)) == 0)
    fits = kept & (sizes == dimension)
    whole = np.floor(flat[fits[of]] * SCALE)
    if whole.size and np.abs(whole).max() >= TOO_LARGE:
        raise ValueError(f"components of {TOO_LARGE // SCALE} and more cannot be coded")
    return kept, fits, whole.astype(np.int64).reshape(int(fits.sum()), dimension)


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry, ties to the lower index, by partial-distance search.

    Dimensions come in descending variance of the codebook. A row's first complete distance is to the
    entry that is nearest in the leading dimension; against every other entry its distance is added up
    dimension by dimension, and a mask drops the row once the sum strictly exceeds its best distance.
    """
    n, width = rows.shape
    if not width:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    spread = len(book) * (book.astype(object) ** 2).sum(axis=0) - book.astype(object).sum(axis=0) ** 2
    dims = sorted(range(width), key=lambda d: (-spread[d], d))
    rows, book = np.ascontiguousarray(rows[:, dims].T), book[:, dims]
    by = np.argsort(book[:, 0], kind="stable")
    values = book[by, 0]
    place = np.clip(np.searchsorted(values, rows[0]), 1, max(1, len(values) - 1))
    if len(values) > 1:
        place -= rows[0] - values[place - 1] <= values[place] - rows[0]
    else:
        place = np.zeros(n, np.int64)
    found = by[place]
    best = ((rows - book[found].T) ** 2).sum(axis=0)
    guessed = found.copy()
    for entry in range(len(book)):
        left = np.flatnonzero(guessed != entry)
        total = np.zeros(len(left), np.int64)
        for d in range(width):
            total += (rows[d, left] - book[entry, d]) ** 2
            alive = total <= best[left]
            if not alive.all():
                left, total = left[alive], total[alive]
            if not len(left):
                break
        better = (total < best[left]) | (entry < found[left])  # what is left is at most the best
        found[left[better]] = entry
        best[left[better]] = total[better]
    return found, best


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _round_sums(vectors: DataFrame, now: Codebooks) -> DataFrame:
    """(part, entry, place, total): sums of the components that went to each entry, and at place -1 their number; a task gives one row for each."""

    def kernel(batches):
        sums = [np.zeros_like(b) for b in now.books]
        counts = [np.zeros(len(b), np.int64) for b in now.books]
        for batch in _slices(batches):
            _, _, rows = integers(batch.column(0), now.dimension)
            for p, (start, stop) in enumerate(now.cuts()):
                part = rows[:, start:stop]
                entry, _ = nearest(part, now.books[p])
                counts[p] += np.bincount(entry, minlength=len(counts[p]))
                np.add.at(sums[p], entry, part)
        out = [(p, e, j, int(t)) for p in range(len(sums)) for e in np.flatnonzero(counts[p]).tolist() for j, t in enumerate([counts[p][e], *sums[p][e]], -1)]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["part", "entry", "place", "total"])

    parts = vectors.mapInArrow(kernel, "part int, entry int, place int, total long")
    return parts.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def first_codebooks(rows: DataFrame, id_col: str, vector_col: str, parts: int, entries: int) -> Codebooks | None:
    """The parts of the first ``entries`` usable rows by id (nulls last, then by vector); none if there are no rows. The first row sets the dimension."""
    first = rows.where(usable(F.col(vector_col))).orderBy(F.col(id_col).asc_nulls_last(), vector_col).select(vector_col).limit(entries).collect()  # a bounded number of rows
    if not first:
        return None
    dimension = len(first[0][0])
    _, _, matrix = integers(pa.array([r[0] for r in first], pa.list_(pa.float64())), dimension)
    return Codebooks([np.ascontiguousarray(x) for x in np.array_split(matrix, parts, axis=1)])


def fit_codebooks(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6) -> Codebooks | None:
    """Codebooks after ``rounds`` rounds over all rows. The driver sees sums by entry only: as many as the codebooks have components."""
    now = first_codebooks(rows, id_col, vector_col, parts, entries)
    if now is None:
        return None
    vectors = rows.select(F.col(vector_col).alias("v"))
    for _ in range(rounds):
        totals: dict[tuple[int, int], dict[int, int]] = {}
        for part, entry, place, total in _round_sums(vectors, now).collect():
            totals.setdefault((part, entry), {})[place] = int(total)
        books = [b.copy() for b in now.books]
        for (part, entry), by_place in totals.items():
            books[part][entry] = [by_place[j] // by_place[-1] for j in range(books[part].shape[1])]
        now = Codebooks(books)
    return now


def _coded(rows: DataFrame, now: Codebooks, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(vec_id, label, code, error) of every row that can be used."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (id_col, label_col)}

    def kernel(batches):
        for batch in _slices(batches):
            kept, fits, matrix = integers(batch.column("v"), now.dimension)
            codes, error = np.zeros((len(matrix), len(now.books)), np.uint8), np.zeros(len(matrix), np.int64)
            for p, (start, stop) in enumerate(now.cuts()):
                codes[:, p], best = nearest(matrix[:, start:stop], now.books[p])
                error += best
            texts, errors = np.full(len(kept), None, object), np.full(len(kept), None, object)
            digits = codes.tobytes().hex()
            wide = 2 * len(now.books)
            texts[fits] = [digits[i : i + wide] for i in range(0, len(digits), wide)]
            errors[fits] = error.tolist()
            out = batch.filter(pa.array(kept))
            yield pa.RecordBatch.from_arrays([out.column("vec_id"), out.column("label"), pa.array(texts[kept].tolist(), pa.string()), pa.array(errors[kept].tolist(), pa.int64())], ["vec_id", "label", "code", "error"])

    narrow = rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    return narrow.mapInArrow(kernel, f"vec_id {kinds[id_col]}, label {kinds[label_col]}, code string, error long")


def vector_codes(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): product code and its squared error for every vector.

    Nothing is shuffled but a row for each codebook component and task, a round, and the errors summed
    by label. The table is read once for the first entries, once a round and twice for the codes.

    Rows whose vector is null or holds a null or non-finite component are left out. Rows with a null or
    repeated id are rows like any other; among the first entries, null ids come last and repeated ids go
    by their vectors. Null labels are one label. Fewer rows than ``entries`` give smaller codebooks, an
    empty table gives no rows, empty vectors have code and error zero. The first row by id sets the
    dimension; vectors of another one take no part in the fit and get a null code and error. Where the
    parts cannot be equal, the first ones are a component longer. Other columns are ignored, whatever
    their names. Components of 65,536 and more raise an error, as sums of squares would not fit 64 bits.
    """
    now = fit_codebooks(rows, id_col, vector_col, parts, entries, rounds)
    if now is None:
        now = Codebooks([np.zeros((1, 0), np.int64)] * parts)
        rows = rows.limit(0)
    coded = _coded(rows, now, id_col, label_col, vector_col)
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    joined = coded.alias("c").join(sums.alias("s"), F.col("c.label").eqNullSafe(F.col("s.label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(now.digest()).alias("codebooks_sha256"))


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The same in DuckDB: one table of codebook entries a round, each made from the one before."""
    near = "arg_min(e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::hugeint * 1000 + e)"
    away = "min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
    ctes = [
        f"kept as materialized (select vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"parts as materialized (select vec_id, label, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] x from kept, range({parts}) r(p))",
        f"c0 as materialized (select p, row_number() over (partition by p order by vec_id) - 1 e, x c from parts where vec_id in (select vec_id from kept order by vec_id limit {entries}))",
    ]
    for i in range(rounds):
        ctes += [
            f"a{i} as materialized (select vec_id, p, any_value(x) x, {near} e from parts join c{i} using (p) group by vec_id, p)",
            f"m{i} as (select p, e, list(m order by j) c from (select p, e, j, floor(sum(y) / count(*))::bigint m from (select p, e, unnest(x) y, unnest(range(len(x))) j from a{i}) group by all) group by all)",
            f"c{i + 1} as materialized (select p, e, coalesce(m.c, o.c) c from c{i} o left join m{i} m using (p, e))",
        ]
    ctes += [
        f"last as (select vec_id, any_value(label) label, string_agg(printf('%02x', e), '' order by p) code, sum(d)::bigint error from (select vec_id, p, any_value(label) label, {near} e, {away} d from parts join c{rounds} using (p) group by vec_id, p) group by vec_id)",
        f"books as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) h from c{rounds})",
    ]
    return "with " + ",\n".join(ctes) + "\nselect vec_id, code, error, (sum(error) over (partition by label))::bigint label_error, h codebooks_sha256 from last, books"
