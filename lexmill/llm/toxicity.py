"""Toxicity by a classifier chain: each category's linear model also sees the categories before it.

The label table marks toxicity as a whole. Its finer categories are learnt: marked rows fall into
KINDS clusters by the words that tell them from unmarked ones, and a row of a kind is positive for it.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_type, keyed_text, staged, text_column, text_slices, texts
from .sampling import hash_sample, one_label, one_text

#: Labelled rows from which models are fitted, at most (about; chosen by a hash of the id).
FIT_ROWS = 20_000
#: Word features that the models see; a word that few toxic texts have may not be among them. Held-out recall at sf0.1 is
#: 0.85 with 400 and 0.88 with 1,000.
FEATURES = 1000
FOLDS = 5
THRESHOLD = 0.4

#: Kinds of toxic texts that come before the whole in the chain.
KINDS = 2
CATEGORIES = [*(f"kind_{k + 1}" for k in range(KINDS)), "toxic"]
_WORD = re.compile(r"\w+")


def word_features(word: str) -> list[str]:
    """The word itself and its beginnings of 4 to 7 characters."""
    return ["=" + word, *(f"^{word[:k]}" for k in (4, 5, 6, 7) if len(word) >= k)]


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


@dataclass
class Chain:
    features: dict[str, int]
    weights: list[np.ndarray]  # for each category: features, categories before it, constant
    known: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def rows(self, docs: list[set[str]]) -> np.ndarray:
        """Which features each document has."""
        out = np.zeros((len(docs), len(self.features)), np.float32)
        if len(self.known) > 200_000:
            self.known.clear()
        for word in set().union(*docs) - self.known.keys():
            self.known[word] = tuple(i for x in word_features(word) if (i := self.features.get(x)) is not None)
        telling = {w for w, x in self.known.items() if x}
        for i, words in enumerate(docs):
            for word in words & telling:
                out[i, list(self.known[word])] = 1
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the categories, in order."""
        got = np.zeros((len(x), 0), np.float32)
        for w in self.weights:
            got = np.column_stack([got, probability(np.column_stack([x, got]), w)])
        return got


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray | None = None, penalty: float = 0.2, steps: int = 15) -> np.ndarray:
    """Ridge logistic regression by Newton steps over blocks of rows; the last weight is the constant.

    times: how many rows each row of ``x`` stands for; ``y`` is then the number of positive ones among them.
    """
    w = np.zeros(x.shape[1] + 1)
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    times = np.ones(len(x)) if times is None else times
    for _ in range(steps):
        grad, curve = ridge * w, np.diag(ridge)
        for i in range(0, len(x), 2048):
            block = slice(i, i + 2048)
            part = np.column_stack([x[block], np.ones(len(x[block]))]).astype(np.float64)
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            grad += part.T @ (times[block] * p - y[block])
            curve += (part * (times[block] * p * (1 - p))[:, None]).T @ part
        step = np.linalg.solve(curve, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def kinds_of(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Whether each row is a toxic one of each kind: spherical k-means over the features of toxic rows.

    The first centre is the row with the most features, each further one the row least like those before; ties go to
    the first row. Toxic rows without a feature are of the first kind.
    """
    out = np.zeros((len(x), KINDS))
    mine = np.flatnonzero(toxic)
    if len(mine):
        size = np.sqrt(x[mine].sum(axis=1, keepdims=True))
        unit = x[mine] / np.maximum(size, 1)
        centres = unit[[int(np.argmax(size))]]
        while len(centres) < KINDS:
            centres = np.vstack([centres, unit[int(np.argmin((unit @ centres.T).max(axis=1) + 2 * (size[:, 0] == 0)))]])
        for _ in range(20):
            kind = np.argmax(unit @ centres.T, axis=1)
            sums = np.stack([unit[kind == k].sum(axis=0) if (kind == k).any() else centres[k] for k in range(KINDS)])
            centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        out[mine, np.argmax(unit @ centres.T, axis=1)] = 1
    return out


def fit_chain(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS, features: int = FEATURES) -> Chain:
    """Fit the chain on a bounded sample of labelled rows.

    Tasks count, for each word feature, the sample's documents that have it and those of them that
    are toxic; the ``features`` with the highest chi-squared (ties by name) are kept, and for each fold those of the other
    folds. The driver gets the sample's bits for these only, and clusters its toxic rows into kinds. Later models are
    trained with out-of-fold predictions of earlier categories, from models that chose neither weights nor features by
    the fold, so they see the errors they will meet. An id that has several texts counts with one. Without any label nothing is toxic: all probabilities are close to 0.
    """
    sample = hash_sample(one_label(labels, id_col, label_col), "doc_id", fit_rows, 7)
    fold_of = F.pmod(F.xxhash64(F.lit(3), F.col("doc_id").cast("string")), F.lit(FOLDS)).cast("int")
    rows = staged(one_text(keyed_text(docs, id_col, text_col).join(F.broadcast(sample), "doc_id"), "label").withColumn("fold", fold_of), "fit")

    def count_kernel(batches):
        total, toxic = Counter(), Counter()
        for part in text_slices(batches):
            for text, y, fold in zip(texts(part.column("text")), part.column("label").to_pylist(), part.column("fold").to_pylist(), strict=True):
                seen = {(f, fold) for w in words_of(text) for f in word_features(w)}
                total.update(seen)
                if y:
                    toxic.update(seen)
            if len(total) > 500_000:
                yield counted(total, toxic)
                total, toxic = Counter(), Counter()
        yield counted(total, toxic)

    def counted(total: Counter, toxic: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f for f, _ in total], pa.string()), pa.array([k for _, k in total], pa.int32()), pa.array(total.values(), pa.int64()), pa.array([toxic[x] for x in total], pa.int64())], ["feature", "fold", "n", "n_toxic"])

    sizes = {r.fold: (r.n, r.pos) for r in rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("pos")).collect()}
    parts = {k: F.col("fold") != k for k in (-1, *sorted(sizes))}  # -1: all; else all but this fold
    sums = [F.sum(F.when(seen, F.col(c)).otherwise(0)).alias(f"{c}_{k}") for k, seen in parts.items() for c in ("n", "n_toxic")]
    counts = staged(rows.mapInArrow(count_kernel, "feature string, fold int, n long, n_toxic long").groupBy("feature").agg(*sums), "counts")

    def chosen(k: int) -> list[str]:
        n, pos = (sum(x[i] for f, x in sizes.items() if f != k) for i in (0, 1))
        expected = F.col(f"n_{k}") * pos / max(n, 1)
        best = (
            counts.where(F.col(f"n_toxic_{k}") >= 3).withColumn("chi", F.pow(F.col(f"n_toxic_{k}") - expected, 2) / expected / (1 - F.col(f"n_{k}") / (n + 1)))
            .where(F.col(f"n_toxic_{k}") > expected).orderBy(F.desc("chi"), "feature").limit(features).collect()
        )
        return [r.feature for r in sorted(best, key=lambda r: (-r.chi, r.feature))]

    names = {k: chosen(k) for k in parts}
    discard(counts)
    every = {f: i for i, f in enumerate(dict.fromkeys(f for k in parts for f in names[k]))}  # those of all rows come first
    chain = Chain({f: i for i, f in enumerate(names[-1])}, [])

    def bits_kernel(batches):
        mine = Chain(every, [])
        for part in text_slices(batches):
            docs = [words_of(x) for x in texts(part.column("text"))]
            y = np.array(part.column("label").to_pylist(), bool)
            packed = np.packbits(np.column_stack([mine.rows(docs) > 0, y]), axis=1)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.string()), part.column("fold"), pa.array([x.tobytes() for x in packed], pa.binary())], ["doc_id", "fold", "bits"])

    got = rows.mapInArrow(bits_kernel, "doc_id string, fold int, bits binary").orderBy("doc_id", "bits").collect()
    discard(rows)
    width = len(chain.features)
    if not got:
        chain.weights = [np.append(np.zeros(width + k), -30.0) for k in range(len(CATEGORIES))]
        return chain
    bits = np.unpackbits(np.frombuffer(b"".join(r.bits for r in got), np.uint8).reshape(len(got), -1), axis=1)
    x, toxic = bits[:, :width].astype(np.float32), bits[:, len(every)].astype(np.float64)
    marks = np.column_stack([kinds_of(x, toxic), toxic])
    # rows with the same features in one fold are one row that counts as often; most clean texts have none
    alike: dict[tuple[int, bytes], int] = {}
    of = np.array([alike.setdefault((r.fold, row.tobytes()), len(alike)) for r, row in zip(got, np.packbits(bits[:, : len(every)], axis=1), strict=True)])
    first = np.unique(of, return_index=True)[1]
    times = np.bincount(of)
    fold, bits, x = np.array([got[i].fold for i in first]), bits[first], x[first]
    marks = np.column_stack([np.bincount(of, weights=marks[:, k], minlength=len(first)) for k in range(len(CATEGORIES))])
    earlier = np.zeros((len(x), 0), np.float32)
    for k in range(len(CATEGORIES)):
        chain.weights.append(fit_logistic(np.column_stack([x, earlier]), marks[:, k], times))
        held = np.zeros(len(x), np.float32)
        for f in range(FOLDS):
            out = fold == f
            if out.any():
                seen = np.column_stack([bits[:, [every[name] for name in names[f]]].astype(np.float32), earlier])
                held[out] = probability(seen[out], fit_logistic(seen[~out], marks[~out, k], times[~out])) if (~out).any() else marks[:, k].sum() / times.sum()
        earlier = np.column_stack([earlier, held])
    return chain


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD, **fit) -> DataFrame:
    """(doc_id, p_kind_1, p_kind_2, p_toxic, toxic): one row for each row of ``docs``; whole texts.

    Null and empty texts have no word, so they get the models' constants. Repeated rows each give a row; an empty table
    gives an empty table, an empty label table rejects nothing; other columns are not read.
    """
    chain = fit_chain(docs, labels, id_col, text_col, label_col, **fit)
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # at most FEATURES words and as many weights a category
    source = keyed_text(docs, id_col, text_col)
    names = [f"p_{c}" for c in CATEGORIES]

    def kernel(batches):
        mine = Chain(shared.value.features, shared.value.weights)
        for part in text_slices(batches):
            p = mine.predict(mine.rows([words_of(x) for x in texts(part.column("text"))]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(p[:, k].astype(np.float64)) for k in range(len(names)))], ["doc_id", *names])

    return source.mapInArrow(kernel, f"doc_id {id_type(source)}, " + ", ".join(f"{x} double" for x in names)).withColumn("toxic", F.col("p_toxic") >= threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD, **fit) -> DataFrame:
    """The rows of ``docs`` whose own text the chain does not reject, whatever other rows share their id; all columns as they were.

    Nulls, empty tables and repeated rows count as in ``toxicity_scores``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit_chain(docs, labels, id_col, text_col, label_col, **fit))

    def start():
        mine = Chain(shared.value.features, shared.value.weights)
        return lambda part: pa.array(mine.predict(mine.rows([words_of(x) for x in texts(part)]))[:, -1].astype(np.float64))

    return docs.where(text_column(start, "double")(F.col(text_col).cast("string")) < threshold)
