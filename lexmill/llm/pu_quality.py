"""Quality classifier by positive-unlabelled learning: a linear model of the non-negative unbiased risk."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, keyed_text, text_slices, utf8
from .sampling import hash_sample, one_label, one_text

#: Rows from which the model is fitted, at most (about): trusted positives, and as many unlabelled texts.
FIT_ROWS = 20_000
THRESHOLD = 0.3
BINS = 12
NAMES = ["log_words", "word_length", "longest_word", "upper", "digit", "symbol", "exclamation", "pipe", "other_punctuation", "outside_ascii", "distinct_words", "top_word", "echo", "repeated_lines", "line_length", "short_words", "symbol_words", "shouted_words"]

_CLASS = np.zeros(256, np.int64)  # 1 upper, 2 lower or outside ASCII, 3 digit, 4 symbol, 5 exclamation, 6 pipe, 7 other, 0 white space
_CLASS[33:127] = 7
_CLASS[48:58] = 3
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[128:] = 2
_CLASS[list(b"#*$%&<>@^~=_\\")] = 4
_CLASS[ord("!")] = 5
_CLASS[ord("|")] = 6


def text_features(data: bytes) -> list[float]:
    """NAMES of a UTF-8 text; all zero without words."""
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    raw = np.frombuffer(data, np.uint8)
    count = np.bincount(_CLASS[raw], minlength=8)
    chars = max(1, int(count[1:].sum()))
    letters = max(1, int(count[1] + count[2]))
    length = np.fromiter(map(len, words), np.int64, n)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    letters_only = b"".join(words).translate(None, b"#*$%&<>@^~=_\\|")
    return [
        np.log1p(n), length.mean(), np.log1p(length.max()), count[1] / letters, count[3] / chars, count[4] / chars, count[5] / chars, count[6] / chars, count[7] / chars,
        np.count_nonzero(raw >= 128) / chars, len(seen) / n**0.9, max(seen.values()) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, 1 - len(set(lines)) / len(lines), np.log1p(len(data) / len(lines)),
        np.count_nonzero(length <= 3) / n, 1 - len(letters_only) / int(length.sum()), sum(w.isupper() for w in words) / n,
    ]


@dataclass
class QualityModel:
    """A weight for each bin of each feature; bins by the sample's quantiles."""

    edges: list[np.ndarray]
    weights: np.ndarray

    def design(self, x: np.ndarray) -> np.ndarray:
        parts = [np.eye(len(e) + 1, dtype=np.float32)[np.searchsorted(e, x[:, i], side="right")] for i, e in enumerate(self.edges)]
        return np.column_stack([*parts, np.ones((len(x), 1), np.float32)])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(x) @ self.weights, -30, 30)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class _Adam:
    """Steps over the whole sample, so the result does not depend on an order of rows."""

    def __init__(self, size: int, rate: float):
        self.w, self.m, self.v = (np.zeros(size, np.float32) for _ in range(3))
        self.rate, self.t = rate, 0

    def step(self, grad: np.ndarray) -> None:
        self.t += 1
        self.m, self.v = 0.9 * self.m + 0.1 * grad, 0.999 * self.v + 0.001 * grad**2
        self.w = (self.w - self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)).astype(np.float32)


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 800, rate: float = 0.1, penalty: float = 5e-5) -> np.ndarray:
    """Weights that minimise prior*R_p(+) + max(0, R_u(-) - prior*R_p(-)) with the logistic loss.

    Where the second part is below zero the model fits single unlabelled rows; the step then goes up
    that part alone, as the non-negative estimator does.
    """
    adam, prior = _Adam(positive.shape[1], rate), np.float32(prior)
    loss = lambda s: -np.log(np.maximum(1 - s, 1e-12)).mean()
    for _ in range(steps):
        p, u = _sigmoid(positive @ adam.w), _sigmoid(unlabelled @ adam.w)
        as_negative = unlabelled.T @ (u / len(u)) - prior * (positive.T @ (p / len(p)))
        grad = -as_negative if loss(u) - prior * loss(p) < 0 else prior * (positive.T @ ((p - 1) / len(p))) + as_negative
        adam.step(grad + penalty * adam.w)
    return adam.w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 300) -> float:
    """Share of positives among unlabelled rows, from those two samples alone.

    On one half, a linear model tells positives from unlabelled rows. On the other half, the share of unlabelled over
    that of positive scores above a cut cannot be below the prior; the cut is taken where the share plus its
    sampling error is least (best-bin estimation). The lesser of both halves' values is returned.
    """
    out = []
    for k in (0, 1):
        a, b = positive[k::2], unlabelled[k::2]
        held_a, held_b = positive[1 - k :: 2], unlabelled[1 - k :: 2]
        if not (len(a) and len(b) and len(held_a) and len(held_b)):
            continue
        adam = _Adam(positive.shape[1], 0.05)
        for _ in range(steps):
            p, u = _sigmoid(a @ adam.w), _sigmoid(b @ adam.w)
            adam.step((a.T @ ((p - 1) / len(p)) + b.T @ (u / len(u))) / 2 + 2e-4 * adam.w)
        sp, su = np.sort(held_a @ adam.w), np.sort(held_b @ adam.w)
        cuts = np.quantile(sp, np.linspace(0, 0.95, 96))
        above_p, above_u = (1 - np.searchsorted(x, cuts) / len(x) for x in (sp, su))
        share = above_u / above_p
        error = (np.sqrt(np.log(40) / 2 / len(su)) + share * np.sqrt(np.log(40) / 2 / len(sp))) / above_p
        out.append(float(share[np.argmin(share + error)]))
    return min(max(min(out, default=0.5), 0.01), 0.99)


def _feature_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, trusted, free, x) of the rows of a small table doc_id, text, trusted, free."""

    def kernel(batches):
        for part in text_slices(batches):
            x = [np.array(text_features(d), "<f8").tobytes() for d in utf8(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.string()), part.column("trusted"), part.column("free"), pa.array(x, pa.binary())], ["doc_id", "trusted", "free", "x"])

    return docs.mapInArrow(kernel, "doc_id string, trusted boolean, free boolean, x binary")


def in_training(id_col: str = "doc_id"):
    """Whether labels of a row may be learnt: crc32 of its id as text, modulo 5, is not 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 != 0


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> QualityModel | None:
    """Fit on trusted positives (label 1) and unlabelled texts of the training folds, each a bounded sample.

    Rows labelled 0 are not used, nor for the class prior (``estimate_prior``). The texts of both samples, about
    2 * ``fit_rows`` rows at most, are read in one scan; an id that has several texts counts with one. Without positives there is no model.
    """
    source = keyed_text(docs, id_col, text_col)
    trusted = hash_sample(one_label(labels, id_col, label_col).where(in_training() & (F.col("label") == 1)), "doc_id", fit_rows, 11)
    free = hash_sample(source.select("doc_id").where(in_training()), "doc_id", fit_rows, 12)
    chosen = trusted.select("doc_id", F.lit(True).alias("trusted"), F.lit(False).alias("free")).unionByName(free.select("doc_id", F.lit(False).alias("trusted"), F.lit(True).alias("free")))
    chosen = chosen.groupBy("doc_id").agg(F.max("trusted").alias("trusted"), F.max("free").alias("free"))
    rows = _feature_rows(one_text(source.join(F.broadcast(chosen), "doc_id"), "trusted", "free")).orderBy("doc_id", "x").collect()
    x = np.frombuffer(b"".join(r.x for r in rows), "<f8").reshape(-1, len(NAMES))
    is_trusted, is_free = (np.array([r[k] for r in rows], bool) for k in (1, 2))
    if not is_trusted.any() or not is_free.any():
        return None
    both = np.concatenate([x[is_trusted], x[is_free]])
    edges = [np.unique(np.quantile(both[:, i], np.concatenate([np.linspace(0, 1, BINS + 1)[1:-1], [0.01, 0.03, 0.97, 0.99]]))) for i in range(x.shape[1])]
    model = QualityModel(edges, np.zeros(0))
    positive, unlabelled = model.design(x[is_trusted]), model.design(x[is_free])
    model.weights = fit_nnpu(positive, unlabelled, estimate_prior(positive, unlabelled))
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row for each row of ``docs``, whole texts.

    The score is the estimated probability of label 1; it depends on the text alone. A null or empty text has the
    features of a text without words. Without trusted positives every score is 1/2. Repeated rows each
    give a row; a null id counts as the empty text for its fold; an empty table gives an empty table; other columns are not read.
    """
    model = fit_quality(docs, labels, id_col, text_col, label_col, fit_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = keyed_text(docs, id_col, text_col)

    def kernel(batches):
        model = shared.value
        for part in text_slices(batches):
            x = np.array([text_features(d) for d in utf8(part.column("text"))])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(x).astype(np.float64) if model else np.full(len(x), 0.5))], ["doc_id", "score"])

    scored = source.mapInArrow(kernel, f"doc_id {id_type(source)}, score double")
    return scored.select("doc_id", (~in_training()).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def crc_fold(doc_id: object) -> int:
    """The fold of an id, as plain Python sees it."""
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5
