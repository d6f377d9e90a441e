"""The best of many queries among many rows, from bounded matrices of scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Scores (queries times rows) that a task holds at a time.
CELLS = 1 << 21
#: Rows of a matrix that tell how high a query's results reach before anything is known.
SEED = 256


def steps(queries: int, rows: int) -> Iterator[slice]:
    """The queries in runs whose scores of so many rows are at most CELLS."""
    step = max(1, CELLS // max(1, rows))
    return (slice(at, min(at + step, queries)) for at in range(0, queries, step))


def seeded(scores: np.ndarray, least: np.ndarray, k: int, near: np.ndarray | float = 0.0) -> np.ndarray:
    """``least``, or where nothing is known yet the k-th score of the leading columns less ``near``; no more than that of all either way."""
    if scores.shape[1] < k or not np.isneginf(least).any():
        return least
    head = scores[:, : max(k, SEED)]
    return np.maximum(least, np.partition(np.where(np.isnan(head), -np.inf, head), head.shape[1] - k, axis=1)[:, head.shape[1] - k] - near)


def cut(row: np.ndarray, value: np.ndarray, col: np.ndarray, k: int, each: bool = False) -> np.ndarray:
    """Places of the k highest values of each row in order, equal ones by column; with ``each`` all values, but k places of equal ones at most."""
    order = np.lexsort((col, -value, row))
    row, value = row[order], value[order]
    new = np.append(True, np.diff(row) != 0)[: len(row)]
    if each:
        new |= np.append(True, np.diff(value) != 0)[: len(row)]
    first = np.maximum.accumulate(np.where(new, np.arange(len(row)), 0)) if len(row) else row
    return order[np.arange(len(row)) - first < k]


class Best:
    """The k best (score, key, more) of each query so far, the lesser key first among equal scores; ``least`` is what a new one has to reach.

    With ``near`` (a width a query) also all that is less than so much below the k-th, though k of equal scores at most.
    """

    def __init__(self, queries: int, k: int, near: np.ndarray | None = None):
        self.k, self.near = k, near
        self.held: dict[int, list[tuple]] = {}
        self.least = np.full(queries, -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, key: list, *more: np.ndarray) -> None:
        """Rows in order of the query."""
        bounds = [0, *(np.flatnonzero(np.diff(query)) + 1).tolist(), len(query)]
        rows = list(zip((-score).tolist(), key, *(m.tolist() for m in more), strict=True))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if a == b:
                continue
            q = int(query[a])
            mine = sorted(self.held.get(q, []) + rows[a:b])
            if len(mine) >= self.k:
                self.least[q] = -mine[self.k - 1][0] - (0 if self.near is None else self.near[q])
            if self.near is None:
                mine = mine[: self.k]
            else:
                kept, same, last = [], 0, None
                for x in mine:
                    same = same + 1 if x[0] == last else 1
                    last = x[0]
                    if same <= self.k and -x[0] >= self.least[q]:
                        kept.append(x)
                mine = kept
            self.held[q] = mine

    def rows(self) -> Iterator[tuple]:
        """(query, score, key, more) of all."""
        for q, mine in self.held.items():
            for score, *rest in mine:
                yield q, -score, *rest
