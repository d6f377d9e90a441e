"""A stored vector index in cells, with exact answers: a bound from each cell's centre and radius tells which cells a query can leave out.

Layout below one folder: ``rows/cell=<n>`` holds the vectors of a cell, ``cells/<number>`` the centres with the
radius and size of each cell after so many additions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.storage import exists, listed, staged

from .vectors import _in_blocks, _matrix

#: Rows from which centres are fitted, at most, by a hash of key and vector; every row is indexed.
SAMPLE = 20_000
#: Cells at most; otherwise the square root of the number of rows. Centres are broadcast: MAX_CELLS vectors.
MAX_CELLS = 1024
#: Cells that every query reads first, to learn how high its results reach.
FIRST_CELLS = 2
#: Scores are rounded to six places before they are ordered.
NEAR = 2e-6


@dataclass
class VectorIndex:
    """The index in ``path`` as of ``number`` additions."""

    spark: SparkSession
    path: str
    number: int

    @classmethod
    def create(cls, vectors: DataFrame, path: str, key: str = "chunk_id", cells: int | None = None) -> VectorIndex:
        """Fit centres on a bounded sample and index all ``vectors``: key, embedding and whatever other columns searches may filter by.

        Rows without key or vector are left out. All vectors have one dimension. An empty table gives an index
        with one cell around zero vectors' place, which takes no rows.
        """
        spark = vectors.sparkSession
        if exists(spark, f"{path}/cells"):
            raise ValueError(f"there is an index in {path}")
        rows = _usable(vectors, key)
        n = rows.count()
        share = F.pmod(F.xxhash64(key, "embedding"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30))
        sample = rows.where(share).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")).limit(2 * SAMPLE)
        wanted = cells or max(1, min(MAX_CELLS, int(n**0.5)))
        centres = [c.tolist() for c in KMeans(k=wanted, seed=1, maxIter=5, initSteps=1).fit(sample).clusterCenters()] if n > 1 and wanted > 1 else [list(map(float, r.embedding)) for r in rows.limit(1).collect()]
        return cls(spark, path, -1)._add(rows, key, centres)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        whole = [int(name) for name, _, _ in listed(spark, f"{path}/cells") if name.isdigit() and exists(spark, f"{path}/cells/{name}/_SUCCESS")]
        if not whole:
            raise ValueError(f"there is no index in {path}")
        return cls(spark, path, max(whole))

    def cells(self) -> DataFrame:
        """(cell, centre, radius, n): a bounded number of rows."""
        return self.spark.read.schema("cell int, centre array<double>, radius double, n long").parquet(f"{self.path}/cells/{self.number}")

    def rows(self) -> DataFrame:
        """All indexed rows as of this number of additions."""
        if not exists(self.spark, f"{self.path}/rows"):
            return self.spark.createDataFrame([], "key string, embedding array<double>, away double, added int, cell int")
        return self.spark.read.parquet(f"{self.path}/rows").where(F.col("added") <= self.number)

    def add(self, vectors: DataFrame, key: str = "chunk_id") -> VectorIndex:
        """Put further vectors into the cells of their nearest centres; files are only added, and radii grow."""
        return self._add(_usable(vectors, key), key, [r.centre for r in self.cells().orderBy("cell").collect()])

    def _add(self, rows: DataFrame, key: str, centres: list[list[float]]) -> VectorIndex:
        at, number = np.array(centres, np.float64), self.number + 1
        if not len(at):
            self.spark.createDataFrame([], "cell int, centre array<double>, radius double, n long").write.parquet(f"{self.path}/cells/{number}")
            return VectorIndex(self.spark, self.path, number)
        shared = self.spark.sparkContext.broadcast(at)
        others = [c for c in rows.columns if c not in (key, "embedding")]
        flat = rows.select(F.col(key).alias("key"), F.col("embedding").cast("array<double>"), *others)

        def kernel(batches):
            for batch in batches:
                if batch.num_rows:
                    x, c = _matrix(batch.column("embedding"), batch.num_rows), shared.value
                    cell = np.argmin((c**2).sum(1) - 2 * x @ c.T, axis=1)
                    away = np.linalg.norm(x - c[cell], axis=1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(away), pa.array(np.full(len(cell), number), pa.int32()), pa.array(cell, pa.int32())], [*batch.schema.names, "away", "added", "cell"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema) + ", away double, added int, cell int"
        flat.mapInArrow(kernel, schema).hint("rebalance", "cell").write.mode("append").partitionBy("cell").option("compression", "zstd").parquet(f"{self.path}/rows")  # large cells are split
        found = self.spark.read.parquet(f"{self.path}/rows").where(F.col("added") <= number).groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("n"))
        listed_ = self.spark.createDataFrame(list(enumerate(centres)), "cell int, centre array<double>")
        listed_.join(found, "cell", "left").select("cell", "centre", F.coalesce("radius", F.lit(0.0)).alias("radius"), F.coalesce("n", F.lit(0)).cast("long").alias("n")).coalesce(1).write.parquet(f"{self.path}/cells/{number}")
        return VectorIndex(self.spark, self.path, number)

    def _best(self, asked: dict[int, list[int]], ids: np.ndarray, matrix: np.ndarray, k: int, where: Column | None) -> DataFrame:
        """(qid, key, score): the k best of each batch for the queries that ask its rows' cells; only these cells' folders are read."""
        rows = self.rows().where(F.col("cell").isin(sorted(asked)))
        rows = (rows if where is None else rows.where(where)).select("key", "embedding", "cell")
        shared = self.spark.sparkContext.broadcast(({c: np.array(q) for c, q in asked.items()}, ids, matrix))

        def kernel(batches):
            asked, ids, matrix = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, cell, keys = _matrix(batch.column("embedding"), batch.num_rows), batch.column("cell").to_numpy(), batch.column("key")
                for c in np.unique(cell):
                    mine, q = np.flatnonzero(cell == c), asked[int(c)]
                    scores = np.round(x[mine] @ matrix[q].T, 6)
                    least = np.partition(scores, max(0, len(mine) - k), axis=0)[max(0, len(mine) - k)]
                    row, of = np.nonzero(scores >= least)  # ties at the end stay; the merge decides them
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q[of]], pa.int64()), keys.take(pa.array(mine[row])), pa.array(scores[row, of])], ["qid", "key", "score"])

        return rows.mapInArrow(kernel, f"qid long, key {self.rows().schema['key'].dataType.simpleString()}, score double")

    def search(self, queries: DataFrame, k: int = 5, where: Column | None = None, qid: str = "qid", report: dict | None = None) -> DataFrame:
        """(qid, key, score, rank): the exact k best keys by inner product, best score of each key, ties by key.

        With c, r the centre and radius of a cell, no row of it scores above q·c + |q| r. A query first reads
        the FIRST_CELLS cells of the highest bounds that hold rows, then those whose bound reaches the k-th
        score found so far. ``where`` filters rows before the search, by any indexed column. Queries meet the
        index in blocks. report gets the numbers of (query, cell) pairs, those scored, and cells read.
        """
        table = self.cells().where("n > 0").orderBy("cell").collect()
        cell = np.array([r.cell for r in table])
        out = None
        for ids, matrix in _in_blocks(queries, qid) if len(table) else ():
            bound = matrix @ np.array([r.centre for r in table]).T + np.linalg.norm(matrix, axis=1)[:, None] * np.array([r.radius for r in table])
            order = np.argsort(-bound, axis=1, kind="stable")
            first = np.zeros(bound.shape, bool)
            np.put_along_axis(first, order[:, :FIRST_CELLS], True, axis=1)
            pairs = lambda mask: {int(cell[j]): np.flatnonzero(mask[:, j]).tolist() for j in np.flatnonzero(mask.any(axis=0))}  # noqa: B023, E731
            found = staged(_top(self._best(pairs(first), ids, matrix, k, where), k), "cells")
            reach = {r.qid: r.score for r in found.where(F.col("rank") == k).select("qid", "score").collect()}  # a row a query of the block
            least = np.array([reach.get(i, -np.inf) for i in ids.tolist()]) - NEAR
            rest = ~first & (bound >= least[:, None])
            if rest.any():
                found = staged(_top(found.select("qid", "key", "score").unionByName(self._best(pairs(rest), ids, matrix, k, where)), k), "cells")
            if report is not None:
                for name, value in (("pairs", bound.size), ("scored", int((first | rest).sum())), ("cells_read", int((first | rest).any(axis=0).sum()))):
                    report[name] = report.get(name, 0) + value
            out = found if out is None else out.unionByName(found)
        kind = self.rows().schema["key"].dataType.simpleString()
        return self.spark.createDataFrame([], f"qid long, key {kind}, score double, rank int") if out is None else out


def _usable(vectors: DataFrame, key: str) -> DataFrame:
    return vectors.where(F.col(key).isNotNull() & F.col("embedding").isNotNull())


def _top(scored: DataFrame, k: int) -> DataFrame:
    best = scored.groupBy("qid", "key").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "key"))).where(F.col("rank") <= k)
