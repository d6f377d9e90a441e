"""A stored table with unique keys: writes rewrite the buckets that they touch and no others.

Layout below one folder that all executors share: ``data/<name>/bucket=<b>`` holds buckets as one call wrote
them, ``filters/<name>`` what keys they may hold, ``manifests/<name>`` which folder each bucket is in, and the
file ``versions/<number>`` names the manifest. Nothing is changed in place; readers of earlier versions go on,
and of two writers of one version the later is refused.

A row's bucket is a hash of its key. Keys are unique, so buckets are even whatever the keys are; a key that
is written many times in one call is settled before rows are shuffled.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from lexmill.storage import claim, delete, discard, exists, listed, staged

#: Rows of a bucket that a new table is laid out for.
BUCKET_ROWS = 500_000
#: Bits a key in the filter of a bucket; with one hash an absent key is taken for present about one time in so many.
FILTER_BITS = 16
#: Bits of Spark's bitmaps.
BITMAP = 8 * 4096
MANIFEST = "bucket int, folder string, filter string, n long"
BUCKET = "__bucket"


class KeyConflict(ValueError):
    """Rows that would break the key: null, repeated, or there already."""


class WriteConflict(RuntimeError):
    """Another writer made this version first."""


@dataclass
class KeyedTable:
    """The table in ``path`` at one version. Writing calls return the next one.

    Empty tables and empty changes are fine: a change that touches nothing returns the table as it is. Columns may
    have any names but ``__bucket``; null keys, and keys that are repeated where no order tells which row is last, raise KeyConflict.
    """

    spark: SparkSession
    path: str
    version: int
    key: str
    buckets: int
    bits: int
    schema: StructType
    manifest_name: str = ""
    rewritten: list[int] = field(default_factory=list)

    # ---- versions

    @classmethod
    def create(cls, spark: SparkSession, path: str, rows: DataFrame, key: str, buckets: int | None = None) -> KeyedTable:
        """A table of ``rows``; without a number of buckets there is one for each BUCKET_ROWS rows. A folder that holds a table is refused."""
        if exists(spark, f"{path}/versions"):
            raise ValueError(f"there is a table in {path}")
        rows = staged(rows, "keyed-rows")
        n = rows.count()
        buckets = buckets or max(1, -(-n // BUCKET_ROWS))
        bits = max(1, -(-FILTER_BITS * n // (buckets * BITMAP)))  # bitmaps a bucket
        new = cls(spark, path, -1, key, buckets, bits, rows.schema)
        new._check_keys(rows)
        out = new._commit(new._write(rows.withColumn(BUCKET, new._bucket())), None)
        discard(rows)
        return out

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> KeyedTable:
        """The latest version, or an earlier one, whichever session wrote it."""
        there = [int(name) for name, size, _ in listed(spark, f"{path}/versions") if name.isdigit() and size]
        if not there or (version is not None and version not in there):
            raise ValueError(f"there is no such table in {path}")
        version = max(there) if version is None else version
        held = json.loads(spark.read.text(f"{path}/versions/{version}", wholetext=True).first()[0])
        return cls(spark, path, version, held["key"], held["buckets"], held["bits"], StructType.fromJson(held["schema"]), held["manifest"])

    @property
    def manifest(self) -> DataFrame:
        """(bucket, folder, filter, n): a row for each bucket that holds rows."""
        if self.version < 0:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{self.manifest_name}")

    def _commit(self, name: str, touched: list[int] | None) -> KeyedTable:
        """Version of what ``name`` holds and of the untouched buckets of this one."""
        written = self.spark.read.schema(f"{BUCKET} int").parquet(f"{self.path}/data/{name}")
        fresh = written.groupBy(F.col(BUCKET).alias("bucket")).agg(F.count("*").alias("n")).select("bucket", F.lit(name).alias("folder"), F.lit(name).alias("filter"), "n")
        kept = self.manifest if not touched else self.manifest.where(~F.col("bucket").isin(touched))
        kept.unionByName(fresh).coalesce(1).write.parquet(f"{self.path}/manifests/{name}")
        held = {"key": self.key, "buckets": self.buckets, "bits": self.bits, "schema": json.loads(self.schema.json()), "manifest": name}
        if not claim(self.spark, f"{self.path}/versions/{self.version + 1}", json.dumps(held)):
            raise WriteConflict(f"version {self.version + 1} of {self.path} is there already: open it and write again")
        return KeyedTable(self.spark, self.path, self.version + 1, self.key, self.buckets, self.bits, self.schema, name, touched or [])

    def vacuum(self) -> None:
        """Delete what only earlier versions read."""
        live = {x for row in self.manifest.select("folder", "filter").distinct().collect() for x in row}
        for kind, keep in (("data", live), ("filters", live), ("manifests", {self.manifest_name}), ("versions", {str(self.version)})):
            for name, _, _ in listed(self.spark, f"{self.path}/{kind}"):
                if name not in keep:
                    delete(self.spark, f"{self.path}/{kind}/{name}")

    def drop(self) -> None:
        delete(self.spark, self.path)

    # ---- rows

    def _hash(self) -> Column:
        return F.xxhash64(F.col(self.key))

    def _bucket(self) -> Column:
        return F.pmod(self._hash(), F.lit(self.buckets)).cast("int")

    def _place(self) -> Column:
        """Bit of a key in the filter of its bucket: another hash than the bucket's."""
        return F.pmod(F.xxhash64(F.lit(1), F.col(self.key)), F.lit(self.bits * BITMAP))

    def _write(self, rows: DataFrame) -> str:
        """Write rows that have a bucket, and the filters of their buckets."""
        name = uuid.uuid4().hex
        spread = rows.repartition(BUCKET).select(*[F.col(f"`{c}`") for c in self.schema.names], BUCKET)
        # The column of the bucket is in the files too: partition values have no part in reading rows back.
        spread.withColumn("__folder", F.col(BUCKET)).write.partitionBy("__folder").parquet(f"{self.path}/data/{name}")
        place = self.spark.read.schema(self._stored).parquet(f"{self.path}/data/{name}").select(F.col(BUCKET).alias("bucket"), self._place().alias("place"))
        bits = place.groupBy("bucket", (F.col("place") / BITMAP).cast("int").alias("part")).agg(F.bitmap_construct_agg(F.col("place") % BITMAP).alias("bits"))
        bits.write.parquet(f"{self.path}/filters/{name}")
        return name

    @property
    def _stored(self) -> StructType:
        return StructType([*self.schema.fields]).add(BUCKET, IntegerType())

    def _read(self, buckets: list[int] | None = None) -> DataFrame:
        rows = self.manifest if buckets is None else self.manifest.where(F.col("bucket").isin(buckets))
        paths = [f"{self.path}/data/{r.folder}/__folder={r.bucket}" for r in rows.collect()]  # a row a bucket
        if not paths:
            return self.spark.createDataFrame([], self._stored)
        return self.spark.read.schema(self._stored).parquet(*paths)

    @property
    def rows(self) -> DataFrame:
        return self._read().drop(BUCKET)

    def _maybe(self, keys: DataFrame) -> DataFrame:
        """(key, bucket) of those distinct keys that the filters do not rule out. Only filters are read."""
        asked = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        asked = asked.select(self.key, self._bucket().alias("bucket"), self._place().alias("place")).withColumn("part", (F.col("place") / BITMAP).cast("int"))
        names = [r[0] for r in self.manifest.select("filter").distinct().collect()]
        if not names:
            return asked.select(self.key, "bucket").limit(0)
        held = self.spark.read.schema("bucket int, part int, bits binary").parquet(*[f"{self.path}/filters/{n}" for n in names]).withColumn("filter", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
        live = held.join(self.manifest.select("bucket", "filter"), ["bucket", "filter"], "left_semi").drop("filter")
        byte = F.conv(F.hex(F.expr(f"substring(bits, cast((place % {BITMAP}) div 8 as int) + 1, 1)")), 16, 10).cast("int")
        return asked.join(live, ["bucket", "part"]).where(byte.bitwiseAND(F.expr("shiftleft(1, cast(place % 8 as int))")) != 0).select(self.key, "bucket")

    def _touched(self, keys: DataFrame) -> list[int]:
        return sorted(r[0] for r in keys.select("bucket").distinct().collect())

    def get(self, keys: DataFrame) -> DataFrame:
        """Rows of the keys in the key column of ``keys``; reads the buckets that may hold one."""
        maybe = staged(self._maybe(keys), "keyed-asked")
        return self._read(self._touched(maybe)).join(maybe.select(self.key), self.key, "left_semi").drop(BUCKET)

    def _check_keys(self, rows: DataFrame) -> None:
        bad = rows.groupBy(self.key).agg(F.count("*").alias("n")).where(F.col(self.key).isNull() | (F.col("n") > 1)).limit(3).collect()
        if bad:
            raise KeyConflict(f"null or repeated keys, such as {[r[0] for r in bad]}")

    # ---- writes

    def upsert(self, changes: DataFrame, seq: str | None = None) -> KeyedTable:
        """Put rows in the place of those with the same keys and add the others.

        With ``seq``, a column of the table, the row with the greatest one stays, stored rows included; of equal ones a
        change wins, and among changes the greatest row. Without it every change wins.
        """
        names = [F.col(f"`{c}`") for c in self.schema.names]
        changes = changes.select(*names)
        if seq:
            row = F.struct(F.col(f"`{seq}`").alias("__seq"), F.struct(*names).alias("row"))
            changes = changes.groupBy(self.key).agg(F.max(row).alias("__m")).select("__m.row.*")
        changes = staged(changes.withColumn(BUCKET, self._bucket()), "keyed-changes")
        self._check_keys(changes)
        touched = sorted(r[0] for r in changes.select(BUCKET).distinct().collect())
        if not touched:
            return self
        old = self._read(touched)
        if seq:
            new = changes.select(F.col(self.key), F.col(f"`{seq}`").alias("__new"))
            late = old.join(new, self.key).where(F.col(f"`{seq}`") > F.col("__new")).select(self.key)  # stored rows that stay
            changes = changes.join(late, self.key, "left_anti")
        rows = old.join(changes.select(self.key), self.key, "left_anti").unionByName(changes)
        return self._commit(self._write(rows), touched)

    def insert(self, rows: DataFrame, keep_first: bool = False) -> KeyedTable:
        """Add rows. A key that is there, or comes twice, is refused; with ``keep_first`` the stored row stays, and of new ones the least row."""
        names = [F.col(f"`{c}`") for c in self.schema.names]
        rows = rows.select(*names)
        if keep_first:
            rows = rows.groupBy(self.key).agg(F.min(F.struct(*names)).alias("__m")).select("__m.*")
        rows = staged(rows.withColumn(BUCKET, self._bucket()), "keyed-changes")
        self._check_keys(rows)
        maybe = staged(self._maybe(rows), "keyed-asked")
        there = self._read(self._touched(maybe)).join(maybe.select(self.key), self.key, "left_semi").select(self.key)
        if keep_first:
            rows = rows.join(there, self.key, "left_anti")
        elif found := there.limit(3).collect():
            raise KeyConflict(f"keys that are there already, such as {[r[0] for r in found]}")
        touched = sorted(r[0] for r in rows.select(BUCKET).distinct().collect())
        return self._commit(self._write(self._read(touched).unionByName(rows)), touched) if touched else self

    def delete(self, keys: DataFrame) -> KeyedTable:
        """Take away the rows of these keys; buckets that hold none of them are not rewritten, those that the filters rule out not read."""
        maybe = staged(self._maybe(keys), "keyed-asked")
        gone = staged(self._read(self._touched(maybe)).join(maybe.select(self.key), self.key, "left_semi").select(self.key, F.col(BUCKET).alias("bucket")), "keyed-gone")
        touched = self._touched(gone)
        if not touched:
            return self
        return self._commit(self._write(self._read(touched).join(gone.select(self.key), self.key, "left_anti")), touched)
