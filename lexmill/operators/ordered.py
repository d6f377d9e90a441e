"""Places and running totals in groups of any length: sorted ranges, a total for each range, offsets added back."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.storage import staged

RANGE, SALT, KEY = "__range", "__salt", "__key"


class Ranges:
    """Rows staged in ranges of (group, order), so that no task holds a group, and each pass sees the same ranges.

    A random number besides parts rows that are equal in group and order. Such rows are interchangeable:
    give an order that tells rows apart where it matters. Nulls in ``group`` are one group. Without
    ``group`` all rows are one group.
    """

    def __init__(self, df: DataFrame, group: list[str], order: list[Column]):
        ranged = df.withColumn(SALT, F.rand(1)).repartitionByRange(*group, *order, SALT).drop(SALT)
        self.columns, self.group, self.order = df.columns, group, order
        self.rows = staged(ranged.withColumn(RANGE, F.spark_partition_id()).withColumn(KEY, F.struct(F.lit(0).alias("all"), *group)), "ranges")

    def running(self, sums: dict[str, str] | None = None, place: str = "place", beside: DataFrame | None = None) -> DataFrame:
        """The rows with their place in their group's order, from 0, and for each of ``sums`` (new name -> column) the total of the rows before.

        The totals of a range are a row for each of its groups; only those of one group meet in a window,
        as many as there are ranges. Null values count as 0. ``beside``: further columns by group, which
        come along with the offsets and so cost no shuffle of the rows.
        """
        sums = sums or {}
        value = {name: F.coalesce(F.col(c), F.lit(0)) for name, c in sums.items()}
        totals = self.rows.groupBy(RANGE, KEY).agg(F.count("*").alias(f"__{place}"), *[F.sum(v).alias(f"__{name}") for name, v in value.items()])
        earlier = Window.partitionBy(KEY).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(RANGE, KEY, *[F.coalesce(F.sum(f"__{name}").over(earlier), F.lit(0)).alias(f"__{name}") for name in (place, *sums)])
        more = []
        if beside is not None:
            more = [c for c in beside.columns if c not in self.group]
            offsets = offsets.join(beside.select(F.struct(F.lit(0).alias("all"), *self.group).alias(KEY), *more), KEY)
        within = Window.partitionBy(RANGE, KEY).orderBy(*self.order)
        before = within.rowsBetween(Window.unboundedPreceding, -1)
        own = {place: F.row_number().over(within) - 1} | {name: F.coalesce(F.sum(v).over(before), F.lit(0)) for name, v in value.items()}
        return self.rows.join(offsets, [RANGE, KEY]).select(*self.columns, *more, *[(F.col(f"__{name}") + x).alias(name) for name, x in own.items()])


def running(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, str] | None = None, place: str = "place") -> DataFrame:
    """``Ranges.running`` of a table in one call."""
    return Ranges(df, group, order).running(sums, place)


class _Stack:
    """Open rows of a document: levels rise from the bottom up."""

    def __init__(self, skip_zero: bool):
        self.skip_zero, self.items = skip_zero, []

    def look(self, level: int | None):
        """(found, id) of the latest row below ``level``."""
        for other, ident in reversed(self.items):
            if other < level or (level == 0 and self.skip_zero):
                return True, ident if other else None
        return False, None

    def push(self, level: int, ident) -> None:
        while self.items and self.items[-1][0] >= level:
            self.items.pop()
        self.items.append((level, ident))


def previous_lower(rows: DataFrame, doc: str, order: str, level: str, ident: str, skip_zero: bool = False, out: str = "parent_id") -> DataFrame:
    """``rows`` with the id of the latest earlier row of the document that has a lesser level, at any depth.

    If that row has level 0, and for rows of level 0, the id is null. With ``skip_zero`` rows of level 0 are passed over
    and get the latest row of any level above 0. Null levels get and give no id.

    A document of any length: each sorted range walks its rows with a stack and leaves open what only earlier ranges can
    answer, by level, and what it leaves on the stack. These few rows, as many as levels and ranges, are walked once more.
    """
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (doc, ident)}

    def walk(batches):
        here, first, stack, open_ = TaskContext.get().partitionId(), True, _Stack(skip_zero), {}
        now, begun = None, False
        for batch in batches:
            docs, levels, ids = (batch.column(c).to_pylist() for c in (doc, level, ident))
            parents, opened = [None] * len(ids), [None] * len(ids)
            for i, (d, own, who) in enumerate(zip(docs, levels, ids, strict=True)):
                if not begun or d != now:
                    first, now, begun, stack = not begun, d, True, _Stack(skip_zero)
                if own is None:
                    continue
                if own or skip_zero:
                    found, parents[i] = stack.look(own)
                    if not found and first:  # only the first document of a range may have begun before it
                        opened[i], open_[own] = own, d
                if own or not skip_zero:
                    stack.push(own, who)
            fixed = [pa.array(x, pa.int32()) for x in ([0] * len(ids), [here] * len(ids), opened)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parents, batch.schema.field(ident).type), *fixed], [*batch.schema.names, out, "__kind", RANGE, "__open"])
        if begun:
            ends = [(1, own, d, None) for own, d in open_.items()] + [(2, own, now, who) for own, who in stack.items]
            table = {c: [None] * len(ends) for c in batch.schema.names} | {doc: [e[2] for e in ends], out: [e[3] for e in ends], "__kind": [e[0] for e in ends], RANGE: [here] * len(ends), "__open": [e[1] for e in ends]}
            types = {f.name: f.type for f in batch.schema} | {out: batch.schema.field(ident).type, "__kind": pa.int32(), RANGE: pa.int32(), "__open": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array(v, types[c]) for c, v in table.items()], list(table))

    ranged = rows.withColumn(level, F.col(level).cast("int")).withColumn(SALT, F.rand(1)).repartitionByRange(doc, order, SALT).drop(SALT).sortWithinPartitions(doc, order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema) + f", `{out}` {kinds[ident]}, __kind int, {RANGE} int, __open int"
    walked = staged(ranged.mapInArrow(walk, schema), "walked")

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        stack, found = _Stack(skip_zero), []
        for r in frame.sort_values([RANGE, "__kind", "__open"], kind="stable").itertuples(index=False):
            if r.kind == 1:
                found.append((r.doc, r.range, r.open, stack.look(r.open)[1]))
            else:
                stack.push(r.open, r.id)
        return pd.DataFrame(found, columns=[doc, RANGE, "__open", "__answer"])

    ends = walked.where("__kind > 0").select(F.col(doc).alias("doc"), F.col(RANGE).alias("range"), F.col("__kind").alias("kind"), F.col("__open").alias("open"), F.col(out).alias("id"))
    again = ends.withColumns({RANGE: F.col("range"), "__kind": F.col("kind"), "__open": F.col("open")})
    answers = again.groupBy("doc").applyInPandas(join, f"`{doc}` {kinds[doc]}, {RANGE} int, __open int, __answer {kinds[ident]}").drop(doc)
    whole = walked.where("__kind = 0")
    closed = whole.where("__open is null").select(*rows.columns, out)
    opened = whole.where("__open is not null").join(answers, [RANGE, "__open"], "left").select(*rows.columns, F.col("__answer").alias(out))
    return closed.unionByName(opened).withColumn(level, F.col(level).cast(rows.schema[level].dataType)).select(*rows.columns, out)
