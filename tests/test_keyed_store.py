"""The stored table with unique keys against a dictionary."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from lexmill.operators.keyed_store import KeyConflict, KeyedTable, WriteConflict
from lexmill.storage import listed, shared_dir

SCHEMA = "id string, `a b` string, seq long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def held(table):
    return {r[0]: tuple(r) for r in table.rows.collect()}


def made(spark, n=200, buckets=8):
    rows = [(f"k{i}", f"v{i}", 0) for i in range(n)]
    return KeyedTable.create(spark, f"{shared_dir(spark)}/keyed-{uuid.uuid4().hex}", frame(spark, rows), "id", buckets), {r[0]: r for r in rows}


def test_writes_equal_a_dictionary(spark):
    table, want = made(spark)
    r = random.Random(3)
    for step in range(1, 4):
        changes = [(f"k{r.randrange(260)}", f"s{step}.{i}", r.randrange(5)) for i in range(30)]
        table = table.upsert(frame(spark, changes), seq="seq")
        best = {}
        for row in changes:
            best[row[0]] = max(best.get(row[0], row), row, key=lambda x: (x[2], x))
        for key, row in best.items():
            if key not in want or row[2] >= want[key][2]:
                want[key] = row
        gone = [f"k{r.randrange(300)}" for _ in range(10)]
        table = table.delete(spark.createDataFrame([(k,) for k in gone], "id string"))
        for key in gone:
            want.pop(key, None)
        assert held(table) == want
    assert held(KeyedTable.open(spark, table.path)) == want
    assert len(held(KeyedTable.open(spark, table.path, 0))) == 200
    table.vacuum()
    assert held(KeyedTable.open(spark, table.path)) == want
    assert [name for name, _, _ in listed(spark, f"{table.path}/versions")] == [str(table.version)]


def test_only_touched_buckets_are_rewritten(spark):
    table, _ = made(spark)
    before = {r.bucket: r.folder for r in table.manifest.collect()}
    after = table.upsert(frame(spark, [("k7", "new", 1)]))
    now = {r.bucket: r.folder for r in after.manifest.collect()}
    assert len(after.rewritten) == 1 and [b for b in before if before[b] != now[b]] == after.rewritten
    assert after.manifest.agg(F.sum("n")).first()[0] == 200
    assert after.delete(spark.createDataFrame([("nowhere",), (None,)], "id string")) is after
    assert after.upsert(frame(spark, [])) is after


def test_filters_rule_out_absent_keys(spark):
    table, want = made(spark, 400, 4)
    absent = spark.range(1000).select(F.concat(F.lit("x"), "id").alias("id"))
    assert table._maybe(absent).count() < 100  # 400 keys in 4 filters of 32,768 bits
    present = spark.createDataFrame([(k,) for k in want], "id string")
    assert table._maybe(present).count() == 400
    assert {r[0] for r in table.get(present.limit(50)).collect()} <= set(want) and table.get(present.limit(50)).count() == 50


def test_conflicts(spark):
    table, want = made(spark)
    with pytest.raises(KeyConflict):
        table.insert(frame(spark, [("k3", "again", 1)]))
    with pytest.raises(KeyConflict):
        table.upsert(frame(spark, [("z", "one", 1), ("z", "two", 1)]))
    with pytest.raises(KeyConflict):
        table.upsert(frame(spark, [(None, "none", 1)]))
    with pytest.raises(KeyConflict):
        KeyedTable.create(spark, f"{table.path}-x", frame(spark, [("a", "b", 0)] * 2), "id")
    with pytest.raises(ValueError, match="there is a table"):
        KeyedTable.create(spark, table.path, frame(spark, []), "id")
    kept = table.insert(frame(spark, [("k3", "again", 1), ("z", "two", 2), ("z", "one", 2)]), keep_first=True)
    assert held(kept) == want | {"z": ("z", "one", 2)}
    with pytest.raises(WriteConflict):
        table.upsert(frame(spark, [("k1", "late", 9)]))
    assert held(KeyedTable.open(spark, table.path)) == held(kept)


def test_empty(spark):
    table, _ = made(spark, 0, 2)
    assert held(table) == {} and table.get(spark.createDataFrame([("a",)], "id string")).count() == 0
    full = table.insert(frame(spark, [("a", "b", 0)]))
    assert held(full) == {"a": ("a", "b", 0)}
    assert held(full.delete(full.rows.select("id"))) == {}
