"""Running totals, parents and paths over ranges, against plain walks."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lexmill.operators.graph import tree_paths, with_parents
from lexmill.operators.ordered import Ranges, previous_lower, running

SECTIONS = "document_id string, id string, title string, ord long, level long"


def test_running_spreads_a_hot_group(spark):
    r = random.Random(1)
    rows = [("hot", i, r.randint(0, 9)) for i in range(2000)] + [(None, i, None) for i in range(5)] + [(f"d{i % 40}", i, 3) for i in range(400)] + [("same", 1, 1)] * 500
    frame = spark.createDataFrame(rows, "g string, o long, v int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = Ranges(frame, ["g"], [F.col("o")])
        largest = max(x["count"] for x in spread.rows.groupBy("__range").count().collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert largest < 1500  # of 2,905 rows in four tasks, two thirds of them in one group
    want, place, total = [], defaultdict(int), defaultdict(int)
    for g, o, v in sorted(rows, key=lambda x: (x[0] or "", x[1])):
        want.append((g, o, v, place[g], total[g]))
        place[g] += 1
        total[g] += v or 0
    got = [tuple(x) for x in spread.running({"before": "v"}).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sorted(x.place for x in running(frame, [], [F.col("g"), F.col("o")]).collect()) == list(range(len(rows)))
    assert running(frame.limit(0), ["g"], [F.col("o")]).collect() == []


def plain_parents(rows, skip_zero):
    by, out = defaultdict(list), {}
    for d, i, _, o, level in sorted(rows, key=lambda x: (str(x[0]), x[3])):
        seen = by[d]
        out[i] = None
        if level is not None and (level or skip_zero):
            near = next(((lv, k) for lv, k in reversed(seen) if (lv > 0 if level == 0 else lv < level) and (lv > 0 or not skip_zero)), None)
            out[i] = near[1] if near and near[0] else None
        if level is not None:
            seen.append((level, i))
    return out


@pytest.mark.parametrize("skip_zero", [False, True])
def test_previous_lower_at_any_depth_over_many_ranges(spark, skip_zero):
    r = random.Random(2)
    rows = [("hot", f"h{i}", "t", i, r.choice([0, 1, 2, 3, 7, 12, 30, None])) for i in range(900)] + [(f"d{i % 30}", f"s{i}", "t", i, r.randint(0, 9)) for i in range(300)]
    rows += [("flat", f"f{i}", "t", i, 2) for i in range(300)] + [("deep", f"e{i}", "t", i, i + 1) for i in range(200)]
    out = previous_lower(spark.createDataFrame(rows, SECTIONS).repartition(7), "document_id", "ord", "level", "id", skip_zero)
    assert {x.id: x.parent_id for x in out.collect()} == plain_parents(rows, skip_zero)
    assert out.schema["level"].dataType.simpleString() == "bigint"
    assert previous_lower(spark.createDataFrame([], SECTIONS), "document_id", "ord", "level", "id").collect() == []


def test_long_chain_deep_levels_and_circles(spark):
    rows = [("d", f"t{i}", f"n{i}", i, i + 1) for i in range(1000)] + [("e", f"u{i}", f"m{i}", i, (i % 14) + 1) for i in range(28)]
    whole = with_parents(spark.createDataFrame(rows, SECTIONS))
    paths = {x.id: x.tree_path for x in tree_paths(whole).collect()}
    assert paths["t999"] == "/".join(f"n{i}" for i in range(1000)) and paths["t0"] == "n0"
    assert paths["u13"] == "/".join(f"m{i}" for i in range(14)) and paths["u14"] == "m14"
    circle = spark.createDataFrame([("d", "a", "A", "b"), ("d", "b", "B", "a"), ("d", "c", "C", "b"), ("d", "r", "R", None), ("d", "x", "X", "r"), ("d", "y", "Y", "lost"), ("d", "z", "Z", "z")], "document_id string, id string, title string, parent_id string")
    assert {x.id: x.tree_path for x in tree_paths(circle).collect()} == {"a": None, "b": None, "c": None, "z": None, "r": "R", "x": "R/X", "y": "Y"}
    assert tree_paths(circle.limit(0)).collect() == []
