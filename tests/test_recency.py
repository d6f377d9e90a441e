"""The cache over streams against a plain model."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lexmill.plans import assessment
from lexmill.streaming.recency import cached

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
SCHEMA = "key string, at timestamp, seq long, value string"


def requests(n, keys=12, seed=5):
    r = random.Random(seed)
    return [(f"k{int(keys * r.random() ** 2)}", START + datetime.timedelta(seconds=20 * (i // 2)), i, f"v{i}" if r.random() < 0.4 else None) for i in range(n)]


def plain(rows, capacity, ttl):
    """(key, seq, event, value) of a cache in one process: a list in order of use."""
    order, values, out = [], {}, []
    for key, at, seq, value in sorted(rows, key=lambda r: (r[1], r[2])):
        if key in values and (at - values[key][1]).total_seconds() > ttl:
            order.remove(key)
            del values[key]
        if value is None:
            if key in values:
                order.remove(key)
                order.append(key)
            out.append((key, seq, "hit" if key in values else "miss", values[key][0] if key in values else None))
            continue
        if key in values:
            order.remove(key)
        elif len(order) == capacity:
            gone = order.pop(0)
            out.append((gone, seq, "evicted", values.pop(gone)[0]))
        order.append(key)
        values[key] = (value, at)
    return out


def answers(frame):
    return sorted((r.key, r.seq, r.event, r.value or "") for r in frame.collect())


def sorted_plain(*args):
    return sorted((k, s, e, v or "") for k, s, e, v in plain(*args))


def test_table_equals_the_model(spark):
    rows = requests(400)
    want = sorted_plain(rows, 5, 600)
    assert {e for _, _, e, _ in want} == {"hit", "miss", "evicted"}
    assert answers(cached(spark.createDataFrame(rows, SCHEMA).repartition(3), 5, 600, shards=1)) == want


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    rows = requests(300, seed=8)
    for i, part in enumerate((rows[:120], rows[120:200], rows[200:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        run = cached(stream, 5, 600, shards=1).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        run.awaitTermination()
        done = (120, 200, 300)[i]
        assert answers(spark.read.parquet(str(tmp_path / "out"))) == sorted_plain(rows[:done], 5, 600)


def test_shards_nulls_and_empty_tables(spark):
    rows = requests(200, keys=40)
    frame = spark.createDataFrame([*rows, (None, START, 1, "x"), ("k1", None, 2, "x")], SCHEMA)
    shard = {r.key: r.s for r in frame.select("key", F.pmod(F.xxhash64("key"), F.lit(4)).alias("s")).distinct().collect()}
    want = sorted(x for s in range(4) for x in sorted_plain([r for r in rows if shard[r[0]] == s], 3, 600))
    assert answers(cached(frame, 12, 600, shards=4)) == want
    assert cached(frame.limit(0), 12, 600, shards=4).count() == 0
    with pytest.raises(ValueError, match="multiple"):
        cached(frame, 10, 600, shards=4)


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.key, r.at, r.seq, r.value) for r in assessment.cache_requests(spark, sf).collect()]
    assert answers(assessment.cache_recency(spark, sf)) == sorted_plain(rows, assessment.CACHE_ROOM, assessment.CACHE_TTL)
