"""A cache over a stream of reads and writes: entries age from their last write, the one that was used longest ago goes at capacity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TTL_SECONDS = 3600
CAPACITY = 10_000
SHARDS = 64
#: State stores that keep state by key on disk; the session's default does not take state of this kind.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "key string, at timestamp, seq long, event string, value string"


class _Shard(StatefulProcessor):
    """Entries of one shard: key -> (value, time written, time used, number of the use), times in microseconds."""

    def __init__(self, capacity: int, ttl: int):
        self.capacity, self.ttl = capacity, ttl * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "key string", "value string, written long, used long, turn long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["micros", "seq"], kind="stable")
        # At most ``capacity`` entries, in the order of their use.
        held = {k[0]: tuple(v) for k, v in sorted(self.entries.iterator(), key=lambda e: (e[1][2], e[1][3], e[0][0]))}
        before, out = dict(held), []
        for name, value, micros, seq in frame[["key", "value", "micros", "seq"]].itertuples(index=False):
            entry = held.get(name)
            if entry and micros - entry[1] > self.ttl:
                del held[name]
                entry = None
            if value is None or value != value:  # a read
                if entry:
                    held[name] = (entry[0], entry[1], micros, seq)
                    held[name] = held.pop(name)  # used last
                out.append((name, micros, seq, "hit" if entry else "miss", entry[0] if entry else None))
                continue
            held.pop(name, None)
            while len(held) >= self.capacity:
                oldest = next(iter(held))
                out.append((oldest, micros, seq, "evicted", held.pop(oldest)[0]))
            held[name] = (value, micros, micros, seq)
        for name in before.keys() - held.keys():
            self.entries.removeKey((name,))
        for name, entry in held.items():
            if before.get(name) != entry:
                self.entries.updateValue((name,), entry)
        frame = pd.DataFrame(out, columns=["key", "at", "seq", "event", "value"])
        frame["at"] = pd.to_datetime(frame["at"], unit="us", utc=True)
        yield frame

    def close(self) -> None:
        pass


def cached(requests: DataFrame, capacity: int = CAPACITY, ttl: int = TTL_SECONDS, shards: int = SHARDS) -> DataFrame:
    """(key, at, seq, event, value): what a cache answers to requests of a stream or a table.

    requests: key, at, seq, value; a null value is a read, any other a write; seq orders requests of one time.
    A read is a hit, with the value, or a miss; a write gives a row for each entry that it drives out. Reads make an
    entry recent but not younger: it is gone once its last write is over ``ttl`` seconds old. Writing a key anew
    drives nothing out. Keys are dealt to ``shards`` by hash, each with its part of the capacity, so that the cache
    works in parallel and a hot key fills no more than its place; with one shard the order of use is that of the whole.
    Requests are taken in order of time within a micro-batch; null keys or times are left out.
    """
    if capacity % shards:
        raise ValueError("the capacity has to be a multiple of the shards")
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    requests.sparkSession.streams.active  # noqa: B018 - starts the coordinator of state stores, which tables need too
    rows = requests.where("key is not null and at is not null").select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "key", F.unix_micros(F.col("at").cast("timestamp")).alias("micros"), F.col("seq").cast("long").alias("seq"), "value")
    return rows.groupBy("shard").transformWithStateInPandas(_Shard(capacity // shards, ttl), OUTPUT, "Append", "None")
