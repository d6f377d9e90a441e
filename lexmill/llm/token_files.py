"""Token-id files: one concatenated id array a shard, document boundaries in Elias-Fano code.

Layout, little-endian: the 8 bytes of MAGIC; ids of ``width`` bytes each; the Elias-Fano code of the
documents' end offsets; that of the document ids (less the least one); a footer of FOOTER's fields;
MAGIC again. A code of n rising values has low bits of ``low`` bits each, packed; high bits in unary
(one bit set per value); and the places of every SAMPLE-th set bit for select, in 4 or 8 bytes.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegralType

from .common import keyed_text, shared_dir, text_slices
from .word_cache import PieceTable, byte_list, load_tokenizer, piece_table, space_pieces

MAGIC = b"LEXTOKEF"
FOOTER = struct.Struct("<QQQQqQQ")  # ids, documents, documents with null id, id width, least id, sizes of both codes
HEAD = struct.Struct("<QQQQQ")  # values, low bits each, bytes of low, high and samples
SAMPLE = 128
#: Documents whose bounds a reader takes at a time, and ids of one read; a longer document is one read.
READ_DOCS, READ_IDS = 2048, 4 << 20


def _pack(values: np.ndarray, width: int) -> bytes:
    if not width or not len(values):
        return b""
    bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def _unpack(data: np.ndarray, width: int, first: int, count: int) -> np.ndarray:
    if not width or not count:
        return np.zeros(count, np.uint64)
    lo = first * width
    bits = np.unpackbits(data[lo // 8 : (lo + count * width + 7) // 8], bitorder="little")[lo % 8 :][: count * width]
    return bits.reshape(count, width).astype(np.uint64) @ (np.uint64(1) << np.arange(width, dtype=np.uint64))


def ef_encode(values: np.ndarray) -> bytes:
    """Elias-Fano code of a non-falling array of unsigned integers."""
    values = values.astype(np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    packed = b"".join(_pack(values[i : i + 65536] & np.uint64((1 << low) - 1), low) for i in range(0, n, 65536))  # 65536 * low bits end on a byte
    places = (values >> np.uint64(low)) + np.arange(n, dtype=np.uint64)
    high = np.zeros((int(places[-1]) // 8 + 1) if n else 0, np.uint8)
    np.bitwise_or.at(high, (places >> np.uint64(3)).astype(np.int64), np.uint8(1) << (places & np.uint64(7)).astype(np.uint8))
    samples = places[::SAMPLE].astype("<u4" if n == 0 or int(places[-1]) < 1 << 32 else "<u8").tobytes()
    return HEAD.pack(n, low, len(packed), len(high), len(samples)) + packed + high.tobytes() + samples


@dataclass
class EliasFano:
    """Random access to the values of a code."""

    n: int
    low: int
    lows: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @classmethod
    def of(cls, data: bytes) -> EliasFano:
        n, low, a, b, c = HEAD.unpack_from(data)
        raw = np.frombuffer(data, np.uint8, offset=HEAD.size)
        wide = "<u4" if n and c // ((n + SAMPLE - 1) // SAMPLE) == 4 or not n else "<u8"
        return cls(n, low, raw[:a], raw[a : a + b], np.frombuffer(raw[a + b : a + b + c].tobytes(), wide))

    def slice(self, first: int, count: int) -> np.ndarray:
        """Values first ... first+count-1: select finds the first set bit from the nearest sample."""
        count = max(0, min(count, self.n - first))
        if not count:
            return np.zeros(0, np.int64)
        block = first // SAMPLE
        start = int(self.samples[block]) // 8
        after = (first + count - 1) // SAMPLE + 1
        stop = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[start:stop], bitorder="little")) + start * 8
        ones = ones[np.searchsorted(ones, int(self.samples[block])) :]  # the sampled bit leads
        places = ones[first - block * SAMPLE :][:count]
        high = (places - np.arange(first, first + count)).astype(np.uint64)
        return ((high << np.uint64(self.low)) | _unpack(self.lows, self.low, first, count)).astype(np.int64)

    def select(self, i: int) -> int:
        return int(self.slice(i, 1)[0])


class ShardWriter:
    """Writes one shard as documents come, in rising id order, nulls first; memory holds lengths only."""

    def __init__(self, uri: str, width: int):
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(f"{self.path}.part")
        self.out.write(MAGIC)
        self.width, self.lengths, self.ids, self.nulls = width, [], [], 0

    def add(self, doc_ids: list[int | None], packed: list[bytes]) -> None:
        self.out.write(b"".join(packed))
        self.lengths.append(np.fromiter(map(len, packed), np.int64, len(packed)) // self.width)
        self.nulls += doc_ids.count(None)
        self.ids.append(np.array([x for x in doc_ids if x is not None], np.int64))

    def close(self) -> tuple[int, int]:
        ends = np.cumsum(np.concatenate([np.zeros(0, np.int64), *self.lengths]))
        ids = np.concatenate([np.zeros(0, np.int64), *self.ids])
        least = int(ids[0]) if len(ids) else 0
        a, b = ef_encode(ends), ef_encode((ids - least).astype(np.uint64))
        total = int(ends[-1]) if len(ends) else 0
        self.out.write(a + b + FOOTER.pack(total, len(ends), self.nulls, self.width, least, len(a), len(b)) + MAGIC)
        self.out.close()
        self.fs.move(f"{self.path}.part", self.path)
        return len(ends), total


class ShardReader:
    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        tail = FOOTER.size + len(MAGIC)
        end = self.file.size()
        foot = self.file.read_at(tail, end - tail) if end >= tail else b""
        if foot[-len(MAGIC) :] != MAGIC or self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{uri} is not a whole token file")
        self.n_ids, self.n_docs, self.nulls, self.width, self.least, a, b = FOOTER.unpack_from(foot)
        codes = self.file.read_at(a + b, end - tail - a - b)
        self.ends, self.doc_ids = EliasFano.of(codes[:a]), EliasFano.of(codes[a:])

    def bounds(self, first: int, count: int) -> np.ndarray:
        """Start of document ``first`` and the ends of it and those after."""
        return np.concatenate([[self.ends.select(first - 1) if first else 0], self.ends.slice(first, count)])

    def read(self, start: int, stop: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((stop - start) * self.width, len(MAGIC) + start * self.width), f"<u{self.width}")

    def ids_of(self, first: int, count: int) -> list[int | None]:
        nulls = max(0, min(self.nulls - first, count))
        return [None] * nulls + (self.doc_ids.slice(max(0, first - self.nulls), count - nulls) + self.least).tolist()


def encode_texts(texts: pa.Array, lead: PieceTable, rest: PieceTable) -> list[bytes]:
    """Packed ids of each text: of its first piece from ``lead``, of the pieces behind a space from ``rest``."""
    lists = space_pieces(texts)
    n = pc.list_value_length(lists).to_numpy().astype(np.int64)
    first, flat = np.cumsum(n) - n, lists.flatten()
    spaced = np.ones(len(flat), bool)
    spaced[first] = False
    heads, tails = lead.encode(flat.take(pa.array(first))), rest.encode(flat.filter(pa.array(spaced)))
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(tails).to_numpy())])[np.concatenate([[0], np.cumsum(n - 1)])].tolist()
    data = memoryview(tails.buffers()[2] or b"")
    return [x + data[s:e] for x, s, e in zip(byte_list(heads), ends, ends[1:], strict=False)]


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, int, int]]:
    """Encode every whole text, write the shards, and return (uri, documents, ids, ids before it) of each.

    Rows are dealt by ranges of the integer id and a hash of the text, and sorted inside each shard, so
    shards in order hold the documents in ascending order, null ids first and dealt over several shards if
    they are many; rows of one id lie in the order of that hash. Each shard is written
    under a name of its task attempt and renamed when whole; the list, a row a shard, is all that
    reaches the driver. Null and empty texts hold the end id alone. ``folder`` has to be shared.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens-{spark.sparkContext.applicationId}-{np.random.default_rng().integers(1 << 62):x}"
    source = keyed_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = source.repartitionByRange(shards, *order).sortWithinPartitions(*order, "text")

    def kernel(batches):
        task = TaskContext.get()
        width = 2 if load_tokenizer(tokenizer_path).get_vocab_size() <= 1 << 16 else 4
        lead, rest = piece_table(tokenizer_path, f"<u{width}"), piece_table(tokenizer_path, f"<u{width}", True)
        end = b"" if end_id is None else int(end_id).to_bytes(width, "little")
        out = None
        for part in text_slices(batches):
            out = out or ShardWriter(f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.ids", width)
            out.add(part.column("doc_id").to_pylist(), [x + end for x in encode_texts(part.column("text"), lead, rest)])
        if out:
            n_docs, n_ids = out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int64()), "uri": [f"{folder}/{out.path.rpartition('/')[2]}"], "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    rows = sorted(tuple(r) for r in dealt.mapInArrow(kernel, "part long, uri string, n_docs long, n_ids long").collect())
    before = np.concatenate([[0], np.cumsum([r[3] for r in rows], dtype=np.int64)]).tolist()
    return [(uri, n_docs, n_ids, start) for (_, uri, n_docs, n_ids), start in zip(rows, before, strict=False)]


def read_token_files(spark, shards: list[tuple[str, int, int, int]], id_kind: str = "long") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

    start counts the ids of all documents before it, over all shards; ids_crc32 is the unsigned crc32
    of the document's ids as unsigned 32-bit integers. A task reads blocks of documents at the
    offsets that select gives.
    """
    schema = f"doc_id {id_kind}, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame(shards, "uri string, n_docs long, n_ids long, before long").repartition(len(shards))
    id_type = to_arrow_type(spark.createDataFrame([], schema).schema["doc_id"].dataType)

    def kernel(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = ShardReader(row["uri"])
                for first in range(0, shard.n_docs, READ_DOCS):
                    edges = shard.bounds(first, READ_DOCS)
                    crc, at = [], 0
                    while at < len(edges) - 1:
                        stop = max(at + 1, int(np.searchsorted(edges, edges[at] + READ_IDS, side="right")) - 1)
                        ids = shard.read(int(edges[at]), int(edges[stop])).astype("<u4")
                        inside = (edges[at : stop + 1] - edges[at]).tolist()
                        crc += [zlib.crc32(ids[s:e]) for s, e in zip(inside, inside[1:], strict=False)]
                        at = stop
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(shard.ids_of(first, len(edges) - 1), pa.int64()).cast(id_type),
                        "start": pa.array(edges[:-1] + row["before"]), "n_tokens": pa.array(np.diff(edges)), "ids_crc32": pa.array(crc, pa.int64()),
                    })

    return listed.mapInArrow(kernel, schema)


def token_file_index(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` as token files and describe every document as the files hold it. An empty table gives no file and no row.

    Ids are integers of any width. Repeated rows are documents of their own; other columns are not read.
    """
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"token files keep integer ids, not {kind.simpleString()}")
    return read_token_files(docs.sparkSession, write_token_files(docs, tokenizer_path, folder, end_id, id_col, text_col), kind.simpleString())
