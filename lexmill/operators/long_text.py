"""Chunks of very long documents: lines in ranges over many tasks, what crosses a range's border carried over, texts joined last."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import lines
from lexmill.storage import discard, staged

from .chunking import _HEADER, CHUNK, Chunk, chunk_markdown, estimate, has_body, kind_of, merge_small, split_large
from .ordered import RANGE, running

#: Characters from which ``chunk_documents`` takes the way by ranges.
LONG_FROM = 4 << 20
#: Characters that a range of lines holds anyway: a text below is not worth being cut, as its lines would lie in one range.
RANGE_FROM = 64 << 10
FENCES = ("", "```", "~~~")
_LINE = f"row long, doc string, at long, raw string, line string, level int, name string, mask int, kind int, {RANGE} int"
_LEVELS = range(1, 7)


def _after(fence: str, line: str) -> str:
    """The open fence behind a line."""
    if fence:
        return "" if line.startswith(fence) else fence
    return line[:3] if line.startswith(FENCES[1:]) and line.count(line[:3]) == 1 else ""


def _classify(batches):
    """_LINE of each line: bit i of mask says whether it is inside a fence if fence i was open where the range begins; kind 1: where that leaves each i."""
    here, now, first, ends = TaskContext.get().partitionId(), None, True, {}
    for batch in batches:
        rows, raws = batch.column("row").to_pylist(), batch.column("raw").to_pylist()
        out = {k: [] for k in ("raw", "line", "level", "name", "mask")}
        for row, raw in zip(rows, raws, strict=True):
            if row != now:
                if now is not None and first:
                    ends[now], first = states, False
                now, states = row, FENCES if now is None else ("",) * 3
            line = raw.strip()
            mask = sum(1 << i for i, f in enumerate(states) if f)
            if mask or line[:3] in FENCES[1:]:
                states = tuple(_after(f, line) for f in states)
            m = _HEADER.fullmatch(line)
            for name, value in (("raw", raw if mask else None), ("line", line), ("level", len(m[1]) if m else 0), ("name", m[2].strip() if m else None), ("mask", mask)):
                out[name].append(value)
        n = len(rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc"), batch.column("at"), pa.array(out["raw"], pa.string()), pa.array(out["line"], pa.string()), pa.array(out["level"], pa.int32()), pa.array(out["name"], pa.string()), pa.array(out["mask"], pa.int32()), pa.array([0] * n, pa.int32()), pa.array([here] * n, pa.int32())],
            ["row", "doc", "at", "raw", "line", "level", "name", "mask", "kind", RANGE],
        )
    if now is not None:
        ends[now] = states
        codes = [sum(FENCES.index(f) * 3**i for i, f in enumerate(s)) for s in ends.values()]
        nulls = [None] * len(ends)
        yield pa.RecordBatch.from_pydict({"row": list(ends), "doc": nulls, "at": nulls, "raw": nulls, "line": nulls, "level": nulls, "name": nulls, "mask": codes, "kind": [1] * len(ends), RANGE: [here] * len(ends)}, schema=pa.schema(
            [("row", pa.int64()), ("doc", pa.string()), ("at", pa.int64()), ("raw", pa.string()), ("line", pa.string()), ("level", pa.int32()), ("name", pa.string()), ("mask", pa.int32()), ("kind", pa.int32()), (RANGE, pa.int32())]))


def _open_fences(frame: pd.DataFrame) -> pd.DataFrame:
    """The fence open at the start of each range of a document, from what each range makes of each fence."""
    frame, state, out = frame.sort_values(RANGE), 0, []
    for code in frame["mask"]:
        out.append(state)
        state = int(code) // 3**state % 3
    return frame.assign(state=out)[["row", RANGE, "state"]]


def blocks_by_range(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc, block, path, text): the header blocks of every text as ``chunking.header_blocks`` makes them, stored. path: names by level 1 to 6.

    Lines go to ranges of (row, line), so a text's lines are worked on by many tasks. Ranges hand on three things, a row a range and
    text: which fence is open, the level of the last line kept, and the latest header of each level. row numbers the rows of ``docs``.
    """
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("string").alias("doc"), F.col(text_col).cast("string").alias("text"))
    listed = texts.select("row", "doc", F.posexplode(lines(F.col("text"))).alias("at", "raw")).withColumn("at", F.col("at").cast("long"))
    ranged = listed.repartitionByRange("row", "at").sortWithinPartitions("row", "at")
    walked = staged(ranged.mapInArrow(_classify, _LINE), "walked")
    state = walked.where("kind = 1").select("row", RANGE, "mask").groupBy("row").applyInPandas(_open_fences, f"row long, {RANGE} int, state int")
    each = walked.where("kind = 0").join(state, ["row", RANGE], "left").withColumn("inside", F.expr("shiftright(mask, coalesce(state, 0)) & 1") == 1)
    within = Window.partitionBy(RANGE, "row").orderBy("at")
    kept = each.where("inside or line <> ''").select("row", "doc", RANGE, "at", F.when(F.col("inside"), F.col("raw")).otherwise(F.col("line")).alias("text"), F.when(F.col("inside"), 0).otherwise(F.col("level")).alias("level"), "name")
    begins = lambda level, before: ((level > 0) & ~((before > 0) & (level > before))).cast("long")
    lag = F.lag("level").over(within)
    kept = staged(kept.withColumn("begin", F.when(lag.isNotNull(), begins(F.col("level"), lag))), "kept")
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    header = {k: F.max(F.when(F.col("level").between(1, k), F.struct("at", F.when(F.col("level") == k, F.col("name")).alias("name")))) for k in _LEVELS}
    totals = kept.groupBy(RANGE, "row").agg(F.min_by("level", "at").alias("first"), F.max_by("level", "at").alias("last"), F.sum("begin").alias("n"), *[h.alias(f"h{k}") for k, h in header.items()])
    ranges = Window.partitionBy("row").orderBy(RANGE)
    earlier = ranges.rowsBetween(Window.unboundedPreceding, -1)
    before = F.lag("last").over(ranges)
    totals = totals.withColumn("starts", F.when(before.isNull(), F.lit(1).cast("long")).otherwise(begins(F.col("first"), before)))
    totals = totals.withColumn("n", F.col("starts") + F.coalesce("n", F.lit(0)))
    carried = totals.select(RANGE, "row", "starts", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"), *[F.max(f"h{k}").over(earlier).alias(f"h{k}") for k in _LEVELS])
    numbered = kept.join(carried, [RANGE, "row"])
    numbered = numbered.withColumn("block", F.col("offset") + F.sum(F.coalesce("begin", "starts")).over(upto))
    path = F.array(*[F.greatest(F.col(f"h{k}"), h.over(upto))["name"] for k, h in header.items()])
    numbered = numbered.withColumn("path", path)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "  \n")
    blocks = staged(numbered.groupBy("row", "doc", "block").agg(F.max_by("path", "at").alias("path"), joined.alias("text")), "blocks")
    discard(walked, kept)
    return blocks


def _merges(most: int, least: int):
    """Which blocks of a document form a chunk, decided on sizes and paths alone."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        chunks = [Chunk(str(b), {k: v for k, v in zip(_LEVELS, p, strict=True) if v is not None}, kind, size) for b, p, size, kind in zip(frame["block"], frame["path"], frame["size"], frame["chunk_type"], strict=True)]
        found = [(frame["row"].iloc[0], i, turn, int(b), [c.path.get(k) for k in _LEVELS], c.size, c.kind) for i, c in enumerate(merge_small(chunks, most, least)) for turn, b in enumerate(c.text.split("\n\n"))]
        return pd.DataFrame(found, columns=["row", "chunk", "turn", "block", "path", "size", "chunk_type"])

    return run


def chunk_long(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 180, least: int = 12, stage: str = "split") -> DataFrame:
    """The rows of ``chunking.chunk_markdown``, made over ranges of lines.

    Only sizes and paths of a document's blocks meet in one task, where merges are decided; texts are joined and split chunk by chunk. A block
    without headers inside is one text, as long as it may be. Null and empty texts have no chunks; repeated rows have theirs each; other
    columns are ignored.
    """
    blocks = blocks_by_range(docs, id_col, text_col)
    columns = "row long, doc string, chunk long, i long, text string, token_count long, chunk_type string, path array<string>, part string"

    def measure(frames):
        for f in frames:
            yield f[["row", "block", "path"]].assign(size=[estimate(t) for t in f["text"]], chunk_type=[kind_of(t) for t in f["text"]])

    sized = blocks.mapInPandas(measure, "row long, block long, path array<string>, size long, chunk_type string")
    if stage == "blocks":
        rows = blocks.drop("path").join(sized, ["row", "block"]).select("row", "doc", F.col("block").alias("chunk"), F.lit(0).alias("i"), "text", F.col("size").alias("token_count"), "chunk_type", "path", F.lit(None).cast("string").alias("part"))
    else:
        plan = sized.groupBy("row").applyInPandas(_merges(most, least), "row long, chunk long, turn long, block long, path array<string>, size long, chunk_type string")
        parts = plan.join(blocks.select("row", "doc", "block", "text"), ["row", "block"])
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n")
        whole = parts.groupBy("row", "doc", "chunk").agg(text.alias("text"), F.first("path").alias("path"), F.first("size").alias("size"), F.first("chunk_type").alias("chunk_type"))

        def split(frames):
            for f in frames:
                made = []
                for r in f.itertuples(index=False):
                    if has_body(r.text):
                        c = Chunk(r.text, {}, r.chunk_type, r.size)
                        made += [(r.row, r.doc, r.chunk, i, x.text, x.size, x.kind, r.path, x.part) for i, x in enumerate(split_large(c, most) if stage == "split" else [c])]
                yield pd.DataFrame(made, columns=["row", "doc", "chunk", "i", "text", "token_count", "chunk_type", "path", "part"])

        rows = whole.mapInPandas(split, columns)
    placed = running(rows, ["row"], [F.col("chunk"), F.col("i")], place="place")
    path = F.filter("path", lambda x: x.isNotNull())
    return placed.select("doc", F.col("place").cast("long").alias("chunk_index"), "text", "token_count", "chunk_type", path.alias("section_path"), F.size(path).alias("level"), "part").to(_schema(docs))


def _schema(docs: DataFrame):
    return docs.sparkSession.createDataFrame([], CHUNK).schema


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 180, least: int = 12, stage: str = "split", long_from: int = LONG_FROM) -> DataFrame:
    """``chunk_markdown`` of texts below ``long_from`` characters, ``chunk_long`` of the others: the same rows either way."""
    length = F.coalesce(F.length(F.col(text_col).cast("string")), F.lit(0))
    return chunk_markdown(docs.where(length < long_from), id_col, text_col, most, least, stage).unionByName(chunk_long(docs.where(length >= long_from), id_col, text_col, most, least, stage))
