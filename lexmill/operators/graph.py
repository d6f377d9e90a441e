"""The document graph as tables: documents, sections, chunks, questions, concepts, and what joins them.

sections: id, document_id, title, level, ord, path; chunks: chunk_id, document_id, section_id,
chunk_index, token_count, text; questions: question_id, chunk_id, created_at, ...; mentions:
chunk_id, concept_id; related: concept_id, related_id. Foreign keys stand for edges.
"""

from __future__ import annotations

import uuid

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.storage import staged

from .ordered import previous_lower


def sections_of(chunks: DataFrame) -> DataFrame:
    """One row for each section in order of first appearance in its document; header is the path's last part."""
    first = chunks.groupBy("document_id", "section_id").agg(F.min_by("section_path", "chunk_index").alias("path"), F.min("chunk_index").alias("first_index"))
    order = F.row_number().over(Window.partitionBy("document_id").orderBy("first_index")) - 1
    header = F.coalesce(F.element_at(F.when(F.size("path") > 0, F.col("path")), -1), F.lit("Untitled Section"))
    return first.select("document_id", "section_id", order.cast("long").alias("ord"), header.alias("header"), F.size("path").cast("long").alias("level"), F.concat_ws(" > ", "path").alias("path_string"))


def section_number(header):
    """Leading digits and dots of a header; null without."""
    return F.nullif(F.regexp_extract(header, r"^([\d.]+)", 1), F.lit(""))


def chunk_nodes(chunks: DataFrame) -> DataFrame:
    features = F.to_json(F.struct(F.col("chunk_index").alias("position"), "token_count", "lang"))
    return chunks.select(F.concat_ws("_chunk_", "document_id", F.col("chunk_index").cast("string")).alias("id"), "document_id", "section_id", F.col("chunk_index").alias("ord"), F.col("token_count").alias("token_length"), features.alias("features"))


def with_parents(sections: DataFrame) -> DataFrame:
    """parent_id: the most recent earlier section of a lesser level, at any depth; none if that one has level 0."""
    return previous_lower(sections, "document_id", "ord", "level", "id")


def tree_paths(sections: DataFrame) -> DataFrame:
    """(document_id, id, tree_path): titles from the root down, of trees of any depth.

    Each round doubles how far a row has looked up, so a tree of depth d takes log2(d) joins on the id. Rows whose
    parents run in a circle are found by ids alone, before any path is put together, and have a null path, as has
    what hangs on them. A parent that is not there is like none.
    """
    rows = staged(sections.select("document_id", "id", "title", "parent_id"), "sections")
    link = rows.select("id", F.col("parent_id").alias("next"))
    link = staged(link.join(rows.select(F.col("id").alias("next")), "next", "left_semi").select("id", "next"), "links")  # rows without a parent are at their root
    n, first, seen = rows.count(), link, 1
    while seen < n and not link.isEmpty():
        link = staged(link.join(link.select(F.col("id").alias("next"), F.col("next").alias("then")), "next").select("id", F.col("then").alias("next")), "links")
        seen *= 2
    endless = link.select("id")  # looked up as many steps as there are rows, and still not at a root
    out = staged(rows.join(first, "id", "left").join(endless, "id", "left_anti").select("document_id", "id", F.col("title").alias("tree_path"), "next"), "paths")
    while not out.where("next is not null").isEmpty():
        up = out.select(F.col("id").alias("next"), F.col("tree_path").alias("above"), F.col("next").alias("then"))
        out = staged(out.join(up, "next", "left").select("document_id", "id", F.concat(F.when(F.col("above").isNotNull(), F.concat("above", F.lit("/"))).otherwise(""), "tree_path").alias("tree_path"), F.col("then").alias("next")), "paths")
    none = rows.join(endless, "id", "left_semi").select("document_id", "id", F.lit(None).cast("string").alias("tree_path"))
    return out.drop("next").unionByName(none)


def nearest_sections(chunks: DataFrame, sections: DataFrame, default: str = "default") -> DataFrame:
    """As-of join: of each chunk the last section of its document whose order is below the chunk's; one sort, no range join."""
    points = sections.select("document_id", F.col("ord").alias("t"), F.lit(1).alias("kind"), F.col("id").alias("sid"), F.lit(None).cast("string").alias("chunk_id"))
    probes = chunks.select("document_id", F.col("chunk_index").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("sid"), "chunk_id")
    last = F.last("sid", ignorenulls=True).over(Window.partitionBy("document_id").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, -1))
    return points.unionByName(probes).withColumn("near", last).where("kind = 0").select("chunk_id", F.coalesce("near", F.lit(default)).alias("nearest_section"))


def next_chain(chunks: DataFrame) -> DataFrame:
    after = F.lead("chunk_id").over(Window.partitionBy("document_id").orderBy("chunk_index"))
    return chunks.select(F.col("chunk_id").alias("src"), after.alias("dst")).where("dst is not null")


def section_statistics(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every section, with 0 where it has no chunk, and chunks' section ids that have no section row."""
    counts = chunks.groupBy(F.col("section_id").alias("id")).agg(F.count("*").alias("n"), F.sum("token_count").alias("t"))
    return sections.join(counts, "id", "full").select("id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce(F.col("level").cast("long"), F.lit(0)).alias("level"), F.coalesce("n", F.lit(0)).alias("chunk_count"), F.coalesce("t", F.lit(0)).alias("total_tokens"))


def upsert(table: DataFrame, changes: DataFrame, key: str, seq: str) -> DataFrame:
    """Last write of each key wins; ``seq`` orders writes, and the table's rows have it too."""
    both = table.unionByName(changes)
    return both.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))).where("__rn = 1").drop("__rn")


def merge_first(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """First write of each key wins."""
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(seq))).where("__rn = 1").drop("__rn")


def edges(left: DataFrame, pairs: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct (src, dst) pairs whose ends both exist; left and right have a column id."""
    return pairs.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(right.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()


def repeated_keys(table: DataFrame, key: str) -> DataFrame:
    """Keys that break uniqueness, with their number of rows."""
    return table.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def without_document(document_id: str, documents: DataFrame, sections: DataFrame, chunks: DataFrame, questions: DataFrame) -> tuple[DataFrame, ...]:
    """The tables without a document and all that hangs on it, nested sections too."""
    gone = chunks.where(F.col("document_id") == document_id).select("chunk_id")
    return documents.where(F.col("id") != document_id), sections.where(F.col("document_id") != document_id), chunks.where(F.col("document_id") != document_id), questions.join(gone, "chunk_id", "left_anti")


def orphans(concepts: DataFrame, mentions: DataFrame) -> DataFrame:
    return concepts.join(mentions.select("concept_id").distinct(), "concept_id", "left_anti")


def document_counts(documents: DataFrame, sections: DataFrame, chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """Documents with their numbers of sections, chunks and questions: each child is counted before it is joined."""
    s = sections.groupBy("document_id").agg(F.count("*").alias("s"))
    c = chunks.groupBy("document_id").agg(F.count("*").alias("c"))
    q = questions.join(chunks.select("chunk_id", "document_id"), "chunk_id").groupBy("document_id").agg(F.count("*").alias("q"))
    out = documents.withColumnRenamed("id", "document_id")
    for t in (s, c, q):
        out = out.join(t, "document_id", "left")
    return out.select("document_id", "language", "created_at", *[F.coalesce(x, F.lit(0)).alias(name) for x, name in (("s", "sections"), ("c", "chunks"), ("q", "questions"))])


def page(rows: DataFrame, order: list, skip: int = 0, limit: int = 20) -> DataFrame:
    return rows.orderBy(*order).offset(skip).limit(limit)


def neighbours(chunks: DataFrame, of: DataFrame, same_section: bool = True, limit: int = 5) -> DataFrame:
    """(of, chunk_id): up to ``limit`` other chunks of each wanted chunk's section, or of its document's other sections.

    Ranked before the join, so a wanted chunk meets at most ``limit`` + 1 rows of its section, or twice ``limit`` of
    its document: with ``limit`` a section, its own section cannot hold more than half of those.
    """
    group = ["document_id", "section_id"]
    mine = of.select(F.col("chunk_id").alias("of"), *group)

    def first(rows: DataFrame, by: list[str], n: int) -> DataFrame:
        return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy("chunk_index"))).where(F.col("rn") <= n).drop("rn")

    near = chunks.select(*group, "chunk_id", "chunk_index").where("section_id is not null")
    if same_section:
        found = first(near, group, limit + 1).join(mine, group)
    else:
        near = first(first(near, group, limit), ["document_id"], 2 * limit)
        found = near.join(mine.withColumnRenamed("section_id", "s"), "document_id").where("s <> section_id")
    return first(found.where("of <> chunk_id").select("of", "chunk_id", "chunk_index"), ["of"], limit)


def context_window(chunks: DataFrame, of: DataFrame, width: int = 2) -> DataFrame:
    """(of, chunk_id, offset): each wanted chunk with those at most ``width`` places away in its section; places equi-join, so no range join."""
    placed = chunks.withColumn("place", F.row_number().over(Window.partitionBy("section_id").orderBy("chunk_index"))).select("section_id", "chunk_id", "place")
    mine = placed.join(of.select("chunk_id"), "chunk_id", "left_semi").select("section_id", F.col("chunk_id").alias("of"), F.explode(F.sequence(F.col("place") - width, F.col("place") + width)).alias("place"), F.col("place").alias("mid"))
    return mine.join(placed, ["section_id", "place"]).select("of", "chunk_id", (F.col("place") - F.col("mid")).cast("long").alias("offset"))


def read_only_sql(spark, query: str, **tables: DataFrame) -> DataFrame:
    """Run a query over the given tables. Anything else is refused: the text has to be the body of a view, where Spark's grammar takes queries only."""
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
    view = f"read_only_{uuid.uuid4().hex}"
    try:
        spark.sql(f"create temporary view {view} as {query}")
    except ParseException as error:
        raise ValueError("only queries are allowed") from error
    return spark.table(view)
