"""Readers, routing, rejects and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File kinds that are accepted, and the reader of each.
ALLOWED = [".pdf", ".doc", ".docx", ".ppt", ".pptx", ".txt", ".png", ".jpg", ".jpeg"]
READERS = {".pdf": "pages", ".doc": "pages", ".docx": "pages", ".ppt": "pages", ".pptx": "pages", ".txt": "text"}
PAGE_JSON = "struct<pages: array<struct<items: array<struct<type: string, value: string, md: string, bBox: struct<h: double>>>>>>"
MAX_BYTES = 50 << 20
MIN_CHARS = 50


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def reader_of(path: Column) -> Column:
    """Name of the reader for a path, null if there is none."""
    out = F.lit(None).cast("string")
    for end, reader in READERS.items():
        out = F.when(extension(path) == end, reader).otherwise(out)
    return out


def is_allowed(path: Column) -> Column:
    return extension(path).isin(ALLOWED)


def file_meta(path: Column) -> Column:
    return F.struct(F.element_at(F.split(path, "/"), -1).alias("file_name"), F.element_at(F.split(path, r"\."), -1).alias("file_type"))


def as_markdown(text: Column) -> Column:
    """A plain text as Markdown with one first-level header."""
    return F.concat(F.lit("# Document Content\n\n"), text)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): whole text files."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), as_markdown(F.col("value")).alias("content"))


def read_page_json(spark: SparkSession, path: str, most: int = MAX_BYTES, suffix: str = ".json") -> DataFrame:
    """(path, size, doc, error): every file with the suffix below a folder, the page JSON of an external parser; doc is null where error says why.

    Errors: too large (such a file is listed and never opened), empty, not UTF-8, not JSON, unexpected shape (a field has another type than
    PAGE_JSON), no pages. Fields that are not in PAGE_JSON are ignored, items of pages may be missing. Files are dealt to tasks by their sizes;
    filters on size and path reach the listing, and without doc and error no file is read. A folder without such files gives no rows;
    Spark's readers pass over files of no bytes, so these give none either. "empty" is a file of white space.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(path)
    large = files.where(F.col("length") > most).select("path", F.col("length").alias("size"), F.lit(None).cast(PAGE_JSON).alias("doc"), F.lit("too large").alias("error"))
    text = files.where(F.col("length") <= most).select("path", F.col("length").alias("size"), F.col("content").cast("string").alias("text"))
    return page_docs(text).select("path", "size", "doc", "error").unionByName(large)


def page_docs(rows: DataFrame) -> DataFrame:
    """``rows`` (text and others) with doc, as PAGE_JSON, and error, which says why doc is null."""
    valid = F.is_valid_utf8("text")
    parsed = rows.withColumn("valid", valid).withColumn("got", F.when(F.col("valid"), F.from_json("text", f"{PAGE_JSON[:-1]}, broken: string>", {"columnNameOfCorruptRecord": "broken"})))
    whole = F.try_parse_json(F.when(F.col("valid"), F.col("text")))
    error = (
        F.when(~F.col("valid"), "not UTF-8").when(F.regexp_replace("text", r"\s+", "") == "", "empty").when(whole.isNull(), "not JSON")
        .when(F.col("got.broken").isNotNull(), "unexpected shape").when(F.coalesce(F.size("got.pages"), F.lit(0)) <= 0, "no pages")
    )
    parsed = parsed.withColumn("error", error)
    doc = F.when(F.col("error").isNull(), F.struct(F.col("got.pages").alias("pages")))
    return parsed.withColumn("doc", doc).drop("valid", "got", "text")


def read_page_lines(spark: SparkSession, path: str, most: int = MAX_BYTES) -> DataFrame:
    """(doc_id, size, doc, error): page JSON of many documents a file, a line for each: its id, a tab, the JSON. Errors as in ``read_page_json``.

    A file a document costs a listing, an opening and a removal each; lines are read in splits, however many documents there are.
    """
    line = spark.read.text(path, lineSep="\n").withColumn("tab", F.instr("value", "\t"))
    rows = line.select(F.expr("substring(value, 1, tab - 1)").alias("doc_id"), F.expr("substring(value, tab + 1)").alias("text")).withColumn("size", F.octet_length("text").cast("long"))
    large = rows.where(F.col("size") > most).select("doc_id", "size", F.lit(None).cast(PAGE_JSON).alias("doc"), F.lit("too large").alias("error"))
    return page_docs(rows.where(F.col("size") <= most)).select("doc_id", "size", "doc", "error").unionByName(large)


def with_errors(docs: DataFrame, text_col: str = "text", size_col: str | None = None) -> DataFrame:
    """``docs`` with an ``error`` column: null for usable rows. Nothing is dropped here."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    error = F.when(F.length(F.trim(text)) < MIN_CHARS, F.lit("too short"))
    if size_col:
        error = F.when(F.col(size_col) > MAX_BYTES, F.lit("too large")).otherwise(error)
    return docs.withColumn("error", error)


def write_chunks_json(chunks: DataFrame, path: str) -> None:
    """One JSON object a line and chunk."""
    chunks.write.mode("overwrite").json(path)


def write_markdown(docs: DataFrame, path: str, text_col: str = "content") -> None:
    docs.select(F.col(text_col).alias("value")).write.mode("overwrite").text(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str, dimension: int) -> DataFrame:
    """A vector table; an empty one if what is stored has another dimension, or none can be read."""
    from pyspark.errors import AnalysisException

    empty = spark.createDataFrame([], "chunk_id string, embedding array<float>")
    try:
        table = spark.read.parquet(path)
    except AnalysisException:
        return empty
    wrong = table.where(F.size("embedding") != dimension).limit(1).count()
    return table.limit(0) if wrong else table
