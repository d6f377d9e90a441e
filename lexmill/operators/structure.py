"""Heading levels of parsed page items, as window expressions over each document's items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.headings import is_screen_text, is_title, numbering


def page_items(docs: DataFrame, id_col: str = "doc", page_col: str = "pages") -> DataFrame:
    """(doc, pos, type, value, md, h) in page order from an array of pages with items."""
    pages = docs.select(id_col, F.posexplode(page_col).alias("p", "page"))
    items = pages.select(id_col, "p", F.posexplode("page.items").alias("i", "item"))
    order = F.row_number().over(Window.partitionBy(id_col).orderBy("p", "i")) - 1
    return items.select(F.col(id_col).alias("doc"), order.cast("long").alias("pos"), "item.type", F.trim(F.coalesce("item.value", F.lit(""))).alias("value"), F.coalesce("item.md", F.lit("")).alias("md"), F.coalesce("item.bBox.h", F.lit(0.0)).alias("h"))


def heading_facts(items: DataFrame, footers: list[str] | None = None) -> DataFrame:
    """Heading items with numbering n, title and screen flags, and the document's least valid height; footers: a publisher's own."""
    heads = items.where((F.col("type") == "heading") & (F.col("value") != ""))
    heads = heads.withColumn("n", numbering(F.col("value"))).withColumn("title", is_title(F.col("value"))).withColumn("screen", is_screen_text(F.col("value"), footers))
    valid = F.col("n").isNotNull() | F.col("title")
    least = F.min(F.when(valid & (F.col("h") > 0), F.col("h"))).over(Window.partitionBy("doc"))
    return heads.withColumn("valid", valid).withColumn("least_h", F.coalesce(least * 0.85, F.lit(10.0)))


def height_levels(facts: DataFrame) -> DataFrame:
    """(doc, h, level): the six greatest heights of numbered or title headings."""
    seen = facts.where(F.col("valid") & (F.col("h") > 0)).select("doc", "h").distinct()
    return seen.withColumn("level", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("h")))).where("level <= 6")


def _fixed_level() -> Column:
    kind, depth = F.col("n.kind"), F.col("n.depth")
    return F.when(kind.isin("roman", "letter"), 2).when(kind == "roman_arabic", 3).when(kind == "decimal", F.least(depth + 1, F.lit(6))).when(F.col("n").isNull() & F.col("title"), 1)


def heading_levels(items: DataFrame) -> DataFrame:
    """(doc, pos, value, level) of headings; level is null for those that are plain text.

    Numbered and title headings have levels of their own. Any other heading is one deeper than the
    heading before it, six at most; the first of a document takes its level from its height. So a
    heading's level is that of the last anchor plus its distance to it.
    """
    facts = heading_facts(items)
    real = facts.where(~F.col("screen") & ((F.col("h") >= F.col("least_h")) | F.col("n").isNotNull()))
    in_doc = Window.partitionBy("doc").orderBy("pos")
    real = real.withColumn("nth", F.row_number().over(in_doc)).withColumn("fixed", _fixed_level())
    near = real.where("nth = 1 and fixed is null").join(height_levels(facts).withColumnsRenamed({"h": "h2", "level": "by_height"}), "doc", "left").withColumn("gap", F.abs(F.col("h2") - F.col("h")))
    near = near.groupBy("doc").agg(F.min(F.when(F.col("gap") < 3, F.struct("gap", "by_height"))).alias("best"))
    real = real.join(near, "doc", "left")
    first = F.when(F.col("n.kind") == "parenthetical", 4).otherwise(F.coalesce("best.by_height", F.lit(3)))
    real = real.withColumn("anchor", F.when(F.col("fixed").isNotNull(), F.col("fixed")).when(F.col("nth") == 1, first))
    real = real.withColumn("run", F.count("anchor").over(in_doc))
    in_run = Window.partitionBy("doc", "run").orderBy("pos")
    level = F.least(F.first("anchor").over(in_run) + F.row_number().over(in_run) - 1, F.lit(6))
    real = real.select("doc", "pos", level.cast("int").alias("level"))
    return facts.select("doc", "pos", "value").join(real, ["doc", "pos"], "left")


def close_gaps(levels: DataFrame) -> DataFrame:
    """The levels that a document uses, numbered 1, 2, 3 ... in order."""
    rank = F.dense_rank().over(Window.partitionBy("doc").orderBy("level"))
    return levels.where("level is not null").withColumn("level", rank.cast("int"))


def build_markdown(items: DataFrame) -> DataFrame:
    """(doc, markdown): headings with their levels, texts and tables with an empty line after each."""
    levels = close_gaps(heading_levels(items)).select("doc", "pos", "level")
    line = F.when(F.col("type") == "heading", F.when(F.col("level").isNull(), F.col("value")).otherwise(F.concat(F.expr("repeat('#', level)"), F.lit(" "), "value")))
    line = line.when(F.col("type") == "text", F.when(F.col("value") != "", F.concat("value", F.lit("\n")))).when(F.col("type") == "table", F.when(F.col("md") != "", F.concat("md", F.lit("\n"))))
    lined = items.join(levels, ["doc", "pos"], "left").select("doc", "pos", line.alias("line")).where("line is not null and line <> ''")
    return lined.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), "\n").alias("markdown"))
