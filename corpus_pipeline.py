"""Corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark leaks, tokenisation.

Each stage takes (spark, docs, sf_dir), docs being all that the stage before it kept, and returns a
DataFrame. All but the last return the columns of ``documents``. In every stage a null text is empty,
rows with a null id and repeated rows are judged each by its own text, an empty table gives an empty
table, and columns beside ``documents``' own are kept as they are, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.bpe import bpe_encode
from lexmill.llm.common import staged
from lexmill.llm.decontaminate import drop_contaminated
from lexmill.llm.simhash import keep_one_per_group
from lexmill.llm.suffix_dedup import repeated_spans
from lexmill.llm.toxicity import drop_toxic
from lexmill.session import ship

#: No single SQL statement can fit the toxicity chain, so the rows are tested against a brute-force version.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier chain rejects; without labels none is."""
    return drop_toxic(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the least id, of each SimHash group; word-less texts are one group."""
    ship(spark)
    return keep_one_per_group(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut byte strings of 200 bytes that start elsewhere too out of every text; n_chars follows.

    All rows stay. Where a cut splits a character, U+FFFD stands for its remaining bytes.
    """
    ship(spark)
    cut = repeated_spans(docs, min_bytes=200)
    out = cut.withColumn("text", F.when(F.size("removed_spans") == 0, F.col("text")).otherwise(F.make_valid_utf8(F.col("kept_bytes").cast("string"))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("removed_spans") == 0, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage; null and empty items match nothing."""
    return drop_contaminated(docs, ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids, decoded; an empty text has no ids. One row for each row."""
    ship(spark)
    return bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
