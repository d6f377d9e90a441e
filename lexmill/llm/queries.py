"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_encode
from .decontaminate import find_contamination
from .html_extract import extract_main_text
from .lexical_shards import lexical_search
from .lexical_shards import oracle as search_sql
from .licenses import oracle as license_sql
from .licenses import scan_licenses
from .pu_quality import quality_scores
from .quality_rules import repetition_rules
from .simhash import simhash_groups
from .source_mix import mix_sources
from .source_mix import oracle as mix_sql
from .suffix_dedup import repeated_spans
from .token_files import token_file_index
from .toxicity import toxicity_scores
from .vector_codes import oracle as codes_sql
from .vector_codes import vector_codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeated_spans(table(spark, sf_dir, "documents"), min_bytes=200)
    return cut.select(
        "doc_id",
        F.col("text_bytes").alias("n_bytes"),
        (F.col("text_bytes") - F.length("kept_bytes")).cast("long").alias("n_removed"),
        F.size("removed_spans").cast("long").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", "source", "lang", "doc_id"))
    return scan_licenses(files)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_index(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "source", "repeats")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_bpe, op3_decontaminate, op4_html_text, op5_simhash, op6_quality, op7_toxicity, op8_licenses, op9_quality_rules, op10_token_files, op11_vector_codes, op12_lexical_search, op13_source_mix, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op8_licenses": license_sql(), "op11_vector_codes": codes_sql(), "op12_lexical_search": search_sql(), "op13_source_mix": mix_sql()}
