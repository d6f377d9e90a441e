"""Text measures and tests as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def token_estimate(text: Column) -> Column:
    """Estimated model tokens: half of 1.3 words plus a quarter of the characters, rounded down; '' gives 0."""
    return F.floor((F.size(words(text)) * F.lit(1.3).cast("double") + F.length(text) / F.lit(4.0).cast("double")) / 2).cast("long")


def tokens(text: Column, min_length: int = 2) -> Column:
    """Lower-cased word tokens in order; three character references are blanked first."""
    clean = F.regexp_replace(F.lower(text), "&#x26;|&#x3c;|&#x3e;", " ")
    found = F.regexp_extract_all(clean, F.lit(r"(?U)\b\w+\b"), F.lit(0))
    return F.filter(found, lambda t: F.length(t) >= min_length) if min_length > 1 else found


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w+\b"), F.lit(0))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def is_table(text: Column) -> Column:
    """At least two pipe rows, two rows with a pipe between words, or two grid rules."""
    rows = lines(text)

    def many(test) -> Column:
        return F.size(F.filter(rows, test)) >= 2

    return many(lambda r: F.trim(r).startswith("|")) | many(lambda r: r.rlike(r"\S\s*\|\s*\S")) | many(lambda r: F.trim(r).rlike(r"^\+[-=+]+\+$"))


def has_code(text: Column) -> Column:
    return text.rlike(r"(?s)```.*?```")


def chunk_type(text: Column) -> Column:
    """heading, table, code or content; the first that holds."""
    body = F.trim(text)
    return F.when(body.rlike(r"^#{1,6}\s+.+"), "heading").when(is_table(body), "table").when(has_code(body), "code").otherwise("content")


def header_level(line: Column) -> Column:
    """Number of leading # of a Markdown header line, 0 for any other line."""
    return F.length(F.regexp_extract(line, r"^(#{1,6})\s+\S", 1))


def has_body(text: Column, least: int = 10) -> Column:
    """Whether at least ``least`` characters are left without header lines."""
    return F.length(F.trim(F.regexp_replace(text, r"(?m)^#{1,6}\s+.+$", ""))) >= least


def is_toc_line(line: Column) -> Column:
    body = F.trim(line)
    return body.rlike(r"^[-*]\s+\[.+\]\(#.+\)$") | body.rlike(r"^\d+\.\s+\[.+\]\(#.+\)$") | body.rlike(r"^[-*]\s+.+\.{2,}\s*\d+$")


def fixed_windows(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Array of character windows that start every size-overlap characters."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size))))


def preview(text: Column, size: int = 500) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def file_size(size: Column) -> Column:
    """Bytes in B, KB, MB, GB or TB with two places, halves to even."""

    def shown(power: int, unit: str) -> Column:
        return F.concat(F.call_function("format_number", size / F.lit(float(1 << power)), F.lit("0.00")), F.lit(f" {unit}"))

    out = shown(40, "TB")
    for unit, power in (("GB", 30), ("MB", 20), ("KB", 10), ("B", 0)):
        out = F.when(size < (1 << (power + 10)), shown(power, unit)).otherwise(out)
    return out


def clean_choice(choice: Column) -> Column:
    """Strip a leading answer letter and its sign from an option's text."""
    body = F.trim(choice)
    return F.when((F.length(body) > 2) & body.rlike(r"^[A-Da-d][)\]:.\-]"), F.trim(F.substring(body, 3, 1 << 30))).otherwise(body)


def fenced_json(text: Column) -> Column:
    """Body of the first json fence, else of the first fence, else the text; an open fence runs to the end."""
    return F.trim(
        F.when(text.contains("```json"), F.regexp_extract(text, r"(?s)```json(.*?)(?:```|\z)", 1))
        .when(text.contains("```"), F.regexp_extract(text, r"(?s)```(.*?)(?:```|\z)", 1))
        .otherwise(text)
    )


def drop_trailing_commas(text: Column) -> Column:
    return F.regexp_replace(text, r",(\s*[}\]])", "$1")
