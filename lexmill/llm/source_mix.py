"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators.ordered import Ranges, running
from lexmill.storage import staged

#: Patterns of words; white space is that of ASCII.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fill_level(sources: DataFrame, total: float) -> float:
    """The level at which min(cap, weight * level) of all sources adds up to ``total``, or no source is left below its cap.

    sources: (weight, cap). Each round shares what the clamped sources leave by the weights of the
    others and clamps those whose share is above their cap, until none is. Only sums reach the driver.
    """
    level, clamped = 0.0, -1
    while True:
        over = F.col("weight") * level > F.col("cap")
        caps, weights, n = sources.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0).otherwise(F.col("weight"))), F.count_if(over)).first()
        if not weights:
            return level
        if n == clamped:
            return level
        level, clamped = (total - caps) / weights, n


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 0
) -> DataFrame:
    """(doc_id, source, size, source_size, target, repeats, taken): how often a mix of ``share`` times all words takes each document.

    Sources in order of their code points, null last, take the ``weights`` in turn. A source's target
    stops at ``max_epochs`` times its size; what is above is shared anew by weight. Every document is
    taken whole as often as target over source size says in whole numbers; for the rest, documents are
    taken once more in the order of a seeded hash of the id, as long as half of the document still fits.
    So a source's words miss its target by half a document at most, and no document is taken more than
    ``max_epochs`` times, rounded up. Texts are read once, for their sizes; running sums over the documents
    of a source are spread over ranges.

    Null and empty texts have size 0. Rows with a null or repeated id are documents of their own; rows
    equal in source, id and size are interchangeable, so reruns agree. Empty tables give empty tables. A
    table without words has targets 0. Other columns are ignored, whatever their names.
    """
    order = F.substring(F.md5(F.concat_ws(" ", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 16)
    # '=' sorts before '~', so null comes last
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("~"))
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col).cast("string")).alias("size"), key.alias("key"), order.alias("turn"))
    sized = staged(sized, "mix-sizes")  # dealing rows to ranges looks at them twice, and texts should be read once
    ranges = Ranges(sized, ["key"], [F.col("turn"), F.col("doc_id"), F.col("size")])
    sizes = ranges.rows.groupBy("key").agg(F.sum("size").alias("source_size"))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = staged(running(sizes, [], [F.col("key")]).select("key", "source_size", turn.alias("weight"), (max_epochs * F.col("source_size")).alias("cap")), "mix-sources")
    level = fill_level(sources, share * float(sources.agg(F.sum("source_size")).first()[0] or 0))
    planned = sources.select("key", "source_size", F.least("cap", F.col("weight") * level).alias("target"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rows = ranges.running({"before": "size"}, beside=planned).withColumn("whole", whole)
    more = (F.col("size") > 0) & (F.col("before") + F.col("size") / 2 <= F.col("target") - F.col("whole") * F.col("source_size"))
    rows = rows.withColumn("repeats", F.col("whole") + more.cast("long"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))


def oracle(weights: Sequence[int] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 0) -> str:
    """The same in DuckDB, with the level from the sources in the order in which they reach their caps."""
    listed = ", ".join(f"{float(w)}::double" for w in weights)
    return rf"""with sized as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint size, md5('{seed} ' || coalesce(doc_id::varchar, ''))[1:16] turn from documents),
sizes as (select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) - 1 place from sized group by source),
sources as (select source, source_size, [{listed}][(place % {len(weights)} + 1)::int] weight, {max_epochs}::double * source_size cap from sizes),
filled as (select *, coalesce(sum(cap) over w, 0) caps, sum(weight) over () - coalesce(sum(weight) over w, 0) left_weight, {share}::double * sum(source_size) over () total from sources window w as (order by cap / weight, source rows between unbounded preceding and 1 preceding)),
level as (select (total - caps) / left_weight as level from filled where (total - caps) / left_weight <= cap / weight order by cap / weight limit 1),
planned as (select source, source_size, least(cap, weight * level) target from sources, level),
placed as (select *, coalesce(sum(size) over (partition by source order by turn, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as before from sized),
rated as (select s.*, source_size, target, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as whole from placed s join planned p on s.source is not distinct from p.source),
counted as (select *, whole + (size > 0 and before + size / 2 <= target - whole * source_size)::bigint repeats from rated)
select doc_id, source, size, source_size, target, repeats, repeats * size taken from counted"""
