"""Selection of chunks for a question set: budgets, diversity, coverage, neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.storage import staged

from .vectors import cosine

BUDGET, LAMBDA, COVERAGE = 3000, 0.7, 0.7


def chunks_needed(questions: Column, budget: int = BUDGET) -> Column:
    """Chunks for a number of questions: half as many more for few, a fifth for many; 3 to 30, and at most one for 100 budget tokens."""
    wanted = F.when(questions <= 5, F.floor(questions * 1.5)).when(questions <= 15, F.floor(questions * 1.3)).otherwise(F.floor(questions * 1.2))
    return F.greatest(F.lit(3), F.least(F.lit(30), wanted, F.lit(budget // 100))).cast("long")


def budget_prefix(ranked: DataFrame, group: str, order: list[str], n: Column | int, budget: int = BUDGET) -> DataFrame:
    """The leading rows of each group whose tokens stay within the budget, n at most: everything from the first overflow on goes."""
    w = Window.partitionBy(group).orderBy(*order)
    marked = ranked.withColumn("place", F.row_number().over(w)).withColumn("spent", F.sum("token_count").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.where((F.col("spent") <= budget) & (F.col("place") <= n)).drop("spent")


def representative_scores(chunks: DataFrame, doc: str = "document_id") -> DataFrame:
    """``chunks`` (with distance, token_count, chunk_index, section_path size) with a ``score``: centrality, length, header, position.

    A document's size and greatest distance are aggregated and joined, so its rows never meet in one task.
    """
    whole = chunks.groupBy(doc).agg(F.count("*").alias("__size"), F.max("distance").alias("__far"))
    position = F.col("chunk_index") / F.col("__size")
    central = 3.0 * (1 - F.col("distance") / (F.col("__far") + 1e-9))
    length = F.when(F.col("token_count").between(50, 150), 2.0).when(F.col("token_count").between(30, 180), 1.0).otherwise(0.0)
    place = F.when(position.between(0.15, 0.85), 2.0).when(position.between(0.05, 0.95), 1.0).otherwise(0.0)
    heading = F.when(F.col("section_id").isNotNull(), 1.0).otherwise(0.0)
    return chunks.join(whole, doc).withColumn("score", F.round(central + length + heading + place, 6)).drop("__size", "__far")


def mmr_order(score: np.ndarray, vectors: np.ndarray, n: int, weight: float = LAMBDA, scale: float = 5.0, before: np.ndarray | None = None, least: tuple[float, int] | None = None) -> list[int]:
    """Greedy maximal marginal relevance over rows in order; the likeness to what is chosen is kept up to date, so a step is one product. Ties: first row.

    before: vectors chosen earlier. least: (gain, row) of the last candidate among ``score``; as gains only fall once something
    is chosen, a row that is still ahead of it is ahead of all rows that are not here, and picking stops at one that is not.
    Without ``before`` the candidates' gains are scores alone, and a first choice that points away from other rows raises theirs: picking stops behind it.
    """
    norm = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    unit, out, free = norm(vectors), [], np.ones(len(score), bool)
    likeness = lambda v: (unit * v).sum(axis=1)  # noqa: E731  # row by row, so that equal rows tie
    near = np.max([likeness(v) for v in norm(before)], axis=0) if before is not None and len(before) else None
    alone = near is None
    while len(out) < min(n, len(score)):
        gain = np.where(free, weight * score - (1 - weight) * scale * (0 if near is None else near), -np.inf)
        best = int(np.argmax(gain))
        if least is not None and out and (alone or (-gain[best], best) > (-least[0], least[1])):
            break
        out.append(best)
        free[best] = False
        like = likeness(unit[best])
        near = like if near is None else np.maximum(near, like)
    return out


#: Candidates of a document that one round of ``select_diverse`` looks at.
CANDIDATES = 256


def _narrow(scored: DataFrame, doc: str) -> DataFrame:
    return staged(scored.select(F.col(doc), "chunk_id", F.col("chunk_index").cast("long"), F.col("token_count").cast("long"), F.col("score").cast("double"), F.col("embedding").cast("array<double>")), "scored")


def select_diverse(scored: DataFrame, n: int, doc: str = "document_id", weight: float = LAMBDA, scale: float = 5.0) -> DataFrame:
    """(doc, chunk_id, chunk_index, token_count, score, pick): MMR order of each document's n picks, ties to the lesser chunk_index.

    No task holds a document's rows, which may be a third of the table. A round takes each open document's CANDIDATES
    best rows by their gain beside what is picked; every task names its own best first. It picks among them as long as
    the best is sure to be ahead of every other row, at least one a round. A written round is a row a pick.
    """
    rows = _narrow(scored, doc).where("embedding is not null")
    return _diverse(rows, rows.groupBy(doc).agg(F.count("*").alias("size")), n, doc, weight, scale)


def _diverse(rows: DataFrame, sizes: DataFrame, n: int, doc: str, weight: float = LAMBDA, scale: float = 5.0) -> DataFrame:
    """``select_diverse`` over stored rows, for the documents in ``sizes`` (doc, size)."""
    kind = rows.schema[doc].dataType.simpleString()
    columns = ["chunk_id", "chunk_index", "token_count", "score", "embedding"]

    def kernel(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["gain", "chunk_index"], ascending=[False, True], kind="stable").reset_index(drop=True)
        last = (float(frame["gain"].iloc[-1]), int(frame["chunk_index"].iloc[-1])) if len(frame) == CANDIDATES else None
        before, done = np.array([list(x) for x in frame["chosen"].iloc[0]], float), int(frame["done"].iloc[0])
        frame = frame.sort_values("chunk_index", kind="stable").reset_index(drop=True)
        least = last and (last[0] + 1e-12, int(np.searchsorted(frame["chunk_index"].to_numpy(), last[1])))
        order = mmr_order(frame["score"].to_numpy(), np.stack(frame["embedding"].to_numpy()).astype(float), n - done, weight, scale, before, least)
        return frame.loc[order, [doc, *columns]].assign(pick=range(done + 1, done + 1 + len(order)))

    sizes = staged(sizes.select(doc, F.least("size", F.lit(n)).alias("most")), "sizes")
    open_ = sizes.select(doc, F.lit(0).cast("long").alias("done"), F.array().cast("array<array<double>>").alias("chosen"))
    picked = None
    while True:
        near = F.coalesce(F.array_max(F.transform("chosen", lambda v: cosine(v, F.col("embedding")))), F.lit(0.0))
        left = rows if picked is None else rows.join(picked.select(doc, "chunk_id"), [doc, "chunk_id"], "left_anti")
        left = left.join(open_, doc).withColumn("gain", weight * F.col("score") - (1 - weight) * scale * near)
        rank = F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("gain"), "chunk_index"))
        best = left.withColumn("rank", rank).where(F.col("rank") <= CANDIDATES).drop("rank")
        more = staged(best.groupBy(doc).applyInPandas(kernel, f"{doc} {kind}, chunk_id string, chunk_index long, token_count long, score double, embedding array<double>, pick long"), "picked")
        picked = more if picked is None else staged(picked.unionByName(more), "picked")
        done = picked.groupBy(doc).agg(F.count("*").alias("done"), F.collect_list("embedding").alias("chosen"))
        open_ = done.join(sizes, doc).where(F.col("done") < F.col("most")).drop("most")  # a row a document, with n vectors at most
        if open_.isEmpty():
            return picked.select(doc, "chunk_id", "chunk_index", "token_count", "score", "pick")


def select_representative(scored: DataFrame, n: int, doc: str = "document_id", budget: int = BUDGET) -> DataFrame:
    """Documents of at most n chunks whole with score 1; of others the MMR picks within the budget."""
    rows = _narrow(scored, doc)
    sizes = rows.groupBy(doc).agg(F.count("*").alias("n_chunks"), F.count("embedding").alias("size"))
    small = rows.join(sizes.where(F.col("n_chunks") <= n).select(doc), doc, "left_semi").select(doc, "chunk_id", "chunk_index", "token_count", F.lit(1.0).alias("score"))
    picked = _diverse(rows.where("embedding is not null"), sizes.where(F.col("n_chunks") > n).select(doc, "size"), n, doc)
    kept = budget_prefix(picked, doc, ["pick"], n, budget).select(*small.columns)
    return small.unionByName(kept).withColumn("selection_method", F.lit("representative"))


def add_neighbours(selected: DataFrame, chunks: DataFrame, doc: str = "document_id", budget: int | None = None, turn: str = "chunk_index") -> DataFrame:
    """``selected`` and, of each pick, the chunks before and behind it in the same section, at 0.8 of its score.

    A neighbour of two picks goes to the earlier one in the order of ``turn``, a column of ``selected``. With a budget, each document's neighbours are taken in
    order, those that do not fit are passed over and later ones may still fit, which needs a sequential kernel.
    """
    sides = selected.select(doc, F.col("chunk_index").alias("of"), F.col(turn).alias("turn"), F.col("score").alias("base"), "section_id", F.explode(F.array(F.lit(-1), F.lit(1))).alias("side"))
    wanted = sides.withColumn("chunk_index", F.col("of") + F.col("side"))
    here = chunks.select(doc, "section_id", "chunk_index", "chunk_id", "token_count")
    found = wanted.join(here, [doc, "section_id", "chunk_index"]).join(selected.select(doc, "chunk_id"), [doc, "chunk_id"], "left_anti")
    first = found.withColumn("rn", F.row_number().over(Window.partitionBy(doc, "chunk_id").orderBy("turn", "side"))).where("rn = 1")
    added = first.select(doc, "chunk_id", "chunk_index", "token_count", F.round(F.col("base") * 0.8, 6).alias("score"), "section_id", "turn", "side", F.lit("context_expansion").alias("selection_method"))
    if budget is not None:
        spent = selected.groupBy(doc).agg(F.sum("token_count").alias("spent"))

        def kernel(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["turn", "side"], kind="stable")
            room, keep = budget - int(frame["spent"].iloc[0]), []
            for cost in frame["token_count"]:
                keep.append(cost <= room)
                room -= cost if keep[-1] else 0
            return frame[keep].drop(columns="spent")

        added = added.join(spent, doc).groupBy(doc).applyInPandas(kernel, added.schema)
    added = added.drop("turn", "side")
    return selected.select(*added.columns).unionByName(added)


def cover_sections(selected: DataFrame, chunks: DataFrame, doc: str = "document_id", least: float = COVERAGE, budget: int = BUDGET) -> DataFrame:
    """The chunks that bring in uncovered sections of documents under the wanted coverage: the most central of each, in order of the section, until the first overflow."""
    sections = chunks.groupBy(doc, "section_id").agg(F.min("chunk_index").alias("first_index"))
    covered = selected.select(doc, "section_id").distinct()
    share = sections.join(covered.withColumn("c", F.lit(1)), [doc, "section_id"], "left").groupBy(doc).agg((F.count("c") / F.count("*")).alias("coverage"))
    spent = selected.groupBy(doc).agg(F.sum("token_count").alias("used"))
    best = chunks.join(sections, [doc, "section_id"]).join(covered, [doc, "section_id"], "left_anti").join(share.where(F.col("coverage") < least), doc)
    best = best.withColumn("rn", F.row_number().over(Window.partitionBy(doc, "section_id").orderBy("distance", "chunk_index"))).where("rn = 1").join(spent, doc, "left")
    running = F.sum("token_count").over(Window.partitionBy(doc).orderBy("first_index").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = best.withColumn("total", running + F.coalesce("used", F.lit(0))).where(F.col("total") <= budget)
    return out.select(doc, "chunk_id", "chunk_index", "token_count", F.round(1 / (1 + F.col("distance")), 6).alias("score"), "section_id", F.lit("section_coverage").alias("selection_method"))


PICKED = ["chunk_id", "chunk_index", "token_count", "score", "section_id", "selection_method"]


def select_by_strategy(decided: DataFrame, found: DataFrame, scored: DataFrame, chunks: DataFrame, n: int, doc: str = "document_id", budget: int = BUDGET) -> DataFrame:
    """(doc, chunk_id, chunk_index, token_count, score, section_id, selection_method): the branch that each document's strategy names.

    decided: (doc, strategy), a row a document. found: search results as (doc, chunk_id, chunk_index, token_count, score,
    section_id). scored: ``representative_scores`` of all chunks. search: the n best within the budget, and neighbours
    within what is left if they are fewer; hybrid: six tenths of n from search, the rest representative among the
    other chunks, each part with a budget of its own; representative: marked as a fallback.
    """
    share = int(n * 0.6)
    of = lambda rows, name: rows.join(decided.where(F.col("strategy") == name).select(doc), doc, "left_semi")
    order = [F.desc("score"), F.col("chunk_id")]
    place = chunks.select(doc, "chunk_id", "section_id")

    leading = lambda rows, most: budget_prefix(rows, doc, order, most, budget).select(doc, *PICKED[:-1], F.lit("search").alias("selection_method"), "place")
    spread = lambda rows, most: select_representative(rows, most, doc, budget).join(place, [doc, "chunk_id"]).select(doc, *PICKED)

    search = leading(of(found, "search"), n)
    short = search.groupBy(doc).agg(F.count("*").alias("k")).where(F.col("k") < n)
    wider = add_neighbours(search.join(short, doc, "left_semi"), chunks, doc, budget, "place").select(doc, *PICKED)
    mixed = leading(of(found, "hybrid"), share).drop("place")
    rest = spread(of(scored, "hybrid").join(mixed.select(doc, "chunk_id"), [doc, "chunk_id"], "left_anti"), n - share)
    fallback = spread(of(scored, "representative"), n).withColumn("selection_method", F.lit("representative_fallback"))
    out = search.join(short, doc, "left_anti").select(doc, *PICKED)
    for part in (wider, mixed, rest, fallback):
        out = out.unionByName(part)
    return out


def select_candidates(prompts: DataFrame, decided: DataFrame, found: DataFrame, scored: DataFrame, chunks: DataFrame, n: int, doc: str = "document_id") -> DataFrame:
    """The columns of ``select_by_strategy``: documents whose prompt (doc, prompt) is not blank by their strategy, search where none
    is decided; all others representative, with uncovered sections added."""
    asked = prompts.where(F.trim("prompt") != "").select(doc).distinct()
    strategies = asked.join(decided.select(doc, "strategy"), doc, "left").select(doc, F.coalesce("strategy", F.lit("search")).alias("strategy"))
    quiet = scored.join(asked, doc, "left_anti")
    whole = staged(select_representative(quiet, n, doc).join(chunks.select(doc, "chunk_id", "section_id"), [doc, "chunk_id"]).select(doc, *PICKED), "representative")
    cover = cover_sections(whole, quiet, doc).select(doc, *PICKED)
    return select_by_strategy(strategies, found, scored, chunks, n, doc).unionByName(whole).unionByName(cover)


def selection_summary(selected: DataFrame, doc: str = "document_id") -> DataFrame:
    return selected.groupBy(doc, "selection_method").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))
