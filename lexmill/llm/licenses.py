"""Licence scan: TF-IDF cosine of headers and licence files to templates, then inheritance from directories.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import often, staged
from .license_texts import all_templates

TEMPLATES = all_templates()
#: A line or paragraph that may be a licence header.
HINT = r"(?i)licen[sc]|copyright|spdx|public domain|creative commons|rights reserved|redistribution|permission is hereby|permission to use|neither the name|software is provided"
#: A line or paragraph that says which licence does not hold is no header.
NEGATED = r"(?i)\bnot\s+(\w+\s+){0,2}(licen[sc]ed|released|available)\s+under\b"
#: Lines without letters or digits part paragraphs, so that headers inside comment marks fall apart too.
PARAGRAPH = r"\n(?:[^\p{L}\p{N}\n]*\n)+"
#: Base names of licence files.
FILE_NAME = r"(?i)^(licen[sc]e|copying|copyright|unlicense)([-._].*)?$"
THRESHOLD = 0.6
#: Cosine from which a text that no file name marks counts as a licence file as a whole.
FILE_THRESHOLD = 0.9
TERM = "[a-z0-9]+"
#: Taken only where no other licence is found: the words stand beside many licences.
VAGUE = "Proprietary"


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def template_weights(spark: SparkSession, templates: list[tuple[str, str]] | None = None) -> tuple[DataFrame, float]:
    """(t, license, term, idf, w): unit TF-IDF vectors of the templates, with the idf of each term; idf of terms in none of them.

    idf = ln((1 + N) / (1 + df)) + 1 over the N templates. The table has a row for each template and term, whatever the corpus.
    """
    import math

    rows = [(i, a, b) for i, (a, b) in enumerate(templates or TEMPLATES)]
    parts = spark.createDataFrame(rows, "t int, license string, text string").select("t", "license", F.explode(_terms("text")).alias("term")).groupBy("t", "license", "term").agg(F.count("*").alias("tf"))
    df = parts.groupBy("term").agg(F.count("*").alias("df"))
    weighted = parts.join(F.broadcast(df), "term").withColumn("idf", F.log((1.0 + len(rows)) / (1.0 + F.col("df"))) + 1.0).withColumn("w", F.col("tf") * F.col("idf"))
    norm = weighted.groupBy("t").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(F.broadcast(norm), "t").select("t", "license", "term", "idf", (F.col("w") / F.col("norm")).alias("w")), math.log(1.0 + len(rows)) + 1.0


def _best() -> Column:
    """The least of (vague, -score, license): what is taken of several licences."""
    return F.min(F.struct((F.col("license") == VAGUE).alias("vague"), (-F.col("score")).alias("s"), F.col("license").alias("l")))


#: What tells units of text apart: two 64-bit hashes of different seeds, and the cosine that is asked for.
KEY = ["h1", "h2", "least"]


def best_template(units: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(KEY, license, score): the licence whose templates have the highest cosine to each unit of text (columns KEY, unit), from ``least`` on.

    Scores are rounded to 6 places; ties go to the lesser licence name. Only the constant template table is broadcast.
    """
    weights, unknown = template_weights(units.sparkSession, templates)
    idf = F.broadcast(weights.select("term", "idf").distinct())
    terms = units.select(*KEY, F.explode(_terms("unit")).alias("term")).groupBy(*KEY, "term").agg(F.count("*").alias("tf"))
    valued = terms.join(idf, "term", "left").withColumn("v", F.col("tf") * F.coalesce("idf", F.lit(unknown))).drop("idf")
    normed = valued.withColumn("norm", F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(*KEY))))
    scored = normed.join(F.broadcast(weights.select("t", "license", "term", "w")), "term").groupBy(*KEY, "t", "license").agg(F.round(F.sum(F.col("v") * F.col("w") / F.col("norm")), 6).alias("score"))
    return scored.where("score >= least").groupBy(*KEY).agg(_best().alias("b")).select(*KEY, F.col("b.l").alias("license"), (-F.col("b.s")).alias("score"))


def scan_licenses(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD, file_threshold: float = FILE_THRESHOLD, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, path, license, score, origin) of every row of ``files``.

    Compared with the templates are a text's lines and paragraphs that hold a hint and no negation, all these paragraphs
    together, and, at ``file_threshold`` unless the name is that of a licence file, the whole text. origin 'file': the
    whole text meets a template, or the row has such a name; 'header': another part does; 'inherited': none does, and
    the nearest directory at or above its own that holds a licence file has one (several there: the highest score, then
    the lesser name); null: none. A null text is empty; a null path has no directory and inherits nothing.
    Repeated rows each give a row; an empty table gives an empty table; other columns are not read.
    """
    read = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    named = F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(FILE_NAME), F.lit(False))
    # one scan of the texts: rows get a number, and only those with a hint keep their text
    rows = staged(read.select("doc_id", "path", F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), named.alias("named"), F.monotonically_increasing_id().alias("k"), F.when(F.col("text").rlike(HINT) | named, F.col("text")).alias("text")), "files")
    hinted = rows.where("text is not null").select("k", "named", "text")
    header = lambda x: x.rlike(HINT) & ~x.rlike(NEGATED)
    parts = F.filter(F.split("text", PARAGRAPH), header)
    units = hinted.select("k", "named", F.explode(F.array_distinct(F.concat(F.filter(F.split("text", "\n"), header), parts, F.array(F.array_join(parts, "\n"))))).alias("unit"), F.lit(2).alias("rank"))
    units = units.unionByName(hinted.select("k", "named", F.col("text").alias("unit"), F.lit(1).alias("rank")))
    units = units.withColumns({"h1": F.xxhash64("unit"), "h2": F.xxhash64(F.lit(1), "unit"), "least": F.when((F.col("rank") == 2) | F.col("named"), threshold).otherwise(file_threshold)})
    # a part that many rows share is scored once
    found = units.select("k", "named", "rank", *KEY).join(best_template(units.dropDuplicates(KEY), templates), KEY)
    own = found.groupBy("k", "named").agg(F.min(F.struct((F.col("license") == VAGUE).alias("vague"), (-F.col("score")).alias("s"), F.col("license").alias("l"), "rank")).alias("b"))
    own = staged(own.select("k", F.col("b.l").alias("license"), (-F.col("b.s")).alias("score"), F.when(F.col("named") | (F.col("b.rank") == 1), "file").otherwise("header").alias("origin")), "own")

    placed = rows.select("k", "doc_id", "path", "dir")
    of_dir = placed.join(own.where("origin = 'file'"), "k").where("dir is not null").groupBy("dir").agg(_best().alias("b")).select(F.col("dir").alias("at"), F.col("b.l").alias("dir_license"), (-F.col("b.s")).alias("dir_score"))
    dirs = staged(placed.where("dir is not null").groupBy("dir").agg(F.count("*").alias("n")), "dirs")
    steps = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))).alias("at")).distinct()
    nearest = staged(above.join(of_dir, "at").groupBy("dir").agg(F.max(F.struct(F.length("at").alias("n"), "dir_license", "dir_score")).alias("b")).select("dir", "b.dir_license", "b.dir_score"), "nearest")
    # a directory may hold a third of all rows: rows of hot ones, at most HOT_SHARE directories, are not brought together
    hot = F.broadcast(often(dirs, rows).select("dir"))
    mine = placed.join(own, "k", "left")
    joined = mine.join(hot, "dir", "left_semi").join(F.broadcast(nearest.join(hot, "dir", "left_semi")), "dir", "left").unionByName(mine.join(hot, "dir", "left_anti").join(nearest, "dir", "left"))
    return joined.select("doc_id", "path", F.coalesce("license", "dir_license").alias("license"), F.coalesce("score", "dir_score").alias("score"), F.when(F.col("license").isNotNull(), F.col("origin")).when(F.col("dir_license").isNotNull(), "inherited").alias("origin"))


def oracle(source: str = "documents", path: str = "source || '/' || lang || '/' || doc_id") -> str:
    """DuckDB SQL for ``scan_licenses`` over a table with unique doc_id, and no null there, in source or lang."""
    quoted = ", ".join("({}, '{}', '{}')".format(i, a, b.replace("'", "''")) for i, (a, b) in enumerate(TEMPLATES))
    hint, name = HINT.removeprefix("(?i)"), FILE_NAME.removeprefix("(?i)")
    hits = f"lambda x: regexp_matches(x, '{hint}', 'i') and not regexp_matches(x, '{NEGATED}')"
    return f"""
with tpl(t, license, text) as (values {quoted}),
tt as (select t, license, unnest(regexp_extract_all(lower(text), '{TERM}')) term from tpl),
tf as (select t, license, term, count(*) tf from tt group by all),
idf as (select term, ln((1.0 + (select count(*) from tpl)) / (1.0 + count(*))) + 1.0 idf from tf group by term),
w as (select t, license, tf.term, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) over (partition by t)) w from tf join idf using (term)),
rows_ as (select doc_id, {path} path, coalesce(text, '') text from {source}),
r as (select *, regexp_replace(path, '/?[^/]*$', '') dir, regexp_matches(split_part(path, '/', -1), '{name}', 'i') named from rows_),
hinted as (select *, list_filter(string_split(text, chr(10)), {hits}) lines, list_filter(regexp_split_to_array(text, '{PARAGRAPH}'), {hits}) parts from r where regexp_matches(text, '{hint}', 'i') or named),
units as (select distinct doc_id, named, 2 rank_, unnest(lines || parts || [array_to_string(parts, chr(10))]) unit from hinted union all select doc_id, named, 1, text from hinted),
terms as (select doc_id, named, rank_, unit, term, count(*) tf from (select *, unnest(regexp_extract_all(lower(unit), '{TERM}')) term from units) group by all),
valued as (select *, tf * coalesce(idf, ln(1.0 + (select count(*) from tpl)) + 1.0) v from terms left join idf using (term)),
normed as (select *, sqrt(sum(v * v) over (partition by doc_id, rank_, unit)) norm from valued),
scored as (select doc_id, named, rank_, unit, t, license, round(sum(v * w / norm), 6) score from normed join w using (term) group by all),
own as (select doc_id, license, score, case when named or rank_ = 1 then 'file' else 'header' end origin from scored where score >= case when rank_ = 2 or named then {THRESHOLD} else {FILE_THRESHOLD} end
  qualify row_number() over (partition by doc_id order by license = '{VAGUE}', score desc, license, rank_) = 1),
of_dir as (select dir, license, score from own join r using (doc_id) where origin = 'file' qualify row_number() over (partition by dir order by license = '{VAGUE}', score desc, license) = 1),
near as (select r.doc_id, d.license dir_license, d.score dir_score from r join of_dir d on r.dir = d.dir or d.dir = '' or starts_with(r.dir, d.dir || '/')
  qualify row_number() over (partition by r.doc_id order by length(d.dir) desc) = 1)
select r.doc_id, r.path, coalesce(license, dir_license) license, coalesce(score, dir_score) score, coalesce(origin, case when dir_license is not null then 'inherited' end) origin
from r left join own using (doc_id) left join near using (doc_id)"""
