"""Views on the test tables that stand for documents, sections, chunks, questions and concepts; the same in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions.text import token_estimate, tokens


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """A source is a document, its rows are the chunks, (source, lang) is a section."""
    index = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    rows = table(spark, sf, "documents").withColumn("chunk_index", index.cast("long"))
    return rows.select(
        F.col("source").alias("document_id"), F.concat_ws("_", "source", "lang").alias("section_id"), F.concat(F.col("source"), F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"),
        "chunk_index", token_estimate(F.col("text")).alias("token_count"), "text", "lang", F.col("doc_id").alias("vec_id"),
    )


def sections(spark: SparkSession, sf: str) -> DataFrame:
    first = chunks(spark, sf).groupBy("document_id", "section_id", "lang").agg(F.min("chunk_index").alias("first_index"))
    order = (F.row_number().over(Window.partitionBy("document_id").orderBy("first_index")) - 1).cast("long")
    return first.withColumn("ord", order).select("document_id", F.col("section_id").alias("id"), F.col("lang").alias("title"), "ord", (1 + F.col("ord") % 4).alias("level"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    per = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    best = per.groupBy("source").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("lang").alias("lang"))).alias("b"))
    number = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    return best.select(F.col("source").alias("id"), F.col("b.lang").alias("language"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(number)).alias("created_at"))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items as questions on the chunk whose vec_id is the item id modulo the number of chunks."""
    total = table(spark, sf, "documents").agg(F.count("*").alias("n"))
    rows = table(spark, sf, "benchmark").crossJoin(F.broadcast(total)).withColumn("vec_id", F.col("item_id") % F.col("n"))
    made = F.lit("2024-02-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("item_id").cast("int"))
    difficulty = F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), (F.col("item_id") % 3 + 1).cast("int"))
    return rows.join(chunks(spark, sf).select("vec_id", "chunk_id"), "vec_id").select(F.col("item_id").alias("question_id"), "chunk_id", F.col("text").alias("question"), difficulty.alias("difficulty"), made.alias("created_at"))


def concepts(spark: SparkSession, sf: str) -> DataFrame:
    """The 30 tokens of five or more characters that most chunks have, and two that none has."""
    words = chunks(spark, sf).select(F.explode(F.array_distinct(tokens(F.col("text"), 5))).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    best = words.orderBy(F.desc("n"), "t").limit(30).select(F.col("t").alias("concept_id"))
    return best.unionByName(spark.createDataFrame([("orphan one",), ("orphan two",)], "concept_id string"))


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    words = chunks(spark, sf).select("chunk_id", F.explode(F.array_distinct(tokens(F.col("text"), 5))).alias("concept_id"))
    return words.join(F.broadcast(concepts(spark, sf)), "concept_id", "left_semi").select("chunk_id", "concept_id")


def related(spark: SparkSession, sf: str) -> DataFrame:
    """Each concept with the next one in order, every second time."""
    rank = F.row_number().over(Window.orderBy("concept_id"))
    rows = concepts(spark, sf).select("concept_id", F.lead("concept_id").over(Window.orderBy("concept_id")).alias("related_id"), rank.alias("rk"))  # 32 rows
    return rows.where("rk % 2 = 1 and related_id is not null").select("concept_id", "related_id")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.concat(F.lit("d"), F.col("label").cast("string")).alias("document_id"), "vec_id", "embedding", "label")


def chunk_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that have a vector."""
    return chunks(spark, sf).join(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id")


def query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The queries of every search: all rows whose id is divisible by 50."""
    return table(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")


EST = r"floor((len(list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')) * 1.3::double + length({0}) / 4.0::double) / 2)::bigint"
TOK = r"list_filter(regexp_extract_all(regexp_replace(lower({0}), '&#x26;|&#x3c;|&#x3e;', ' ', 'g'), '[\p{{L}}\p{{N}}\p{{M}}_]+'), lambda t: length(t) >= {1})"
SQL = {
    "chunks": f"""chunks as (select source document_id, source || '_' || lang section_id, source || '_chunk_' || chunk_index chunk_id, chunk_index, {EST.format('text')} token_count, text, lang, doc_id vec_id
  from (select *, row_number() over (partition by source order by doc_id) - 1 chunk_index from documents))""",
    "sections": """sections as (select document_id, section_id id, lang title, row_number() over (partition by document_id order by first_index) - 1 ord, 1 + (row_number() over (partition by document_id order by first_index) - 1) % 4 as level
  from (select document_id, section_id, lang, min(chunk_index) first_index from chunks group by all))""",
    "docs": """docs as (select source id, lang as language, timestamp '2024-01-01' + to_days(regexp_extract(source, '([0-9]+)', 1)::int) created_at from (select source, lang, count(*) n from documents group by all)
  qualify row_number() over (partition by source order by n desc, lang) = 1)""",
    "questions": """questions as (select item_id question_id, chunk_id, b.text question, ['easy', 'medium', 'hard'][(item_id % 3 + 1)::int] difficulty, timestamp '2024-02-01' + to_hours(item_id::int) created_at
  from benchmark b join chunks c on c.vec_id = b.item_id % (select count(*) from documents))""",
    "mentioned": f"mentioned as (select chunk_id, unnest(list_distinct({TOK.format('text', 5)})) concept_id from chunks)",
    "concepts": """concepts as (select concept_id from (select concept_id, count(*) n from mentioned group by all order by n desc, concept_id limit 30) union all select * from (values ('orphan one'), ('orphan two')))""",
    "mentions": "mentions as (select m.* from mentioned m semi join concepts using (concept_id))",
    "related": "related as (select concept_id, related_id from (select concept_id, lead(concept_id) over (order by concept_id) related_id, row_number() over (order by concept_id) rk from concepts) where rk % 2 = 1 and related_id is not null)",
    "vectors": "vectors as (select vec_id::varchar chunk_id, 'd' || label document_id, vec_id, embedding, label from embeddings)",
    "chunk_vectors": "chunk_vectors as (select c.*, embedding from chunks c join embeddings using (vec_id))",
    "parents": """parents as (select s.*, case when p.level > 0 then p.id end parent_id from sections s left join sections p on p.document_id = s.document_id and p.ord < s.ord and p.level < s.level
  qualify row_number() over (partition by s.id order by p.ord desc nulls last) = 1)""",
}
_NEEDS = {"sections": ["chunks"], "questions": ["chunks"], "mentioned": ["chunks"], "concepts": ["mentioned"], "mentions": ["concepts"], "related": ["concepts"], "chunk_vectors": ["chunks"], "parents": ["sections"]}


def with_views(*names: str, body: str) -> str:
    """SQL with the named views, and those they need, in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "with " + ",\n".join(SQL[n] for n in order) + "\n" + body
