"""Queries on the document graph."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions.text import preview
from lexmill.operators import graph as G
from lexmill.operators.keyed_store import KeyedTable
from lexmill.storage import shared_dir, staged

from . import fixtures as X

W = X.with_views
DOC = "src1"


def _chunks(s, sf):
    return X.chunks(s, sf).withColumn("section_path", F.array("document_id", "lang"))


def graph_sections(s, sf):
    return G.sections_of(_chunks(s, sf))


def graph_section_number(s, sf):
    heads = X.table(s, sf, "documents").select("doc_id", F.concat((F.col("doc_id") % 7).cast("string"), F.lit("."), (F.col("doc_id") % 3).cast("string"), F.lit(" "), F.substring("text", 1, 10)).alias("h"))
    plain = X.table(s, sf, "documents").select("doc_id", F.substring("text", 1, 10).alias("h"))
    return heads.withColumn("kind", F.lit("numbered")).unionByName(plain.withColumn("kind", F.lit("plain"))).select("doc_id", "kind", G.section_number(F.col("h")).alias("number"))


def graph_chunks(s, sf):
    return G.chunk_nodes(X.chunks(s, sf))


def graph_hierarchy(s, sf):
    return G.with_parents(X.sections(s, sf)).select("document_id", "id", "ord", "level", "parent_id")


def graph_tree_paths(s, sf):
    return G.tree_paths(G.with_parents(X.sections(s, sf)))


def graph_asof_section(s, sf):
    return G.nearest_sections(X.chunks(s, sf), X.sections(s, sf))


def graph_next_chain(s, sf):
    return G.next_chain(X.chunks(s, sf))


def graph_section_stats(s, sf):
    known = X.sections(s, sf).where("ord <> 1")
    extra = s.createDataFrame([("nowhere", "Empty", 2)], "id string, title string, level long")
    return G.section_statistics(known.select("id", "title", "level").unionByName(extra), X.chunks(s, sf))


def graph_upsert(s, sf):
    base = X.sections(s, sf).select("id", "title", F.lit(0).cast("long").alias("seq"))
    changes = X.sections(s, sf).where("ord % 2 = 0").select("id", F.upper("title").alias("title"), F.lit(1).cast("long").alias("seq")).unionByName(s.createDataFrame([("new", "added", 1)], "id string, title string, seq long"))
    return G.upsert(base, changes, "id", "seq")


def _stored(s, rows, key):
    return KeyedTable.create(s, f"{shared_dir(s)}/keyed-{uuid.uuid4().hex}", rows, key)


def _taken(table):
    """Rows of a table that is dropped."""
    out = staged(table.rows, "keyed-result")
    table.drop()
    return out


def graph_store_upsert(s, sf):
    """Texts stored by id; those of even ids are written again in capitals, some with an earlier number that loses."""
    docs = X.table(s, sf, "documents")
    changes = docs.where("doc_id % 2 = 0").select("doc_id", F.upper(F.md5("text")).alias("mark"), F.when(F.col("doc_id") % 10 == 0, 0).otherwise(2).cast("long").alias("seq"))
    added = changes.select((-1 - F.col("doc_id")).alias("doc_id"), "mark", "seq")
    return _taken(_stored(s, docs.select("doc_id", F.md5("text").alias("mark"), F.lit(1).cast("long").alias("seq")), "doc_id").upsert(changes.unionByName(changes).unionByName(added.unionByName(changes.withColumn("seq", F.lit(-1).cast("long")))), "seq"))


def graph_store_delete(s, sf):
    """What is left of stored chunks and questions without the chunks whose vec_id is divisible by 50."""
    chunks, questions = X.chunks(s, sf).select("chunk_id", "vec_id"), X.questions(s, sf).select("question_id", "chunk_id")
    gone = chunks.where("vec_id % 50 = 0").select("chunk_id")
    left = _taken(_stored(s, chunks, "chunk_id").delete(gone)).select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"))
    asked = _taken(_stored(s, questions, "question_id").delete(questions.join(gone, "chunk_id", "left_semi")))
    return left.unionByName(asked.select(F.lit("question").alias("kind"), F.col("question_id").cast("string").alias("id")))


def graph_store_merge(s, sf):
    """Different texts stored with the id that brought them: first those of even ids, then the others, which change nothing that is there."""
    docs = X.table(s, sf, "documents").select(F.md5("text").alias("text_md5"), "doc_id")
    first = docs.where("doc_id % 2 = 0").groupBy("text_md5").agg(F.min("doc_id").alias("doc_id"))
    return _taken(_stored(s, first, "text_md5").insert(docs.where("doc_id % 2 = 1"), keep_first=True))


def graph_edges(s, sf):
    pairs = X.chunks(s, sf).select(F.col("section_id").alias("src"), F.col("chunk_id").alias("dst"))
    pairs = pairs.unionByName(pairs).unionByName(s.createDataFrame([("nowhere", "x")], "src string, dst string"))
    return G.edges(X.sections(s, sf), pairs, X.chunks(s, sf).select(F.col("chunk_id").alias("id")))


def graph_build_stats(s, sf):
    c = X.chunks(s, sf)
    return c.groupBy("document_id").agg(F.countDistinct("section_id").alias("sections_created"), F.count("*").alias("chunks_created"), (F.count("*") - 1).alias("relationships_created"))


def graph_cascade_delete(s, sf):
    left = G.without_document(DOC, X.documents(s, sf), X.sections(s, sf), X.chunks(s, sf), X.questions(s, sf))
    out = None
    for name, t in zip(("documents", "sections", "chunks", "questions"), left, strict=True):
        row = t.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def graph_orphans(s, sf):
    return G.orphans(X.concepts(s, sf), X.mentions(s, sf))


def graph_concept_merge(s, sf):
    rows = X.mentions(s, sf).join(X.chunks(s, sf).select("chunk_id", "vec_id"), "chunk_id").select("concept_id", F.col("chunk_id").alias("first_chunk"), F.col("vec_id").alias("seq"))
    return G.merge_first(rows, "concept_id", "seq")


def graph_unique_check(s, sf):
    return G.repeated_keys(X.table(s, sf, "documents"), "text").select(F.md5("text").alias("text_md5"), "n")


def graph_path_string(s, sf):
    return _chunks(s, sf).select("chunk_id", F.concat_ws(" > ", "section_path").alias("path_string"), F.concat_ws(" > ", F.slice("section_path", -1, 1)).alias("last_part"))


def q_doc_chunks(s, sf):
    rows = X.documents(s, sf).where(F.col("id") == DOC).join(X.sections(s, sf).withColumnRenamed("id", "section_id"), F.col("id") == F.col("document_id")).select("section_id", "level")
    return rows.join(X.chunks(s, sf), "section_id").select("chunk_id", "section_id", "level", "token_count").orderBy("level", F.length("chunk_id"), "chunk_id")


def q_doc_sections(s, sf):
    return X.sections(s, sf).where(F.col("document_id") == DOC).select("id", "title", "level", "ord").orderBy("level", "ord")


def q_section_chunks(s, sf):
    return X.chunks(s, sf).where(F.col("section_id") == f"{DOC}_en").select("chunk_id", "chunk_index", "token_count").orderBy("chunk_index").limit(7)


def _wanted(s, sf):
    return X.chunks(s, sf).select("chunk_id", "document_id", "section_id")


def q_neighbors_same(s, sf):
    return G.neighbours(X.chunks(s, sf), _wanted(s, sf))


def q_neighbors_other(s, sf):
    return G.neighbours(X.chunks(s, sf), _wanted(s, sf), same_section=False)


def q_context_window(s, sf):
    return G.context_window(X.chunks(s, sf), _wanted(s, sf))


def q_related_concepts(s, sf):
    m = X.mentions(s, sf).join(X.related(s, sf), "concept_id", "left")
    return m.groupBy("chunk_id", "concept_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("related_id"))).alias("related"))


def q_stats(s, sf):
    out = None
    for name, t in (("documents", X.documents), ("sections", X.sections), ("chunks", X.chunks), ("questions", X.questions), ("concepts", X.concepts)):
        row = t(s, sf).agg(F.count("*").alias("n")).select(F.lit(name).alias("label"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def q_doc_list(s, sf):
    rows = G.document_counts(X.documents(s, sf), X.sections(s, sf), X.chunks(s, sf), X.questions(s, sf))
    return G.page(rows.where("language = 'en'"), [F.desc("created_at"), F.col("document_id")], 5, 20)


def q_doc_total(s, sf):
    return X.documents(s, sf).where("language = 'en'").agg(F.count("*").alias("total"))


def q_doc_detail(s, sf):
    n = X.chunks(s, sf).groupBy(F.col("section_id").alias("id")).agg(F.count("*").alias("chunk_count"))
    return X.sections(s, sf).where(F.col("document_id") == DOC).join(n, "id", "left").select("id", "title", "level", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count")).orderBy("level", "id")


def q_doc_question_count(s, sf):
    return X.questions(s, sf).join(X.chunks(s, sf), "chunk_id").join(X.sections(s, sf).select(F.col("id").alias("section_id")), "section_id").groupBy("document_id").agg(F.count("*").alias("questions"))


def q_chunk_page(s, sf):
    rows = X.chunks(s, sf).where(F.col("document_id") == DOC).select("chunk_id", "chunk_index", F.coalesce("section_id", F.lit("Root")).alias("section"), preview(F.col("text")).alias("text_preview"), F.coalesce("token_count", F.lit(0)).alias("token_count"))
    return G.page(rows, ["chunk_index"], 5, 10)


def q_question_page(s, sf):
    rows = X.questions(s, sf).join(X.chunks(s, sf).select("chunk_id", "document_id"), "chunk_id").select("question_id", "chunk_id", "document_id", "difficulty", "created_at")
    return G.page(rows, [F.desc("created_at"), F.col("question_id")], 3, 12)


def q_delete_chunk(s, sf):
    gone = X.chunks(s, sf).where("chunk_index = 0").select("chunk_id")
    return X.questions(s, sf).join(gone, "chunk_id", "left_anti").select("question_id", "chunk_id")


SELECT_ONLY = "select document_id, count(*) as n, sum(token_count) as tokens_total from chunks group by document_id having count(*) > 1"


def q_sql_passthrough(s, sf):
    return G.read_only_sql(s, SELECT_ONLY, chunks=X.chunks(s, sf))


def graph_level_sizes(s, sf):
    w = Window.partitionBy("document_id")
    return X.sections(s, sf).withColumn("n_sections", F.count("*").over(w)).groupBy("level").agg(F.count("*").alias("n"), F.max("n_sections").alias("largest"))


_FEATURES = """'{"position":' || chunk_index || ',"token_count":' || token_count || ',"lang":"' || lang || '"}'"""
SQL = {
    "graph_sections": W("chunks", body="""select document_id, section_id, row_number() over (partition by document_id order by min(chunk_index)) - 1 ord, any_value(lang) header, 2::bigint as level, document_id || ' > ' || any_value(lang) path_string from chunks group by document_id, section_id"""),
    "graph_section_number": r"""select doc_id, kind, nullif(regexp_extract(h, '^([\d.]+)', 1), '') number from (select doc_id, 'numbered' kind, (doc_id % 7) || '.' || (doc_id % 3) || ' ' || text[1:10] h from documents union all select doc_id, 'plain', text[1:10] from documents)""",
    "graph_chunks": W("chunks", body=f"select document_id || '_chunk_' || chunk_index id, document_id, section_id, chunk_index ord, token_count token_length, {_FEATURES} features from chunks"),
    "graph_hierarchy": W("parents", body="select document_id, id, ord, level, parent_id from parents"),
    "graph_tree_paths": "with recursive " + W("parents", body="").removeprefix("with ").rstrip() + ", tree as (select document_id, id, title::varchar tree_path from parents where parent_id is null union all select p.document_id, p.id, t.tree_path || '/' || p.title from parents p join tree t on p.parent_id = t.id) select * from tree",
    "graph_asof_section": W("sections", body="select chunk_id, coalesce((select max_by(s.id, s.ord) from sections s where s.document_id = c.document_id and s.ord < c.chunk_index), 'default') nearest_section from chunks c"),
    "graph_next_chain": W("chunks", body="select a.chunk_id src, b.chunk_id dst from chunks a join chunks b on a.document_id = b.document_id and b.chunk_index = a.chunk_index + 1"),
    "graph_section_stats": W("sections", body="""select coalesce(k.id, n.section_id) id, coalesce(title, '') title, coalesce(level, 0)::bigint as level, coalesce(n, 0)::bigint chunk_count, coalesce(t, 0)::bigint total_tokens
  from (select id, title, level from sections where ord <> 1 union all select 'nowhere', 'Empty', 2) k full join (select section_id, count(*) n, sum(token_count) t from chunks group by 1) n on k.id = n.section_id"""),
    "graph_upsert": W("sections", body="select id, case when ord % 2 = 0 then upper(title) else title end title, (ord % 2 = 0)::bigint seq from sections union all select 'new', 'added', 1"),
    "graph_edges": W("sections", body="select distinct section_id src, chunk_id dst from chunks c where exists (select 1 from sections s where s.id = c.section_id)"),
    "graph_build_stats": W("chunks", body="select document_id, count(distinct section_id) sections_created, count(*) chunks_created, count(*) - 1 relationships_created from chunks group by 1"),
    "graph_cascade_delete": W("docs", "sections", "questions", body=f"""select 'documents' kind, count(*) n from docs where id <> '{DOC}' union all select 'sections', count(*) from sections where document_id <> '{DOC}' union all select 'chunks', count(*) from chunks where document_id <> '{DOC}'
  union all select 'questions', count(*) from questions join chunks using (chunk_id) where document_id <> '{DOC}'"""),
    "graph_orphans": W("mentions", body="select concept_id from concepts where concept_id not in (select concept_id from mentions)"),
    "graph_store_upsert": """select doc_id, case when doc_id % 2 = 0 and doc_id % 10 <> 0 then upper(md5(text)) else md5(text) end mark, case when doc_id % 2 = 0 and doc_id % 10 <> 0 then 2 else 1 end::bigint seq from documents
  union all select -1 - doc_id, upper(md5(text)), case when doc_id % 10 = 0 then 0 else 2 end from documents where doc_id % 2 = 0""",
    "graph_store_delete": W("questions", body="select 'chunk' kind, chunk_id id from chunks where vec_id % 50 <> 0 union all select 'question', question_id::varchar from questions q where chunk_id not in (select chunk_id from chunks where vec_id % 50 = 0)"),
    "graph_store_merge": "select md5(text) text_md5, coalesce(min(doc_id) filter (doc_id % 2 = 0), min(doc_id)) doc_id from documents group by 1",
    "graph_concept_merge": W("mentions", body="select concept_id, min_by(chunk_id, vec_id) first_chunk, min(vec_id) seq from mentions join chunks using (chunk_id) group by 1"),
    "graph_unique_check": "select md5(text) text_md5, count(*) n from documents group by text having count(*) > 1",
    "graph_path_string": W("chunks", body="select chunk_id, document_id || ' > ' || lang path_string, lang last_part from chunks"),
    "q_doc_chunks": W("sections", body=f"select chunk_id, section_id, level, token_count from chunks c join sections s on s.id = c.section_id where s.document_id = '{DOC}'"),
    "q_doc_sections": W("sections", body=f"select id, title, level, ord from sections where document_id = '{DOC}'"),
    "q_section_chunks": W("chunks", body=f"select chunk_id, chunk_index, token_count from chunks where section_id = '{DOC}_en' order by chunk_index limit 7"),
    "q_neighbors_same": W("chunks", body=f"select a.chunk_id as of, b.chunk_id, b.chunk_index from chunks a join chunks b on a.section_id = b.section_id and a.chunk_id <> b.chunk_id qualify row_number() over (partition by a.chunk_id order by b.chunk_index) <= 5"),
    "q_neighbors_other": W("chunks", body=f"select a.chunk_id as of, b.chunk_id, b.chunk_index from chunks a join chunks b on a.document_id = b.document_id and a.section_id <> b.section_id qualify row_number() over (partition by a.chunk_id order by b.chunk_index) <= 5"),
    "q_context_window": W("chunks", body=""", p as (select *, row_number() over (partition by section_id order by chunk_index) place from chunks)
  select a.chunk_id as of, b.chunk_id, b.place - a.place as "offset" from p a join p b on a.section_id = b.section_id and abs(a.place - b.place) <= 2"""),
    "q_related_concepts": W("mentions", "related", body="select chunk_id, m.concept_id, coalesce(string_agg(distinct related_id, ',' order by related_id), '') related from mentions m left join related r using (concept_id) group by all"),
    "q_stats": W("docs", "sections", "questions", "concepts", body="select 'documents' label, count(*) n from docs union all select 'sections', count(*) from sections union all select 'chunks', count(*) from chunks union all select 'questions', count(*) from questions union all select 'concepts', count(*) from concepts"),
    "q_doc_list": W("docs", "sections", "questions", body="""select d.id document_id, language, d.created_at, count(distinct s.id) sections, count(distinct c.chunk_id) chunks, count(distinct q.question_id) questions
  from docs d left join sections s on s.document_id = d.id left join chunks c on c.section_id = s.id left join questions q on q.chunk_id = c.chunk_id where language = 'en' group by all order by created_at desc, document_id limit 20 offset 5"""),
    "q_doc_total": W("docs", body="select count(*) total from docs where language = 'en'"),
    "q_doc_detail": W("sections", body=f"select s.id, s.title, s.level, count(c.chunk_id) chunk_count from sections s left join chunks c on c.section_id = s.id where s.document_id = '{DOC}' group by all"),
    "q_doc_question_count": W("questions", body="select document_id, count(*) questions from questions join chunks using (chunk_id) group by 1"),
    "q_chunk_page": W("chunks", body=f"select chunk_id, chunk_index, section_id section, case when length(text) > 500 then text[1:500] || '...' else text end text_preview, token_count from chunks where document_id = '{DOC}' order by chunk_index limit 10 offset 5"),
    "q_question_page": W("questions", body="select question_id, chunk_id, document_id, difficulty, q.created_at from questions q join chunks using (chunk_id) order by q.created_at desc, question_id limit 12 offset 3"),
    "q_delete_chunk": W("questions", body="select question_id, chunk_id from questions where chunk_id not in (select chunk_id from chunks where chunk_index = 0)"),
    "q_sql_passthrough": W("chunks", body="select document_id, count(*) n, sum(token_count)::bigint tokens_total from chunks group by document_id having count(*) > 1"),
    "graph_level_sizes": W("sections", body="select level, count(*) n, max(k) largest from (select *, count(*) over (partition by document_id) k from sections) group by 1"),
}
SQL["q_context_window"] = SQL["q_context_window"].replace("\n, p as", ", p as")
QUERIES = {name: (globals()[name], sql) for name, sql in SQL.items()}
