"""Queries on plans, points, passages, stand-in answers, prompts, JSON, caches and events."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from lexmill.functions.text import clean_choice, drop_trailing_commas, fenced_json
from lexmill.operators import cache as E
from lexmill.operators import generation as N
from lexmill.operators import planning as P
from lexmill.operators import quiz as Q
from lexmill.operators import selection as L
from lexmill.operators.ledger import Ledger
from lexmill.storage import delete, shared_dir, staged
from lexmill.streaming import tumbling_counts
from lexmill.streaming.recency import cached

from . import fixtures as X

c = F.col
W = X.with_views


def _counts(s, sf):
    """A plan for each customer: orders by priority as difficulties and types; some are no valid plan."""
    o = X.table(s, sf, "orders")
    per = o.groupBy(c("o_custkey").alias("plan_id")).agg(
        F.count_if(c("o_orderpriority").startswith("1")).alias("easy"), F.count_if(c("o_orderpriority").startswith("2") | c("o_orderpriority").startswith("3")).alias("medium"),
        F.count_if(c("o_orderpriority").startswith("4") | c("o_orderpriority").startswith("5")).alias("hard"), F.count("*").alias("total"),
    )
    single = F.floor(c("total") / 2) + F.when(c("plan_id") % 50 == 0, 1).otherwise(0)
    return per.select("plan_id", "easy", "medium", "hard", single.alias("single"), (c("total") - F.floor(c("total") / 2)).alias("multiple"))


def plan_interleave(s, sf):
    return P.interleave(_counts(s, sf), "plan_id", P.DIFFICULTIES)


def plan_build(s, sf):
    return P.build_plan(_counts(s, sf))


def plan_violations(s, sf):
    return P.violations(_counts(s, sf), "plan_id")


def plan_json(s, sf):
    kind = F.when(c("question_type") == 0, "single_choice").otherwise("multiple_choice")
    return P.build_plan(_counts(s, sf)).select("plan_id", "pos", F.to_json(F.struct(c("pos").alias("index"), "difficulty", kind.alias("type"))).alias("item"))


def points_equal(s, sf):
    return P.points(P.build_plan(_counts(s, sf)), F.lit(10.0)).select("plan_id", "pos", "point")


def points_weighted(s, sf):
    return P.points(P.build_plan(_counts(s, sf)), F.lit(10.0), weighted=True).select("plan_id", "pos", "point")


def passage_build(s, sf):
    return P.passage(X.chunks(s, sf), 5).select("document_id", F.md5("passage").alias("passage_md5"), F.length("passage").cast("long").alias("n"))


def question_source(s, sf):
    """Question i of a document belongs to its chunk i, the last one if there are fewer."""
    rows = X.chunks(s, sf)
    size = rows.groupBy("document_id").agg(F.count("*").alias("n"))
    wanted = size.select("document_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(59).cast("long"))).alias("question"), "n").withColumn("chunk_index", F.least("question", c("n") - 1))
    return wanted.join(rows.select("document_id", "chunk_index", "chunk_id"), ["document_id", "chunk_index"]).select("document_id", "question", "chunk_id")


def quiz_main(s, sf):
    """The main path for every text: chunks, sections, vectors, selection, plan, questions with points."""
    made = Q.make_quiz(X.table(s, sf, "documents"), {"easy": 3, "medium": 3, "hard": 2, "single": 4, "multiple": 4}, F.lit(10.0))
    return made.questions


def _wishes(s, sf):
    """A prompt for two of three texts: eight words of its own from the ninth on, or the first eight words of a benchmark item."""
    few = lambda text, start: F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), start, 8), " ")
    docs, items = X.table(s, sf, "documents"), X.table(s, sf, "benchmark")
    rows = docs.select("doc_id", few(c("text"), 9).alias("own")).crossJoin(F.broadcast(items.agg(F.count("*").alias("n")))).withColumn("item_id", c("doc_id") % c("n"))
    rows = rows.join(items.select("item_id", few(c("text"), 1).alias("other")), "item_id", "left")
    return rows.select("doc_id", F.when(c("doc_id") % 3 == 0, c("own")).when(c("doc_id") % 3 == 1, c("other")).alias("prompt"))


def quiz_prompted(s, sf):
    """The main path for every text with prompts: what each prompt is judged to be, and what is selected."""
    made = Q.make_quiz(X.table(s, sf, "documents"), {"easy": 3, "medium": 3, "hard": 2, "single": 4, "multiple": 4}, F.lit(10.0), prompts=_wishes(s, sf))
    asked = made.questions.groupBy("document_id").agg(F.count("*").alias("questions"))
    return L.selection_summary(made.selected).join(made.relevance.select("document_id", "strategy", "relevance", "confidence", "is_relevant"), "document_id", "left").join(asked, "document_id", "left")


# Answers as models give them, and option texts with their letters.
ANSWERS = [(1, "a", True), (2, " B ,c", True), (3, "b,d,x,b", False), (4, "", True), (5, "z", False), (6, "D,A", False)]
CHOICES = ["A) first", "b. second", "C", "d:x", "E) other", "A-", "Ab text", " A] spaced ", "plain"]
JSONS = [
    (1, '```json\n[{"question": "q1", "choices": ["a", "b"], "answer": "A"}]\n```'), (2, "```\n{\"a\": 1}\n```"), (3, '[{"question": "q", "choices": ["x"]}, {"question": "r", "choices": ["y"], "answer": "B"}]'), (4, 'text [{"a": 1,}, {"b": "x}"}, {"c": '), (5, "```json\n[1, 2,]"), (6, "no json"), (7, '{"k": [1, 2, ], }'),
]


SIGNS = [")", "]", ":", ".", "-", " ", "x"]


def _answers(s, sf):
    """Answers made of the keys and states of all orders; the fixed ones have ids below 0."""
    letter = lambda key, n: F.char(65 + c(key) % n)
    raw = F.concat(letter("o_orderkey", 7), F.lit(", "), F.lower(letter("o_custkey", 5)), F.lit(" ,"), "o_orderstatus", F.lit(","), letter("o_orderkey", 3))
    rows = X.table(s, sf, "orders").select(c("o_orderkey").alias("id"), raw.alias("raw"), (c("o_custkey") % 2 == 0).alias("single"))
    rows = rows.unionByName(s.createDataFrame(ANSWERS, "id long, raw string, single boolean").withColumn("id", -c("id")))
    return rows.select("id", P.answer_letters(F.split("raw", ","), c("single")).alias("letters"))


def answers_normalize(s, sf):
    opts = P.options(F.array(*[F.lit(x) for x in "wxyz"]), c("found"))
    return _answers(s, sf).withColumnRenamed("letters", "found").select("id", F.array_join("found", ",").alias("letters"), F.array_join(F.transform(opts, lambda o: F.concat(o["id"].cast("string"), o["optionText"], o["isCorrect"].cast("string"))), ";").alias("options"))


def choice_clean(s, sf):
    """Names of all parts behind letters and signs, and the fixed options."""
    sign = F.element_at(F.array(*map(F.lit, SIGNS)), (c("p_partkey") % len(SIGNS) + 1).cast("int"))
    parts = X.table(s, sf, "part").select(F.concat(F.lit(" "), F.substring(F.lit("ABcdE"), (c("p_partkey") % 5 + 1).cast("int"), F.lit(1)), sign, F.lit(" "), "p_name").alias("raw"))
    return parts.unionByName(s.createDataFrame([(x,) for x in CHOICES], "raw string")).select("raw", clean_choice(c("raw")).alias("clean"))


def pipeline_metrics(s, sf):
    rows = X.chunks(s, sf)
    return rows.agg(F.countDistinct("document_id").alias("documents"), F.countDistinct("section_id").alias("sections"), F.count("*").alias("chunks"), F.round(F.avg("token_count"), 6).alias("mean_tokens"), F.max("token_count").alias("most_tokens"))


def _docs(s, sf):
    return X.table(s, sf, "documents")


def _passages(s, sf):
    return _docs(s, sf).select("doc_id", c("text").alias("passage"), "lang")


def mock_mcq(s, sf):
    return _passages(s, sf).select("doc_id", N.stand_in_question(c("passage")).alias("question"), F.lit("A").alias("answer"), F.lit("medium").alias("difficulty"))


def llm_resume(s, sf):
    """Short-answer prompts of all texts, asked through a ledger in two runs: the second asks for what the first, of even ids, has not."""
    rows = _passages(s, sf).select("doc_id", N.short_prompt(c("passage"), c("lang")).alias("prompt"))
    ledger = Ledger(s, f"{shared_dir(s)}/ledger-{uuid.uuid4().hex}")
    ledger.ask(rows.where("doc_id % 2 = 0"), digests, "doc_id")
    out = staged(ledger.ask(rows, digests, "doc_id").join(rows.withColumn("prompt_key", F.sha2("prompt", 256)).join(ledger.entries.groupBy("prompt_key").agg(F.count("*").alias("asked")), "prompt_key").select("doc_id", "asked"), "doc_id"), "resumed")
    delete(s, ledger.path)
    return out


def digests(prompts):
    """A stand-in for a model: the md5 of each prompt."""
    return [hashlib.md5(p.encode()).hexdigest() for p in prompts]


def mock_batch(s, sf):
    return N.stand_in_batch(_passages(s, sf), "doc_id", "passage", 4)


def mock_short(s, sf):
    return _passages(s, sf).select("doc_id", N.stand_in_short(c("passage")).alias("question"))


def mock_tf(s, sf):
    return _passages(s, sf).select("doc_id", N.stand_in_statement(c("passage")).alias("statement"), F.lit(True).alias("answer"))


def mock_distractors(s, sf):
    words = F.slice(F.split("passage", " "), F.lit(1), (c("doc_id") % 6).cast("int"))
    return _passages(s, sf).select("doc_id", F.array_join(N.three_distractors(words), "|").alias("distractors"))


def _some_words():
    return F.filter(F.split("passage", " "), lambda w: w != "")


def _digest(s, sf, prompt):
    return _passages(s, sf).select("doc_id", F.md5(prompt).alias("prompt_md5"))


def prompt_mcq(s, sf):
    return _digest(s, sf, N.mcq_prompt(c("passage"), c("lang"), c("doc_id"), F.slice(_some_words(), F.lit(1), (c("doc_id") % 9).cast("int"))))


def prompt_batch(s, sf):
    return _digest(s, sf, N.batch_prompt(c("passage"), c("lang"), c("doc_id") % 5 + 1, F.lit("- Q1: easy")))


def prompt_distractor(s, sf):
    return _digest(s, sf, N.distractor_prompt(c("passage"), F.lit("right"), F.slice(_some_words(), 1, 8)))


def prompt_short(s, sf):
    return _digest(s, sf, N.short_prompt(c("passage"), c("lang")))


def prompt_tf(s, sf):
    return _digest(s, sf, N.true_false_prompt(c("passage"), F.lit("vi")))


def llm_token_budget(s, sf):
    """The numbers from 1 to 40, and the orders of each customer as questions."""
    per = X.table(s, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("id")).select("id")
    return s.range(1, 41).unionByName(per).select(c("id").alias("questions"), N.token_budget(c("id")).alias("budget"))


def _jsons(s):
    return s.createDataFrame(JSONS, "id long, t string").withColumn("id", -c("id"))


def _outputs(s, sf):
    """Model output made of all events, bare, with trailing commas, fenced, in an open fence or behind prose; the fixed ones have ids below 0."""
    turn, p = c("event_id") % 5, c("props")
    made = F.when(turn == 0, p).when(turn == 1, F.concat(F.lit("["), p, F.lit(", ]"))).when(turn == 2, F.concat(F.lit("```json\n["), p, F.lit(",\n]\n``` done")))
    made = made.when(turn == 3, F.concat(F.lit("Here: ```json\n["), p, F.lit(","))).otherwise(F.concat(F.lit("So ```\n"), p, F.lit("\n```")))
    return X.table(s, sf, "events").select(c("event_id").alias("id"), made.alias("t")).unionByName(_jsons(s))


def _objects(s, sf, *, answers: bool):
    """(id, o): the first two questions of each document as JSON objects; a third of the answers is missing if asked for."""
    def one(i: int):
        answer = F.when((c("doc_id") + i) % 3 > 0, F.lit("A")) if answers else F.lit(i)
        return F.to_json(F.struct(F.concat(F.lit(f"{i} "), "text").alias("question"), F.array(F.lit("x"), c("lang")).alias("choices"), answer.alias("answer")))

    return _docs(s, sf).select(c("doc_id").alias("id"), one(0).alias("a"), one(1).alias("b"))


def _damaged(s, sf):
    """Two questions of each document, whole, cut in a third one, with trailing commas, or behind prose in an open fence and cut; the fixed ones have ids below 0."""
    turn = c("id") % 4
    comma = lambda o: F.concat(F.expr(f"substring({o}, 1, length({o}) - 1)"), F.lit(", }"))
    cut = F.concat(c("a"), F.lit(", "), c("b"), F.lit(", "), F.expr("substring(a, 1, cast(length(a) div 2 as int))"))
    made = F.when(turn == 0, F.concat(F.lit("["), "a", F.lit(","), "b", F.lit("]"))).when(turn == 1, F.concat(F.lit("["), cut))
    made = made.when(turn == 2, F.concat(F.lit("["), comma("a"), F.lit(", "), comma("b"), F.lit(" , ]"))).otherwise(F.concat(F.lit("Questions:\n```json\n["), cut))
    return _objects(s, sf, answers=False).select("id", made.alias("t")).unionByName(_jsons(s))


def json_fence(s, sf):
    return _outputs(s, sf).select("id", fenced_json(c("t")).alias("body"))


def json_fix_commas(s, sf):
    return _outputs(s, sf).select("id", drop_trailing_commas(c("t")).alias("fixed"))


def json_parse(s, sf):
    return X.table(s, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


def json_repair(s, sf):
    return N.repaired(_damaged(s, sf).withColumn("t", fenced_json(c("t"))), "id", "t").select("id", F.md5("repaired").alias("repaired_md5"))


def json_validate(s, sf):
    made = _objects(s, sf, answers=True).select("id", F.concat(F.lit("```json\n["), "a", F.lit(","), "b", F.lit("]\n```")).alias("t"))
    rows = made.unionByName(_jsons(s).where("id in (-1, -3)"))
    return rows.select("id", F.md5(F.array_join(F.transform(N.valid_questions(F.from_json(fenced_json(c("t")), N.QUESTION)), lambda q: q["question"]), ",")).alias("kept_md5"))


def _cache(s, sf):
    """All documents are wanted; the texts of those that have a vector are cached."""
    rows = X.table(s, sf, "documents").select("doc_id", "text", E.cache_key(F.lit("model"), c("text")).alias("key"))
    return rows, rows.join(X.table(s, sf, "embeddings").select(c("vec_id").alias("doc_id")), "doc_id", "left_semi")


def cache_key(s, sf):
    return X.table(s, sf, "documents").select("doc_id", E.cache_key(F.lit("model"), c("text")).alias("key"))


def cache_split(s, sf):
    wanted, cached = _cache(s, sf)
    hit, miss = E.split_hits(wanted, cached)
    return hit.select("doc_id", F.lit("hit").alias("state")).unionByName(miss.select("doc_id", F.lit("miss").alias("state")))


def cache_encode(s, sf):
    """The 'embedding' of this test is the text's length: what matters is that each distinct text is encoded once."""
    wanted, cached = _cache(s, sf)
    known = cached.dropDuplicates(["key"]).select("key", F.array(F.length("text").cast("double")).alias("embedding"))
    done = E.encode_missing(wanted, known, lambda rows: rows.select("key", F.array(F.length("text").cast("double")).alias("embedding")))
    return done.select("doc_id", c("embedding")[0].alias("value"))


def cache_stats(s, sf):
    return E.hit_statistics(*_cache(s, sf))


def cache_ttl(s, sf):
    puts = X.table(s, sf, "events").select(c("user_id").cast("string").alias("key"), c("ts").alias("at"))
    return E.live_entries(puts, F.lit("2024-01-30").cast("timestamp"), ttl=86400, capacity=50).select("key", c("at").cast("timestamp").alias("at"))


CACHE_ROOM, CACHE_TTL = 20, 6 * 3600


def cache_requests(s, sf):
    """All events as requests: errors and a third of the clicks write what the event holds, others read; keys are users."""
    rows = X.table(s, sf, "events")
    write = (c("event_type") == "error") | ((c("event_type") == "click") & (c("event_id") % 3 == 0))
    return rows.select(c("user_id").cast("string").alias("key"), c("ts").cast("timestamp").alias("at"), c("event_id").alias("seq"), F.when(write, c("props")).alias("value"))


def cache_recency(s, sf):
    """Hits, misses and entries driven out, of a cache with one order of use."""
    return cached(cache_requests(s, sf), CACHE_ROOM, CACHE_TTL, shards=1)


def ext_tumbling_counts(s, sf):
    return tumbling_counts(X.table(s, sf, "events"), "ts", "1 day", "event_type").select(c("start").cast("timestamp").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


_T = "total::decimal(12,4)"
COUNTS = """counts as (select plan_id, easy, medium, hard, total // 2 + case when plan_id % 50 = 0 then 1 else 0 end single, total - total // 2 multiple from (select o_custkey plan_id, count(*) filter (o_orderpriority[1] = '1') easy, count(*) filter (o_orderpriority[1] in ('2', '3')) medium,
  count(*) filter (o_orderpriority[1] in ('4', '5')) hard, count(*) total from orders group by 1)),
bad as (select plan_id, case when easy + medium + hard < 1 then 'no question' when easy + medium + hard > 30 then 'too many questions' when easy + medium + hard <> single + multiple then 'types do not add up' end problem from counts),
good as (select counts.* from counts join bad using (plan_id) where problem is null)"""


def _turns(name: str, source: str, kinds: list[str]) -> str:
    union = " union all ".join(f"select plan_id, {i} o, '{k}' kind, {k} n from {source}" for i, k in enumerate(kinds))
    return f"{name} as (select plan_id, row_number() over (partition by plan_id order by turn, n desc, o) pos, kind from (select *, unnest(range(1, n + 1)) turn from ({union}) where n > 0))"


PLAN = f"with {COUNTS}, {_turns('da', 'good', P.DIFFICULTIES)}, {_turns('tb', 'good', P.TYPES)}, plan as (select plan_id, pos, da.kind difficulty, case tb.kind when 'single' then 0 else 1 end::bigint question_type from da join tb using (plan_id, pos))"


def _points(share: str) -> str:
    return PLAN + f""", e as (select *, round_even((10.0000::decimal(12,4) * ({share}) / sum({share}) over (partition by plan_id))::decimal(20,8), 2) each, pos = max(pos) over (partition by plan_id) last from plan)
select plan_id, pos, case when last then 10::decimal(12,2)::double - coalesce(sum(each) filter (not last) over (partition by plan_id), 0)::double else each::double end point from e"""


_LANG = f"case lang when 'vi' then '{N.LANGUAGE['vi']}' else '{N.LANGUAGE['en']}' end"
_WORDS = "list_filter(string_split(text, ' '), lambda w: w <> '')"
_HINTS = "[" + ", ".join(f"'{h}'" for h in N.HINTS) + "]"
_J = "(select event_id id, case event_id % 5 when 0 then props when 1 then '[' || props || ', ]' when 2 then '```json' || chr(10) || '[' || props || ',' || chr(10) || ']' || chr(10) || '``` done' when 3 then 'Here: ```json' || chr(10) || '[' || props || ',' else 'So ```' || chr(10) || props || chr(10) || '```' end t from events union all select * from (values " + ", ".join("({}::bigint, {})".format(-i, " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in t.split("\n"))) for i, t in JSONS) + ") v(id, t))"
_FENCE = "trim(case when contains(t, '```json') then regexp_extract(t, '(?s)```json(.*?)(?:```|\\z)', 1) when contains(t, '```') then regexp_extract(t, '(?s)```(.*?)(?:```|\\z)', 1) else t end)"
_QUESTION = """'{{"question": ' || to_json('{0} ' || text)::varchar || ', "choices": ["x", ' || to_json(lang)::varchar || '], "answer": {0}}}'"""
# What is left of the fixed outputs.
REPAIRED = {-1: '[{"question": "q1", "choices": ["a", "b"], "answer": "A"}]', -2: '{"a": 1}', -3: '[{"question": "q", "choices": ["x"]}, {"question": "r", "choices": ["y"], "answer": "B"}]', -4: '[{"a": 1}, {"b": "x}"}]', -5: None, -6: None, -7: '{"k": [1, 2]}'}
_REPAIRED = ", ".join(f"({i}, {'null' if r is None else repr(r)})" for i, r in REPAIRED.items())
_A = "(select o_orderkey id, chr((65 + o_orderkey % 7)::int) || ', ' || chr((97 + o_custkey % 5)::int) || ' ,' || o_orderstatus || ',' || chr((65 + o_orderkey % 3)::int) raw, o_custkey % 2 = 0 single from orders union all select * from (values " + ", ".join(f"({-i}::bigint, '{r}', {str(b).lower()})" for i, r, b in ANSWERS) + ") v(id, raw, single))"
SQL = {
    "plan_interleave": f"with {COUNTS}, {_turns('t', 'counts', P.DIFFICULTIES)} select * from t",
    "plan_build": PLAN + " select * from plan",
    "plan_violations": f"with {COUNTS} select plan_id, problem from bad where problem is not null",
    "plan_json": PLAN + """ select plan_id, pos, '{"index":' || pos || ',"difficulty":"' || difficulty || '","type":"' || case question_type when 0 then 'single_choice' else 'multiple_choice' end || '"}' item from plan""",
    "points_equal": _points("1"),
    "points_weighted": _points("case difficulty when 'easy' then 3 when 'medium' then 2 else 1 end"),
    "passage_build": W("chunks", body=", p as (select document_id, string_agg('[Section ' || (chunk_index + 1) || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by chunk_index) passage from chunks where chunk_index < 5 group by 1) select document_id, md5(passage) passage_md5, length(passage) n from p").replace("\n, p", ", p"),
    "question_source": W("chunks", body="select n.document_id, question, chunk_id from (select document_id, count(*) n, unnest(range(0, 60)) question from chunks group by 1) n join chunks c on c.document_id = n.document_id and c.chunk_index = least(question, n.n - 1)"),
    "answers_normalize": f"""with l as (select id, single, list_filter(list_transform(string_split(raw, ','), lambda a: upper(trim(a))), lambda a: a in ('A', 'B', 'C', 'D')) l from {_A}), f as (select id, single, case when len(l) > 0 then l else ['A'] end l from l),
  d as (select id, case when single then l[1:1] else list_filter(l, lambda x, i: list_position(l, x) = i) end l from f)
  select id, array_to_string(l, ',') letters, array_to_string(list_transform(['w', 'x', 'y', 'z'], lambda o, i: i || o || list_contains(l, ['A', 'B', 'C', 'D'][i])), ';') options from d""",
    "choice_clean": "select raw, case when length(trim(raw)) > 2 and regexp_matches(trim(raw), '^[A-Da-d][)\\]:.\\-]') then trim(trim(raw)[3:]) else trim(raw) end clean from (select ' ' || 'ABcdE'[(p_partkey % 5 + 1)::int] || [" + ", ".join(f"'{x}'" for x in SIGNS) + f"][(p_partkey % {len(SIGNS)} + 1)::int] || ' ' || p_name raw from part union all select * from (values " + ", ".join(f"('{x}')" for x in CHOICES) + ") v(raw))",
    "pipeline_metrics": W("chunks", body="select count(distinct document_id) documents, count(distinct section_id) sections, count(*) chunks, round(avg(token_count), 6) mean_tokens, max(token_count) most_tokens from chunks"),
    "mock_mcq": "select doc_id, 'What is the main concept in this passage? (mock-' || md5(text)[1:8] || ')' question, 'A' answer, 'medium' difficulty from documents",
    "mock_batch": "select doc_id, i, 'Question ' || (i + 1) || ': What concept is discussed? (mock-' || md5(text || '_' || i)[1:8] || ')' question, case when i % 2 = 0 then 'A' else 'A,B' end answers, 'medium' difficulty from (select doc_id, text, unnest(range(0, 4)) i from documents)",
    "mock_short": "select doc_id, 'Explain the main concept discussed in the passage. (mock-' || md5(text)[1:8] || ')' question from documents",
    "mock_tf": "select doc_id, 'The passage discusses a specific concept. (mock-' || md5(text)[1:8] || ')' statement, true answer from documents",
    "mock_distractors": "select doc_id, array_to_string((string_split(text, ' ')[1 : doc_id % 6] || ['Mock distractor 1', 'Mock distractor 2', 'Mock distractor 3'])[1:3], '|') distractors from documents",
    "prompt_mcq": f"""with p as (select doc_id, text, lang, {_WORDS}[1 : doc_id % 9] e from documents) select doc_id, md5('Question ' || (doc_id + 1) || '. ' || {_HINTS}[doc_id % 7 + 1] || ' ' || {_LANG} ||
  case when len(e) > 0 then chr(10) || 'Avoid:' || chr(10) || array_to_string(list_transform(e[greatest(len(e) - 4, 1):], lambda q: '- ' || q), chr(10)) else '' end || chr(10) || 'Passage:' || chr(10) || text) prompt_md5 from p""",
    "prompt_batch": f"select doc_id, md5('Write ' || (doc_id % 5 + 1) || ' questions as a JSON array. ' || {_LANG} || chr(10) || 'Plan:' || chr(10) || '- Q1: easy' || chr(10) || 'Passage:' || chr(10) || text) prompt_md5 from documents",
    "prompt_distractor": f"""select doc_id, md5('Correct: right' || chr(10) || 'Candidates: [' || array_to_string(list_transform({_WORDS}[1:6], lambda w: '"' || w || '"'), ',') || ']' || chr(10) || 'Passage:' || chr(10) || text) prompt_md5 from documents""",
    "prompt_short": f"select doc_id, md5('Ask one short-answer question. ' || {_LANG} || chr(10) || 'Passage:' || chr(10) || text) prompt_md5 from documents",
    "llm_resume": f"select doc_id, md5('Ask one short-answer question. ' || {_LANG} || chr(10) || 'Passage:' || chr(10) || text) as output, 1::bigint asked from documents",
    "prompt_tf": f"select doc_id, md5('Write one true or false statement. {N.LANGUAGE['vi']}' || chr(10) || 'Passage:' || chr(10) || text) prompt_md5 from documents",
    "llm_token_budget": "select questions, greatest(8192, least(600 * questions + 500, 16384))::bigint budget from (select unnest(range(1, 41)) questions union all select count(*) from orders group by o_custkey)",
    "json_fence": f"select id, {_FENCE} body from {_J}",
    "json_fix_commas": f"select id, regexp_replace(t, ',(\\s*[}}\\]])', '\\1', 'g') fixed from {_J}",
    "json_parse": "select event_id, json_extract(props, '$.k')::bigint k from events",
    "quiz_main": None, "quiz_prompted": None,
    "json_repair": f"""with o as (select doc_id id, {_QUESTION.format(0)} a, {_QUESTION.format(1)} b from documents), fixed as (select * from (values {_REPAIRED}) v(id, r))
  select id, md5('[' || a || ', ' || b || ']') repaired_md5 from o union all select id::bigint, md5(r) from fixed""",
    "json_validate": """select doc_id id, md5(array_to_string(list_filter([case when doc_id % 3 > 0 then '0 ' || text end, case when (doc_id + 1) % 3 > 0 then '1 ' || text end], lambda x: x is not null), ',')) kept_md5 from documents
  union all select -1, md5('q1') union all select -3, md5('r')""",
    "cache_key": "select doc_id, md5('model:' || text) as key from documents",
    "cache_split": "select doc_id, case when text in (select text from documents where doc_id in (select vec_id from embeddings)) then 'hit' else 'miss' end state from documents",
    "cache_encode": "select doc_id, length(text)::double as value from documents",
    "cache_stats": "select hits, misses, printf('%.2f%%', 100.0::double * hits / (hits + misses)) hit_rate from (select count(*) filter (hit) hits, count(*) filter (not hit) misses from (select text in (select text from documents where doc_id in (select vec_id from embeddings)) hit from documents))",
    "cache_recency": None,
    "cache_ttl": "select key, last_put as \"at\" from (select user_id::varchar as key, max(ts) last_put from events group by 1) where last_put >= timestamp '2024-01-30' - interval 1 day order by last_put desc, key limit 50",
    "ext_tumbling_counts": "select date_trunc('day', ts) as start, event_type, count(*) n, round(sum(value), 2) total from events group by all",
}
QUERIES = {name: (globals()[name], sql) for name, sql in SQL.items()}
