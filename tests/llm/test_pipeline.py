import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from test_decontaminate import normalise
from test_simhash import brute_components, brute_fingerprint
from test_suffix_dedup import brute as brute_spans

TOK = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def fixture(spark, folder):
    rng = random.Random(11)
    prose = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    passage, items = prose(70) + " é漢字", [(i, prose(25)) for i in range(3)]
    docs, labels = [], []
    for i in range(120):
        text, toxic = prose(rng.randrange(20, 120)), i % 5 == 0
        if toxic:
            text += " you idiot moron loser " + prose(3)
        if i % 7 == 1:
            text = f"{prose(10)} {passage}\n{prose(9)}"
        if i % 11 == 2:
            text += " " + rng.choice(items)[1].upper()
        docs.append((i, text, "en", "s", len(text)))
        if i % 3:
            labels.append((i, 1, int(toxic and i % 7 != 1)))
    docs += [(200 + k, docs[k][1], "en", "s", docs[k][4]) for k in (3, 4, 6)] + [(300, "", "en", None, 0), (301, None, None, None, None)]
    folder = str(folder)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


def test_stages_against_brute_force(spark, tmp_path):
    docs, items = fixture(spark, tmp_path / "in")
    folder = str(tmp_path / "in")
    frame, columns = spark.read.parquet(f"{folder}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, folder).write.parquet(f"{tmp_path}/{k}")
        frame = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r.doc_id: r for r in frame.collect()})
        if k < len(corpus_pipeline.STAGES) - 1:
            assert frame.columns == columns, name
    clean = {d[0] for d in docs if "idiot" not in (d[1] or "")}
    assert set(kept[0]) == clean
    ids = sorted(clean)
    prints = [brute_fingerprint(kept[0][i].text) for i in ids]
    assert set(kept[1]) == set(brute_components(ids, prints)) and 301 not in kept[1] and 300 in kept[1]
    ids = sorted(kept[1])
    want = brute_spans([(kept[1][i].text or "").encode() for i in ids], 200)
    assert any(s for s, _ in want)
    for i, (spans, left) in zip(ids, want, strict=True):
        assert kept[2][i].text == (left.decode("utf-8", "replace") if spans else kept[1][i].text)
        assert kept[2][i].n_chars == len(kept[2][i].text or "")
    assert set(kept[2]) == set(ids)
    assert set(kept[3]) == {i for i in ids if not any(normalise(t) in normalise(kept[2][i].text or "") for _, t in items)}
    for i, r in kept[4].items():
        assert r.ids == TOK.encode(kept[3][i].text or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert r.decoded == TOK.decode(r.ids, skip_special_tokens=False)
    assert set(kept[4]) == set(kept[3])
    digest = lambda rows: sorted(hashlib.sha256(str((r.doc_id, r.ids)).encode()).hexdigest() for r in rows)
    assert digest(corpus_pipeline.run(spark, folder).collect()) == digest(kept[4].values())


def test_stages_on_empty_tables_and_clashing_columns(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, hits string, label int, __text string, component_id long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    some = [(1, "a b c", None, None, None, "k", "h", 1, "t", 9), (2, None, None, None, None, None, None, None, None, None), (3, "a b c", "en", "s", 5, "k", "h", 1, "t", 9), (None, "null id", None, None, None, None, None, None, None, None)]
    for rows in ([], some):
        frame = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, folder)
            assert out.columns == frame.columns, name
            left = [r.doc_id for r in out.collect()]
            want = [r[0] for r in rows if not (name == "near_duplicates" and r[0] == 3)]
            assert sorted(map(str, left)) == sorted(map(str, want)), name
        assert corpus_pipeline.STAGES[-1][1](spark, frame, folder).count() == len(rows)


def test_verdicts_stay_on_their_rows(spark, tmp_path):
    folder, rng = str(tmp_path / "in"), random.Random(5)
    prose = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    item = prose(25)
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = [(i, "you idiot moron " + prose(9) if i % 3 == 0 else prose(12)) for i in range(90)]
    bad, leak, clean = "you idiot moron " + prose(8), prose(10) + " " + item, [prose(40) for _ in range(4)]
    rows += [(None, bad), (None, clean[0]), (1, bad), (None, leak), (None, clean[1]), (2, leak), (2, clean[2])]
    rows += [(None, clean[3])] * 3 + [(500, clean[2])] * 2
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    texts = lambda df: sorted((str(r.doc_id), r.text) for r in df.collect())
    want = sorted((str(i), t) for i, t in rows if "idiot" not in t)
    left = corpus_pipeline.toxicity(spark, frame, folder)
    assert texts(left) == want
    left = corpus_pipeline.near_duplicates(spark, left, folder)
    want = sorted(set(want) - {("500", clean[2]), ("None", leak)})  # copies of rows with id 2
    assert texts(left) == want
    assert texts(corpus_pipeline.decontamination(spark, left, folder)) == [x for x in want if item not in x[1]]
