import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import queries
from lexmill.llm.pu_quality import crc_fold, estimate_prior, fit_nnpu, fit_quality, quality_scores, text_features
from lexmill.llm.toxicity import CATEGORIES, drop_toxic, fit_chain, fit_logistic, kinds_of, probability, toxicity_scores

SF = "/root/testdata/sf0.01"


def auc(score, label):
    order = np.argsort(np.argsort(score)) + 1
    n = label.sum()
    return (order[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


@pytest.mark.parametrize(("sf", "specificity"), [("/root/testdata/sf0.01", 0.3), ("/root/testdata/sf0.1", 0.9)])
def test_quality_held_out(spark, sf, specificity):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op6_quality(spark, sf).join(labels, "doc_id").toPandas()
    assert [crc_fold(i) == 0 for i in got.doc_id] == got.held_out.tolist()
    assert (got.predicted == (got.score >= 0.3)).all() and got.score.between(0, 1).all() and docs.count() >= len(got)
    held = got[got.held_out]
    assert auc(held.score.values, held.quality.values) > 0.95
    assert (held[held.quality == 1].predicted == 1).mean() > 0.98 and (held[held.quality == 0].predicted == 0).mean() > specificity


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_prior_from_positives_and_unlabelled(share):
    rng = np.random.default_rng(4)
    draw = lambda n, at: np.column_stack([rng.normal(at, 1, (n, 3)), np.ones(n)]).astype(np.float32)
    got = estimate_prior(draw(3000, 1.5), np.vstack([draw(int(4000 * share), 1.5), draw(int(4000 * (1 - share)), -1.5)]))
    assert abs(got - share) < 0.05


def test_held_out_labels_do_not_matter(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality_scores(docs, x).select("doc_id", "score").collect())) for x in (labels, other))
    assert a == b


def test_nnpu_finds_the_negatives():
    rng = np.random.default_rng(1)
    pos, neg = rng.normal(1, 1, (2000, 2)), rng.normal(-2, 1, (400, 2))
    add = lambda x: np.column_stack([x, np.ones(len(x))])
    w = fit_nnpu(add(pos[:1000]), add(np.vstack([pos[1000:], neg])), 1000 / 1400)
    score = lambda x: add(x) @ w
    assert (score(pos) > 0).mean() > 0.9 and (score(neg) < 0).mean() > 0.9


def test_chain_feeds_earlier_categories():
    x = np.random.default_rng(2).integers(0, 2, (500, 4)).astype(float)
    w = fit_logistic(x, x[:, 1])
    assert ((probability(x, w) > 0.5) == (x[:, 1] > 0)).all()


def test_kinds_are_clusters_of_toxic_rows():
    x = np.array([[1, 1, 0, 0], [1, 1, 1, 0], [0, 0, 1, 1], [0, 0, 0, 1], [0, 0, 0, 0], [1, 1, 0, 0]], np.float32)
    got = kinds_of(x, np.array([1, 1, 1, 1, 1, 0]))
    assert got.sum(axis=1).tolist() == [1, 1, 1, 1, 1, 0]
    assert got[0].tolist() == got[1].tolist() and got[2].tolist() == got[3].tolist() != got[0].tolist()


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train = labels.where("doc_id % 4 <> 0")
    chain = fit_chain(docs, train)
    assert [len(w) for w in chain.weights] == [len(chain.features) + k + 1 for k in range(len(CATEGORIES))]
    got = toxicity_scores(docs, train).join(labels.where("doc_id % 4 = 0").withColumnRenamed("toxic", "label"), "doc_id").toPandas()
    assert got[got.label == 1].toxic.mean() > 0.85 and got[got.label == 0].toxic.mean() < 0.01


@pytest.mark.parametrize("run", [quality_scores, toxicity_scores])
def test_edge_rows(spark, run):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["good", "idiot", "text", "é", "|||"]) for _ in range(rng.randrange(20))), "x") for i in range(60)] + [(60, None, None), (61, "", "y"), (None, "null id", None), (3, "again", "z"), (62, "w " * 50000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, i % 2, (i % 3) // 2) for i in range(62)] + [(None, 1, 1), (5, None, None), (7, 0, 0)], "doc_id long, quality int, toxic int")
    got = run(docs, labels)
    assert got.count() == len(rows) and not any(got.where(f"{c} is null").count() for c in got.columns[1:])
    assert run(docs, labels.limit(0)).count() == len(rows)
    assert run(docs.limit(0), labels).count() == 0
    assert run(docs, labels.withColumn("quality", F.lit(1)).withColumn("toxic", F.lit(1))).count() == len(rows)
    assert os.path.exists(SF) and len(text_features(b"")) == len(text_features(b"a b"))


def test_drop_toxic_keeps_columns(spark):
    docs = spark.createDataFrame([(i, "you idiot moron" if i % 3 == 0 else f"some text {i}", i) for i in range(90)], "doc_id long, text string, toxic long")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in range(90) if i % 3}


@pytest.mark.parametrize("run", [quality_scores, toxicity_scores])
def test_samples_are_bounded_by_rows(spark, monkeypatch, run):
    docs = spark.range(60_000).select(F.when(F.col("id") < 500, F.col("id")).otherwise(7).alias("doc_id"), F.concat(F.lit("some words and idiot "), F.col("id") % 97).alias("text"))
    labels = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), (F.col("id") % 2).cast("int").alias("toxic"))
    sizes, kind = [], type(docs)
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: sizes.append(len(out := collect(self))) or out)
    assert run(docs, labels, fit_rows=100).count() == 60_000
    assert sizes and max(sizes) < 500


def test_scores_from_the_fitted_weights(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    chain = fit_chain(docs, labels)
    want = {}
    for i, text in texts:
        held = {f for w in re.findall(r"\w+", text.lower()) for f in ["=" + w, *("^" + w[:k] for k in (4, 5, 6, 7) if len(w) >= k)]}
        seen = [1.0 if f in held else 0.0 for f in sorted(chain.features, key=chain.features.get)]
        for w in chain.weights:
            z = sum(a * b for a, b in zip(seen, w[:-1], strict=True)) + w[-1]
            seen.append(1 / (1 + math.exp(-z)))
        want[i] = seen[-len(CATEGORIES):]
    got = {r.doc_id: r[1 : 1 + len(CATEGORIES)] for r in toxicity_scores(docs, labels).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], atol=1e-4) for i in want)
    model, want = fit_quality(docs, labels), {}
    for i, text in texts:
        z, at = model.weights[-1], 0
        for value, edges in zip(text_features(text.encode()), model.edges, strict=True):
            z += model.weights[at + sum(e <= value for e in edges)]
            at += len(edges) + 1
        want[i] = 1 / (1 + math.exp(-z))
    got = {r.doc_id: r.score for r in quality_scores(docs, labels).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-4 for i in want)
