import zlib

import numpy as np
from cases import empty, odd

from tidemark.llm.boosting import fit_calibrated, isotonic
from tidemark.llm.toxicity import fit_toxicity, toxicity_scores, without_toxic

FOLDER = "/root/testdata/sf0.01"


def auc(score, y):
    high, low = score[y == 1], score[y == 0]
    return (high[:, None] > low).mean() + 0.5 * (high[:, None] == low).mean()


def test_isotonic_is_the_least_squares_fit():
    source = np.random.default_rng(0)
    x, y, w = source.random(60), source.random(60), source.random(60) + 0.1
    knots, values = isotonic(x, y, w)
    assert (np.diff(knots) > 0).all() and (np.diff(values) >= 0).all()
    fit = np.interp(x, knots, values)
    assert abs(np.sum(w * (y - fit))) < 1e-9  # block means
    order = np.argsort(x)
    for _ in range(200):
        other = np.sort(source.random(60))
        assert np.sum(w * (y - fit) ** 2) <= np.sum(w[order] * (y[order] - other) ** 2) + 1e-12


def test_trees_learn_an_interaction():
    source = np.random.default_rng(1)
    x = source.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit_calibrated(x[:2000], y[:2000], np.ones(2000))
    assert auc(model.predict(x[2000:]), y[2000:]) > 0.98


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    found = toxicity_scores(docs, fit_toxicity(docs, labels))
    rows = found.join(labels, "doc_id").where("held_out").collect()
    score, y = (np.array([r[c] for r in rows], dtype=float) for c in ("score", "toxic"))
    assert auc(score, y) > 0.85 and ((score >= 0.7) & (y == 0)).sum() <= 1
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


def test_held_out_labels_are_never_learnt(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    one, two = (dict((r["doc_id"], r["score"]) for r in toxicity_scores(docs, fit_toxicity(docs, t)).collect())
                for t in (labels, turned))
    assert one == two


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0), (5, 1), (5, 0), (None, 1), (6, None), (99, 1), (9, 0)], "doc_id bigint, toxic int")
    model = fit_toxicity(odd(spark), labels)
    found = toxicity_scores(odd(spark), model).collect()
    assert len(found) == odd(spark).count() and all(0 <= r["score"] <= 1 for r in found)
    assert without_toxic(odd(spark), model).columns == odd(spark).columns
    assert toxicity_scores(empty(spark), fit_toxicity(empty(spark), labels.limit(0))).count() == 0
