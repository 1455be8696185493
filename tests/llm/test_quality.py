"""Quality classifier: held-out accuracy, the sums behind it, edge rows."""

import numpy as np
from pyspark.sql import functions as F

from repolens.llm import queries, quality

from ..conftest import SMALL
from .helpers import edge_docs, tables


def test_held_out_accuracy(spark):
    folder = SMALL.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = queries.op7_quality(spark, folder).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 80 and np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_sums_and_steps_match_a_plain_fit(spark):
    folder = SMALL.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet").repartition(6)
    stats = docs.select("doc_id", quality.stats_column("text").alias("stats")).persist()
    rows = quality.labelled_stats(stats, spark.read.parquet(f"{folder}/labels.parquet"))
    model = quality.fit(stats, rows)
    found = rows.collect()
    everything = np.array([r.stats for r in stats.collect()])
    x, y = np.array([r.stats for r in found]), np.array([r.label for r in found])
    plain = quality.Model(everything.mean(0), everything.std(0))
    z = plain.features(x)
    weights = np.linalg.solve(z.T @ z + quality.RIDGE * np.diag([1.0] * quality.FEATURES + [1e-6]), z.T @ y)
    assert np.allclose(model.raw(x), z @ weights, atol=1e-6)
    assert (np.diff(model.steps[1]) > 0).all()


def test_isotonic_is_the_least_squares_fit():
    rng = np.random.default_rng(0)
    x, y, w = np.arange(30.0), rng.normal(size=30) + np.arange(30) / 10, rng.uniform(1, 3, 30)
    centres, values = quality.isotonic(x, y, w)
    fit = values[np.searchsorted(np.cumsum([0.0]), 0) :]
    assert (np.diff(fit) > 0).all()
    best = [max(min(np.average(y[a:b + 1], weights=w[a:b + 1]) for b in range(i, 30)) for a in range(i + 1)) for i in range(30)]
    assert np.allclose(sorted(set(np.round(best, 9))), np.round(fit, 9))


def test_edge_rows(spark, tmp_path):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (14, 0, 0), (6, None, 0), (None, 1, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    folder = tables(spark, tmp_path, documents=docs, labels=labels)
    out = queries.op7_quality(spark, folder).collect()
    assert len(out) == docs.count() and all(r.held_out is not None and 0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (3, 4)}) == 1  # empty and null
    stats = docs.select("doc_id", quality.stats_column("text").alias("stats"))
    model = quality.fit(stats, quality.labelled_stats(stats, labels.where("false")))
    assert {r.s for r in stats.select(quality.score_column(model, "stats").alias("s")).collect()} == {0.5}
    empty = edge_docs(spark, []).select("doc_id", quality.stats_column("text").alias("stats"))
    assert empty.select(quality.score_column(quality.fit(empty, quality.labelled_stats(empty, labels)), "stats").alias("s")).count() == 0


def test_no_label_reaches_a_score(spark):
    folder = SMALL.replace("sf0.001", "sf0.01")
    out = queries.op7_quality(spark, folder)
    text = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.md5("text").alias("h"))
    assert out.join(text, "doc_id").groupBy("h").agg(F.countDistinct("score").alias("n")).where("n > 1").count() == 0
