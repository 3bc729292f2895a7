"""The quality model is learnt from every labelled row, whatever group it is dealt to."""

import numpy as np
from pyspark.sql import functions as F

from hostgauge.llm import quality


def labelled(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    good = (rng.random(n) < 0.7).astype(int)
    x = rng.normal(size=(n, len(quality.FEATURES))) + 1.5 * good[:, None] * (np.arange(len(quality.FEATURES)) < 4)
    rows = [(i, int(g), [float(v) for v in r]) for i, (g, r) in enumerate(zip(good, x))]
    return spark.createDataFrame(rows, "doc long, label int, x array<double>"), x, good


def test_groups_learn_what_one_learns(spark):
    df, x, good = labelled(spark, 3000)
    one = quality.learn(x, good)
    for group_rows in (10_000, 500):
        many = quality.learn_all(df.repartition(5), group_rows)
        assert np.allclose(many.mean, one.mean, atol=1e-5) and np.allclose(many.spread, one.spread, atol=1e-5)
        assert np.corrcoef(many.weights, one.weights)[0, 1] > 0.99
        assert ((many.raw(x) < many.threshold).sum()) == (good == 0).sum()  # the cut of all rows, not of some
        assert (((many.score(x) >= 0.5) == good).mean()) > 0.85
        again = quality.learn_all(df.repartition(2), group_rows)
        assert np.array_equal(again.weights, many.weights) and again.threshold == many.threshold


def test_all_labelled_rows_are_taken(spark):
    docs = spark.range(21_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    rows = quality.training_rows(docs, labels, "quality", "text", "doc_id", None, folds=1 << 30)
    assert rows.count() == 21_000


def test_one_label_only(spark):
    df, _, _ = labelled(spark, 50)
    model = quality.learn_all(df.where("label = 1"))
    assert model.score(np.ones((2, len(quality.FEATURES)))).tolist() == [0.5, 0.5]
