"""Rows judged node by node: the same numbers as rows that go down the trees, from any batches."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hostgauge.operators import isolation_forest as forest


def rows(n, seed):
    """Flags, few values, many values, a constant."""
    rng = np.random.default_rng(seed)
    return np.column_stack([rng.random(n) < 0.2, rng.integers(0, 6, n), rng.exponential(50, n), rng.normal(size=n), np.ones(n)]).astype(float)


def grown(trees, psi, levels):
    nodes = [(t, *n) for t in range(trees) for n in forest.grow_tree(rows(psi, t), np.random.default_rng(t), levels)]
    return forest.Forest.from_nodes(pd.DataFrame(nodes, columns=["tree_id", "node_id", "feature", "threshold", "path_len"]), psi)


@pytest.mark.parametrize("trees,psi,levels", [(1, 1, 1), (3, 2, 1), (40, 64, 6), (300, 256, 8)])
def test_equal_to_the_way_down(trees, psi, levels, monkeypatch):
    f = grown(trees, psi, levels)
    x = np.vstack([rows(700, 999), np.full((1, 5), np.nan), np.full((1, 5), np.inf), np.full((1, 5), -np.inf), np.zeros((1, 5)) * -1.0])
    on_cuts = f.threshold[0][np.isfinite(f.threshold[0])][:50]  # a value on a cut is not below it
    x = np.vstack([x, np.repeat(on_cuts, 5).reshape(-1, 5)])
    blocks = forest.pruned(f.feature, f.threshold, f.path_len)
    assert len(blocks) == -(-trees // 256)
    assert np.array_equal(forest.judged(x, blocks, psi), f.raw_scores(x))
    monkeypatch.setattr(forest, "_BATCH", 90)
    monkeypatch.setattr(forest, "_FEW", 2)
    assert np.array_equal(forest.judged(x, blocks, psi), f.raw_scores(x))
    assert all(np.array_equal(forest.judged(x[i : i + 1], blocks, psi), f.raw_scores(x[i : i + 1])) for i in range(0, len(x), 97))


def test_nodes_that_do_not_matter_go():
    f = grown(20, 256, 8)
    kept = lambda node: 0 if node is None else 1 + kept(node[3]) + kept(node[4])
    (_, trees), = forest.pruned(f.feature, f.threshold, f.path_len)
    assert sum(kept(root) for root, _ in trees) < np.isfinite(f.threshold).sum()


@pytest.mark.parametrize("psi", [256, 1024])  # the larger trees are walked down
def test_scores_do_not_depend_on_batches(spark, psi):
    f = grown(5, psi, 8 if psi == 256 else 10)
    x = rows(400, 5)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double, d double, e double")
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    try:
        spark.conf.set(setting, "7")
        got = df.repartition(3).select("id", forest.normality_score(spark, f, list("abcde")).alias("s")).orderBy("id").collect()
    finally:
        spark.conf.set(setting, before)
    assert np.array_equal([r["s"] for r in got], f.raw_scores(x) - f.offset)
