import numpy as np
import pytest
from pyspark.sql import functions as F

from hostgauge.operators import evaluate
from hostgauge.operators.model_stats import capped_per_entity, scaled, scaler_dict, scaler_statistics, uniform_sample


def brute(scores, evil):
    s, y = np.asarray(scores), np.asarray(evil)
    pos, neg = s[y == 1], s[y == 0]
    auc = None
    if len(pos) and len(neg):
        auc = np.mean([(p < n) + 0.5 * (p == n) for p in pos for n in neg])
    if not len(pos):
        return auc, None
    ap, before = 0.0, 0.0
    for v in np.unique(s):
        taken = s <= v
        recall = y[taken].sum() / len(pos)
        ap += (recall - before) * y[taken].mean()
        before = recall
    return auc, ap


def frame(spark, scores, evil, severity=None):
    sev = severity if severity is not None else [0] * len(scores)
    rows = [("e", float(s), int(y), int(v)) for s, y, v in zip(scores, evil, sev)]
    return spark.createDataFrame(rows, "entity string, normality_score double, evil int, severity int").repartition(3)


RNG = np.random.default_rng(3)
CASES = {
    "ties": (RNG.integers(-5, 5, 400) / 10, RNG.integers(0, 2, 400)),
    "plain": (RNG.normal(size=300), (RNG.random(300) < 0.1).astype(int)),
    "no positives": ([0.1, 0.2], [0, 0]),
    "all positives": ([0.1, 0.2, 0.2], [1, 1, 1]),
    "zero": ([0.0, -0.0, 0.5, -0.5], [1, 0, 0, 1]),
}


@pytest.mark.parametrize("case", CASES)
def test_ranking(spark, case):
    scores, evil = CASES[case]
    r = evaluate.ranking(frame(spark, scores, evil)).first()
    auc, ap = brute(scores, evil)
    assert r["roc_auc"] == (None if auc is None else pytest.approx(auc))
    assert r["avg_precision"] == (None if ap is None else pytest.approx(ap))


def test_zero_denominators(spark):
    rows = {r["policy"]: r for r in evaluate.confusion(frame(spark, [0.1, 0.2], [0, 1])).collect()}
    r = rows["low_or_high"]
    assert (r["tn"], r["fn"], r["precision"], r["recall"], r["f1"]) == (1, 1, 0.0, 0.0, 0.0)


def test_policies(spark):
    r = {x["policy"]: x for x in evaluate.confusion(frame(spark, [0] * 4, [1, 1, 0, 0], [2, 1, 1, 0])).collect()}
    assert [r["low_or_high"][c] for c in ("tn", "fp", "fn", "tp")] == [1, 1, 0, 2]
    assert [r["high_only"][c] for c in ("tn", "fp", "fn", "tp")] == [2, 0, 1, 1]


@pytest.mark.parametrize("metric", ["f1", "precision", "recall"])
def test_sweep_picks_the_first_best(spark, metric):
    scores, evil = CASES["ties"]
    cuts = np.percentile(scores, np.linspace(0.1, 50.0, 200))
    best, chosen = -1.0, cuts[0]
    for cut in cuts:
        pred = scores < cut
        tp, fp, fn = (pred & (evil == 1)).sum(), (pred & (evil == 0)).sum(), (~pred & (evil == 1)).sum()
        p, r = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn)
        value = {"f1": 2 * p * r / (p + r) if p + r else 0.0, "precision": p, "recall": r}[metric]
        if value > best + 1e-15:
            best, chosen = value, cut
    picked = evaluate.pick_threshold(evaluate.sweep(frame(spark, scores, evil)), metric).first()
    assert picked[metric] == pytest.approx(best)
    assert picked["threshold"] == pytest.approx(chosen)


def test_bad_metric_and_missing_labels(spark):
    df = frame(spark, [0.1], [1])
    with pytest.raises(ValueError):
        evaluate.pick_threshold(df, "auc")
    with pytest.raises(ValueError):
        evaluate.test_report(df.drop("evil"))
    with pytest.raises(ValueError):
        evaluate.sweep(df.where("false"))


def test_scaler(spark):
    x = RNG.normal(size=(200, 2))
    df = spark.createDataFrame([(float(a), float(b), 4.0) for a, b in x], "a double, b double, c double")
    stats = scaler_dict(scaler_statistics(df, ["a", "b", "c"]))
    assert stats["a"] == pytest.approx((x[:, 0].mean(), x[:, 0].std()))
    assert stats["c"] == (4.0, 1.0)
    assert [r["c"] for r in scaled(df, stats).distinct().select("c").distinct().collect()] == [0.0]


def test_samples(spark):
    df = spark.range(4000).select(F.col("id"), F.when(F.col("id") % 4 == 0, "small").otherwise("hot").alias("entity"))
    sample = uniform_sample(df, ["id"], 500)
    ids = [r["id"] for r in sample.collect()]
    assert len(set(ids)) == 500 and abs(np.mean(ids) - 2000) < 200
    assert sorted(ids) == sorted(r["id"] for r in uniform_sample(df.repartition(9), ["id"], 500).collect())
    capped = capped_per_entity(df, ["id"], 1200).groupBy("entity").count().collect()
    assert {r["entity"]: r["count"] for r in capped} == {"small": 1000, "hot": 1200}
    assert capped_per_entity(df, ["id"], 1200, entity=None).count() == 1200
