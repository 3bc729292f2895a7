import numpy as np
import pytest
from pyspark.sql import functions as F

from hostgauge.operators.ordered import bin_by, exact_quantiles, first_rows, rank_curve, value_bin, with_random_rank
from tests.conftest import plan_of

RNG = np.random.default_rng(5)
VALUES = {
    "spread": RNG.normal(size=700),
    "ties": RNG.integers(-3, 4, 900) / 7,
    "one": np.array([0.25]),
    "same": np.full(50, -1.5),
    "wide": np.concatenate([10.0 ** RNG.uniform(-300, 300, 200), [0.0, -0.0, -1e-300]]),
}


def frame(spark):
    rows = [(k, float(v)) for k, vs in VALUES.items() for v in vs]
    return spark.createDataFrame(rows, "g string, v double").repartition(5)


@pytest.mark.parametrize("probs", [[0.02, 0.002], [0.0, 0.5, 1.0], [0.111, 0.3331]])
def test_quantiles_equal_numpy(spark, probs):
    wanted = {f"p{i}": p for i, p in enumerate(probs)}
    for r in exact_quantiles(frame(spark), "v", wanted, ["g"]).collect():
        expected = np.quantile(VALUES[r["g"]], probs)
        assert np.allclose([r[k] for k in wanted], expected, rtol=1e-12, atol=0), r["g"]
        assert r["n_scores"] == len(VALUES[r["g"]])


def test_overall_quantiles_skip_null_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    r = exact_quantiles(df, "v", {"m": 0.5}).first()
    assert (r["m"], r["n_scores"]) == (2.0, 2)


def test_quantiles_of_nothing(spark):
    none = spark.createDataFrame([], "g string, v double")
    assert exact_quantiles(none, "v", {"m": 0.5}, ["g"]).count() == 0
    assert tuple(exact_quantiles(none, "v", {"m": 0.5}).first()) == (None, 0)


def test_bins_never_fall(spark):
    v = np.sort(np.concatenate([*VALUES.values(), [np.nextafter(1, 2), 1.0, np.nextafter(1, 0), -1.0]]))
    rows = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, v double")
    bins = [r["b"] for r in rows.select("i", value_bin(F.col("v")).alias("b")).orderBy("i").collect()]
    assert bins == sorted(bins)


def test_rank_curve(spark):
    df = frame(spark).where("g in ('ties', 'spread')")
    v = np.concatenate([VALUES["ties"], VALUES["spread"]])
    got = rank_curve(df, "v", {"n": F.lit(1)}).collect()
    assert len(got) == len(np.unique(v))
    for r in got:
        assert (r["n"], r["n_below"], r["n_all"]) == ((v == r["v"]).sum(), (v < r["v"]).sum(), len(v))


def test_first_rows_per_group(spark):
    rows = [(g, i, float(RNG.integers(0, 50))) for g, n in (("a", 900), ("b", 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    got = first_rows(df, 40, [F.col("v"), F.col("i")], [F.floor(F.col("v") / 5), F.col("v")], ["g"]).collect()
    for g in "ab":
        expected = sorted((v, i) for h, i, v in rows if h == g)[:40]
        assert sorted((r["v"], r["i"]) for r in got if r["g"] == g) == expected


def test_random_rank_is_dense_and_stable(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    one = {r["k"]: r["rank"] for r in with_random_rank(df.repartition(7), ["k"], 9).collect()}
    two = {r["k"]: r["rank"] for r in with_random_rank(df.coalesce(1), ["k"], 9).collect()}
    assert one == two and sorted(one.values()) == list(range(3000))
    assert [one[i] for i in range(50)] != list(range(50))
    few = with_random_rank(df, ["k"], 9, limit=100).collect()
    assert {r["k"] for r in few} == {k for k, rank in one.items() if rank < 100}


def test_bins_of_ranks_grow_in_number_with_the_rows(spark):
    from hostgauge.operators import ordered

    assert ordered.rank_bits(3000) == 12
    for n in (10**6, 10**9, 10**12):
        assert n >> ordered.rank_bits(n) <= 65_536


def test_drift_thresholds_gather_no_scores(spark, monkeypatch):
    from hostgauge.queries import monitoring

    asked = []

    def watched(df, value, probs, *more):
        asked.append(probs)
        return exact_quantiles(df, value, probs, *more)

    monkeypatch.setattr(monitoring, "exact_quantiles", watched)
    monitoring.score_drift(spark, "/root/testdata/sf0.001").collect()
    assert asked == [{"low": 0.02, "high": 0.002}]


def test_bin_by(spark):
    cuts = [-1.0, 0.0, 0.0, 2.5]
    df = spark.createDataFrame([(x,) for x in (-2.0, -1.0, -0.5, 0.0, 1.0, 2.5, 9.0)], "v double")
    assert [r[0] for r in df.select(bin_by(F.col("v"), cuts)).collect()] == [0, 1, 1, 3, 3, 4, 4]


def test_a_group_is_never_sorted_as_one(spark):
    """All windows over rows are per (group, bin); only bin counts are per group."""
    plan = plan_of(exact_quantiles(frame(spark), "v", {"m": 0.5}, ["g"]))
    sorts = [line for line in plan.splitlines() if "Sort [" in line]
    assert sorts and all("_bin" in line for line in sorts)
