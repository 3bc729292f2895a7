"""Forest, training, prediction and live grading."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from hostgauge.fixed_values import CAP_TO_ONE, CAP_TO_ZERO, FEATURES
from hostgauge.operators import isolation_forest as forest
from hostgauge.operators.filters import benign
from hostgauge.operators.model_stats import scaled, scaler_dict, scaler_statistics
from hostgauge.plans import jobs
from hostgauge.queries.features import all_features
from hostgauge.queries.registry import S, T, graded_sql, query, rounded
from hostgauge.queries.statistics import graded_events, scored_events
from hostgauge.operators.model_stats import entity_thresholds, global_thresholds
from hostgauge.session import materialize, shared_folder
from hostgauge.sources.model_store import load_model
from hostgauge.sources.tables import telemetry

# Four small trees over (argsNum, returnValue, value).
TINY_COLUMNS = ["argsNum", "returnValue", "value"]
TINY_PSI = 16
TINY_OFFSET = -0.5
TINY_NODES = [
    # tree, node, feature, threshold, path length
    (0, 0, 0, 1.5, 0.0), (0, 1, -1, 0.0, 1.0), (0, 2, 1, 10.0, 0.0), (0, 5, -1, 0.0, 2.5), (0, 6, 2, 40.0, 0.0),
    (0, 13, -1, 0.0, 4.25), (0, 14, -1, 0.0, 3.0),
    (1, 0, 1, -5.0, 0.0), (1, 1, -1, 0.0, 1.5), (1, 2, -1, 0.0, 3.75),
    (2, 0, 2, 25.5, 0.0), (2, 1, 0, 3.0, 0.0), (2, 3, -1, 0.0, 4.5), (2, 4, -1, 0.0, 2.0), (2, 2, -1, 0.0, 1.0),
    (3, 0, -1, 0.0, 2.0),
]


@query("tiny_forest_score", f"""
WITH {T},
h AS (SELECT seq,
  (CASE WHEN argsNum < 1.5 THEN 1.0 WHEN returnValue < 10 THEN 2.5 WHEN value < 40 THEN 4.25 ELSE 3.0 END
   + CASE WHEN returnValue < -5 THEN 1.5 ELSE 3.75 END
   + CASE WHEN value < 25.5 THEN (CASE WHEN argsNum < 3 THEN 4.5 ELSE 2.0 END) ELSE 1.0 END
   + 2.0) / 4 AS depth FROM t)
SELECT seq, round(-pow(2, -depth / (2 * (ln(15) + 0.5772156649) - 2 * 15 / 16)) + 0.5, 9) AS score FROM h
""")
def tiny_forest_score(spark, sf_dir):
    nodes = pd.DataFrame(TINY_NODES, columns=["tree_id", "node_id", "feature", "threshold", "path_len"])
    trees = forest.Forest.from_nodes(nodes, TINY_PSI, TINY_OFFSET)
    score = forest.normality_score(spark, trees, TINY_COLUMNS)
    return rounded(telemetry(spark, sf_dir).select("seq", score.alias("score")), 9, "score")


@query("fitted_forest_scores")
def fitted_forest_scores(spark, sf_dir):
    """Every event scored by a forest grown from the benign ones."""
    rows = materialize(all_features(spark, sf_dir, ["hostName", "seq", "sus", "evil"]))
    normal = benign(rows)
    stats = scaler_dict(scaler_statistics(normal))
    fitted = forest.fit(scaled(normal, stats), ["hostName", "seq"])
    score = forest.normality_score(spark, fitted.forest)
    return scaled(rows, stats).select("seq", "evil", score.alias("normality_score"))


def trained_folder(spark, sf_dir, **options) -> tuple[str, object]:
    e = telemetry(spark, sf_dir)
    folder = f"{shared_folder(spark)}/hostgauge-model-{uuid.uuid4().hex}"
    o = jobs.TrainOptions(group_mode="host_user", host_col="hostName", **options)
    return folder, jobs.train(e, e, folder, o)


@query("training_report")
def training_report(spark, sf_dir):
    return trained_folder(spark, sf_dir)[1].drop("saved_to")


@query("model_predictions")
def model_predictions(spark, sf_dir):
    """Train, store, load, and predict every event with its features."""
    folder, _ = trained_folder(spark, sf_dir)
    return jobs.predict(telemetry(spark, sf_dir), load_model(spark, folder), attach_features=True)


@query("model_test_report")
def model_test_report(spark, sf_dir):
    folder, _ = trained_folder(spark, sf_dir)
    return jobs.test(telemetry(spark, sf_dir), load_model(spark, folder))


@query("host_variant_report")
def host_variant_report(spark, sf_dir):
    e = telemetry(spark, sf_dir)
    folder = f"{shared_folder(spark)}/hostgauge-model-{uuid.uuid4().hex}"
    return jobs.train_per_host(e, e, folder, jobs.TrainOptions()).drop("saved_to")


@query("legacy_variant_report")
def legacy_variant_report(spark, sf_dir):
    e = telemetry(spark, sf_dir)
    return jobs.test_legacy(e, jobs.train_legacy(e, e))


@query("host_variant_grades", f"""
WITH {graded_sql(20, 10, 'hostName')}
SELECT hostName AS entity, severity, count(*) AS n, round(min(score), 9) AS lowest FROM g GROUP BY 1, 2
""")
def host_variant_grades(spark, sf_dir):
    g = graded_events(spark, sf_dir, 20, 10, "host")
    out = g.groupBy("entity", "severity").agg(F.count(F.lit(1)).alias("n"), F.min("normality_score").alias("lowest"))
    return rounded(out, 9, "lowest")


def _quoted(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


@query("live_grades", f"""
WITH {graded_sql(20, 10)},
c AS (SELECT *, CASE WHEN lower(processName) IN {_quoted(CAP_TO_ZERO)} THEN 0
                     WHEN lower(processName) IN {_quoted(CAP_TO_ONE)} AND severity > 1 THEN 1 END AS cap FROM g)
SELECT seq, round(score, 9) AS raw_score, coalesce(cap, severity) AS severity, coalesce(cap, severity) > 0 AS is_anomaly,
       userId, processName, eventName, hostName AS hostname, cap AS severity_capped_at FROM c
""")
def live_grades(spark, sf_dir):
    s = scored_events(spark, sf_dir)
    thresholds = materialize(entity_thresholds(s, 20, 10))
    overall = global_thresholds(s, 20, 10).first().asDict()
    scored = s.withColumnsRenamed({"normality_score": "raw_score", "hostName": "hostname"})
    out = jobs.live_grades(scored, thresholds, overall)
    return rounded(out.select("seq", *jobs.LIVE_COLUMNS), 9, "raw_score")
