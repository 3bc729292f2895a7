"""What must hold of samples, forests and streams whose exact values SQL cannot repeat; and a stream that is replayed."""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import functions as F

from hostgauge.fixed_values import FEATURES
from hostgauge.operators import isolation_forest as forest, model_stats as ms
from hostgauge.operators.filters import benign
from hostgauge.plans import jobs
from hostgauge.queries import models, streams
from hostgauge.queries.alerting import GATES, WINDOWS, scored_users
from hostgauge.queries.features import all_features
from hostgauge.queries.registry import T, query
from hostgauge.session import materialize, shared_folder
from hostgauge.sources.model_store import Meta, check_features, load_model
from hostgauge.sources.tables import telemetry
from hostgauge.streaming import jobs as live, source

_BENIGN = f"WITH {T}, b AS (SELECT * FROM t WHERE sus = 0 AND evil = 0)"


@query("uniform_sample_facts", _BENIGN + """
SELECT least(1000, count(*)) AS n, least(1000, count(*)) AS distinct_rows, least(1000, count(*)) AS benign_rows FROM b
""")
def uniform_sample_facts(spark, sf_dir):
    events = telemetry(spark, sf_dir)
    sample = ms.uniform_sample(benign(events), ["hostName", "seq"], 1000).select("hostName", "seq")
    found = sample.join(events, ["hostName", "seq"])
    return found.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("hostName", "seq").alias("distinct_rows"),
        F.count_if((F.col("sus") == 0) & (F.col("evil") == 0)).alias("benign_rows"),
    )


@query("forest_facts", _BENIGN + """
SELECT 2000 AS trees, 2000 AS well_formed, (SELECT count(*) FROM b) AS sample_rows,
       2000 * least(256, (SELECT count(*) FROM b)) AS drawn_rows, count(*) AS rows_in_range FROM t
""")
def forest_facts(spark, sf_dir):
    """The default forest: trees of one leaf more than inner nodes, subsamples of full size, scores in range."""
    rows = materialize(all_features(spark, sf_dir, ["hostName", "seq", "sus", "evil"]))
    normal = benign(rows)
    stats = ms.scaler_dict(ms.scaler_statistics(normal))
    shaped = ms.scaled(normal, stats)
    fitted = forest.fit(shaped, ["hostName", "seq"])
    leaf = F.col("feature") < 0
    trees = fitted.nodes.groupBy("tree_id").agg((F.count_if(leaf) - F.count_if(~leaf)).alias("more"))
    ranked = spark.range(fitted.sample_size).select(F.col("id").alias("rank"))
    psi = forest.subsample_size(fitted.sample_size)
    drawn = forest.assign_subsamples(ranked, fitted.sample_size, psi, 2000, 42).distinct().agg(F.count(F.lit(1)).alias("drawn_rows"))
    raw = forest.normality_score(spark, fitted.forest) + F.lit(fitted.forest.offset)
    scored = ms.scaled(rows, stats).select(raw.alias("raw")).agg(F.count_if(F.col("raw").between(-1, 0)).alias("rows_in_range"))
    counted = trees.agg(F.count(F.lit(1)).alias("trees"), F.count_if(F.col("more") == 1).alias("well_formed"))
    return (
        counted.withColumn("sample_rows", F.lit(fitted.sample_size).cast("bigint"))
        .join(drawn, F.lit(True)).join(scored, F.lit(True))  # one row each
        .select("trees", "well_formed", "sample_rows", "drawn_rows", "rows_in_range")
    )


@query("training_facts", _BENIGN + f"""
SELECT {len(FEATURES)} AS n_features, 2000 AS n_trees, count(*) AS benign_sample_used,
       (SELECT count(DISTINCT hostName || ':' || userId) FROM t) AS entities_thresholded,
       (SELECT count(*) FROM t) AS global_n_scores, count(DISTINCT eventId) AS "eventId_entries",
       count(DISTINCT mountNamespace) AS "mountNamespace_entries", count(DISTINCT lower(processName)) AS "processName_entries"
FROM b
""")
def training_facts(spark, sf_dir):
    report = models.trained_folder(spark, sf_dir)[1]
    return report.select(
        "n_features", "n_trees", "benign_sample_used", "entities_thresholded", "global_n_scores", "eventId_entries",
        "mountNamespace_entries", "processName_entries",
    )


@query("host_variant_facts", _BENIGN + """
SELECT 2000 AS n_trees, count(*) AS benign_sample_used, (SELECT count(DISTINCT hostName) FROM t) AS entities_thresholded FROM b
""")
def host_variant_facts(spark, sf_dir):
    e = telemetry(spark, sf_dir)
    folder = f"{shared_folder(spark)}/hostgauge-model-{uuid.uuid4().hex}"
    report = jobs.train_per_host(e, e, folder, jobs.TrainOptions())
    return report.select("n_trees", "benign_sample_used", "entities_thresholded")


_PER_ENTITY = f"WITH {T} SELECT hostName || ':' || userId AS entity, count(*) AS n, count(*) AS consistent FROM t GROUP BY 1"


@query("prediction_facts", _PER_ENTITY)
def prediction_facts(spark, sf_dir):
    """Severity follows from the row's own thresholds, which are finite and in order."""
    folder, _ = models.trained_folder(spark, sf_dir)
    rows = jobs.predict(telemetry(spark, sf_dir), load_model(spark, folder))
    s, low, high = F.col("normality_score"), F.col("low_threshold"), F.col("high_threshold")
    severity = F.when(s < high, 2).when(s < low, 1).otherwise(0)
    right = (F.col("severity") == severity) & (high <= low) & (F.col("malicious_pred") == (severity > 0).cast("int"))
    return rows.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.count_if(right).alias("consistent"))


@query("stream_score_facts", f"""
WITH {T} SELECT hostName AS hostname, count(*) AS n, count(DISTINCT seq) AS distinct_rows, count(*) AS consistent FROM t GROUP BY 1
""")
def stream_score_facts(spark, sf_dir):
    """The chain of streams scores every event once, with severities that mark anomalies."""
    rows = streams.stream_live_scores(spark, sf_dir)
    right = (F.col("is_anomaly") == (F.col("severity") > 0)) & F.col("severity").between(0, 2) & F.col("raw_score").isNotNull()
    return rows.groupBy("hostname").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("seq").alias("distinct_rows"), F.count_if(right).alias("consistent")
    )


@query("stream_replayed_alerts", WINDOWS + " SELECT * FROM a")
def stream_replayed_alerts(spark, sf_dir):
    """The batch alerts, from scores that come in four batches, each of them published again after the next."""
    folder = f"{shared_folder(spark)}/hostgauge-replay-{uuid.uuid4().hex}"
    rows = materialize(scored_users(spark, sf_dir))
    first, last = rows.agg(F.min("ts_us"), F.max("ts_us")).first()
    part = F.floor((F.col("ts_us") - first) * 4 / (last - first + 1))
    scores, alerts = f"{folder}/scores", f"{folder}/alerts"
    live.prepare(spark, scores, ", ".join(f"{c} {t}" for c, t in rows.dtypes))
    stream_schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    for i in range(4):
        live.write_batch(rows.where(part == i), scores, i)
        for again in range(i + 1):
            live.write_batch(rows.where(part == again), scores, again)
        stream = live.stream_table(spark, scores, stream_schema)
        live.start_alerts(stream, alerts, f"{folder}/checkpoint", source.DRAIN, **GATES).awaitTermination()
        known = live.read_table(spark, alerts, live.ALERT_TABLE)
        for b in [r[0] for r in known.select("batch_id").distinct().collect() if r[0] >= 0]:
            live.write_batch(known.where(F.col("batch_id") == b).drop("batch_id"), alerts, b)
    return live.read_table(spark, alerts, live.ALERT_TABLE).drop("batch_id")


@query("test_report_facts", f"""
WITH {T} SELECT count(*) AS n, sum(evil) AS positives, count(*) AS any_cells, count(*) AS high_cells, true AS consistent FROM t
""")
def test_report_facts(spark, sf_dir):
    """The report of a trained model on labelled events: its cells add up, and high alerts are among all alerts."""
    r = models.model_test_report(spark, sf_dir)
    cells = {p: sum((F.col(f"{p}_{c}") for c in ("tp", "fp", "fn", "tn")), F.lit(0)) for p in ("any", "high")}
    right = (
        (F.col("high_tp") <= F.col("any_tp")) & (F.col("high_fp") <= F.col("any_fp"))
        & (F.col("any_tp") + F.col("any_fn") == F.col("evil_count")) & (F.col("high_tp") + F.col("high_fn") == F.col("evil_count"))
        & F.col("roc_auc").between(0, 1) & F.col("avg_precision").between(0, 1)
        & ((F.col("any_tp") == 0) | (F.abs(F.col("any_precision") - F.col("any_tp") / (F.col("any_tp") + F.col("any_fp"))) < 1e-12))
    )
    return r.select(
        F.col("rows").alias("n"), F.col("evil_count").alias("positives"), cells["any"].alias("any_cells"),
        cells["high"].alias("high_cells"), right.alias("consistent"),
    )


@query("legacy_report_facts", f"WITH {T} SELECT count(*) AS n, count(*) AS cells, sum(evil) AS positives, true AS consistent FROM t")
def legacy_report_facts(spark, sf_dir):
    """The single-threshold variant: cells add up, and the threshold is one of those that the sweep tries."""
    r = models.legacy_variant_report(spark, sf_dir)
    cells = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    right = F.col("threshold").isNotNull() & ~F.isnan("threshold") & F.col("roc_auc").between(0, 1) & (F.col("tp") + F.col("fp") > 0)
    return r.select(F.col("n"), cells.alias("cells"), (F.col("tp") + F.col("fn")).alias("positives"), right.alias("consistent"))


@query("feature_check", f"""
WITH {T}, names AS (SELECT DISTINCT eventName AS model FROM t)
SELECT model, model = 'close' AS fits, model <> 'close' AS warned FROM names
""")
def feature_check(spark, sf_dir):
    """Models stored with this engine's features and with others: the latter load with a warning, and are no failure."""
    names = [r[0] for r in telemetry(spark, sf_dir).select("eventName").distinct().collect()]  # a handful
    rows = []
    for name in names:
        features = FEATURES if name == "close" else [*FEATURES[:-1], name]
        with warnings.catch_warnings(record=True) as said:
            warnings.simplefilter("always")
            fits = check_features(Meta(256, 0.0, 0.0, 0.0, 1, features=features))
        rows.append((name, fits, len(said) == 1))
    return spark.createDataFrame(rows, "model string, fits boolean, warned boolean")


@query("unlabelled_events", f"WITH {T} SELECT hostName, count(*) AS scored, true AS refused FROM t GROUP BY 1")
def unlabelled_events(spark, sf_dir):
    """Without the label column scoring works, and evaluation is refused before it starts."""
    folder, _ = models.trained_folder(spark, sf_dir)
    model, events = load_model(spark, folder), telemetry(spark, sf_dir).drop("evil", "sus")
    try:
        jobs.test(events, model)
        refused = False
    except ValueError:
        refused = True
    scored = jobs.predict(events, model).where("normality_score is not null and severity is not null")
    return scored.groupBy("hostName").agg(F.count(F.lit(1)).alias("scored")).withColumn("refused", F.lit(refused))
