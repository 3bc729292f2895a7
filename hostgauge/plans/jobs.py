"""Training, evaluation and prediction over event tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hostgauge.fixed_values import (
    CONTAMINATION, FEATURES, HIGH_PERCENTILE, LEGACY_CONTAMINATION, LEGACY_FEATURES, LEGACY_N_TREES, LOW_PERCENTILE,
    N_TREES, SEED,
)
from hostgauge.functions.event_features import entity_key, legacy_vector
from hostgauge.functions.severity import apply_cap, capped_at, is_anomaly, malicious_pred
from hostgauge.operators import evaluate
from hostgauge.operators.filters import benign, complete
from hostgauge.operators.isolation_forest import Forest, fit, normality_score
from hostgauge.operators.model_stats import (
    capped_per_entity, entity_thresholds, frequency_tables, global_thresholds, override_global, scaled, scaler_dict,
    scaler_statistics, with_severity, with_thresholds,
)
from hostgauge.plans.features import feature_rows
from hostgauge.schemas import require
from hostgauge.session import materialize, shared_folder
from hostgauge.sources.model_store import Meta, Model, load_meta, load_model, save_meta, save_table

ROW_KEY = ["hostName", "userId", "processId", "ts_us", "seq"]


@dataclass
class TrainOptions:
    group_mode: str = "user"
    user_col: str = "userId"
    host_col: str | None = None
    low_percentile: float = LOW_PERCENTILE
    high_percentile: float = HIGH_PERCENTILE
    n_trees: int = N_TREES
    contamination: float = CONTAMINATION
    max_samples: int | float | str = "auto"
    # None trains on every benign row, a number on a uniform sample of them
    train_sample: int | None = None
    seed: int = SEED
    # None takes every score into the percentiles, a number a sample per entity
    max_scores_per_entity: int | None = None
    # "benign": the windows of training rows see benign rows only; "all": every row
    context: str = "benign"

    def check(self) -> None:
        if self.high_percentile >= self.low_percentile:
            raise ValueError("high_percentile must be smaller than low_percentile")
        if self.group_mode in ("host_user", "host") and not self.host_col:
            raise ValueError(f"group_mode {self.group_mode} requires host_col")
        if self.context not in ("benign", "all"):
            raise ValueError("context must be benign or all")

    def entity(self) -> Column:
        return entity_key(self.group_mode, self.user_col, self.host_col or "hostName")


class Steps:
    """Results of expensive steps as tables in the shared folder; they go when the job ends, also if it fails."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark).rstrip('/')}/hostgauge-job-{uuid.uuid4().hex}"

    def __enter__(self) -> "Steps":
        return self

    def __exit__(self, *_) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def stored(self, df: DataFrame, what: str) -> DataFrame:
        path = f"{self.folder}/{what}"
        df.write.parquet(path)
        return self.spark.read.parquet(path)


def _row(df: DataFrame) -> DataFrame:
    """A report of one row, worked out now, as what it was read from goes."""
    return df.sparkSession.createDataFrame([df.first()], df.schema)


def training_features(train: DataFrame, freq_tables: DataFrame, context: str = "benign") -> DataFrame:
    if context == "benign":
        return feature_rows(benign(train), freq_tables, ROW_KEY, missing_is_thread=True)
    rows = feature_rows(train, freq_tables, [*ROW_KEY, "sus", "evil"], missing_is_thread=True)
    return benign(rows).drop("sus", "evil")


def with_scores(features: DataFrame, model: Model, name: str = "normality_score") -> DataFrame:
    """``name`` next to the unscaled features."""
    spark = features.sparkSession
    columns = list(model.scaler)
    raw = {f"_{c}": (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in model.scaler.items()}
    shaped = features.withColumns(raw)
    score = normality_score(spark, model.forest, [f"_{c}" for c in columns])
    return shaped.withColumn(name, score).drop(*raw)


def train(train_events: DataFrame, validation_events: DataFrame, out_dir: str, options: TrainOptions | None = None) -> DataFrame:
    """Trains, stores the model in ``out_dir`` and returns a one-row report."""
    o = options or TrainOptions()
    o.check()
    with Steps(train_events.sparkSession) as steps:
        return _train(complete(train_events), complete(validation_events), out_dir, o, steps)


def _train(train_events: DataFrame, validation_events: DataFrame, out_dir: str, o: TrainOptions, steps: Steps) -> DataFrame:
    spark = train_events.sparkSession

    freq = save_table(frequency_tables(benign(train_events)), out_dir, "freq_tables")
    # used by the scaler and by the sample, so computed once
    features = steps.stored(training_features(train_events, freq, o.context), "train")
    stats = scaler_dict(save_table(scaler_statistics(features).coalesce(1), out_dir, "scaler_stats"))
    if any(m is None for m, _ in stats.values()):
        raise ValueError("no benign rows to train on")
    fitted = fit(
        scaled(features, stats), ROW_KEY, o.n_trees, o.contamination, o.max_samples, o.train_sample, o.seed
    )
    save_table(fitted.nodes, out_dir, "forest_nodes")

    draft = Model(None, fitted.forest, stats, freq, None)
    labels = [c for c in ("evil",) if c in validation_events.columns]
    validation = feature_rows(
        validation_events.withColumn("entity", o.entity()), freq, [*ROW_KEY, "entity", *labels], missing_is_thread=True
    )
    scores = steps.stored(with_scores(validation, draft).select(*ROW_KEY, "entity", "normality_score", *labels), "scores")
    percentiles = (o.low_percentile, o.high_percentile)
    cap = o.max_scores_per_entity
    per_entity = capped_per_entity(scores, ROW_KEY, cap, o.seed) if cap else scores
    overall = capped_per_entity(scores, ROW_KEY, cap, o.seed, None) if cap else scores
    thresholds = save_table(entity_thresholds(per_entity, *percentiles), out_dir, "thresholds")
    g = global_thresholds(overall, *percentiles).first()
    nan = float("nan")
    low, high, n = (g["low"], g["high"], g["n_scores"]) if g["n_scores"] else (nan, nan, 0)
    meta = Meta(
        psi=fitted.forest.psi, offset=fitted.forest.offset, global_low=low, global_high=high, global_n_scores=n,
        user_col=o.user_col, host_col=o.host_col, group_mode=o.group_mode,
        low_percentile=o.low_percentile, high_percentile=o.high_percentile,
    )
    save_meta(spark, meta, out_dir)
    return training_report(out_dir, o, fitted.sample_size, meta, freq, thresholds, scores if labels else None)


def training_report(
    out_dir: str, o: TrainOptions, sample: int, meta: Meta, freq: DataFrame, thresholds: DataFrame, scores: DataFrame | None
) -> DataFrame:
    spark = freq.sparkSession
    sizes = freq.agg(*[
        F.count_if(F.col("table_name") == t).alias(f"{t}_entries") for t in ("eventId", "mountNamespace", "processName")
    ]).first()
    row = {
        "saved_to": out_dir, "group_mode": o.group_mode, "low_percentile": o.low_percentile,
        "high_percentile": o.high_percentile, "n_features": len(FEATURES), "benign_sample_used": sample, "n_trees": o.n_trees,
        "contamination": o.contamination, "max_samples": str(o.max_samples), "entities_thresholded": thresholds.count(),
        "global_low": meta.global_low, "global_high": meta.global_high, "global_n_scores": meta.global_n_scores,
        **sizes.asDict(),
    }
    if scores is not None:
        row |= {f"validation_{k}": v for k, v in evaluate.validation_report(scores).first().asDict().items()}
    return spark.createDataFrame([row], ", ".join(f"`{k}` {_sql_type(v)}" for k, v in row.items()))


def _sql_type(v) -> str:
    return {str: "string", int: "bigint"}.get(type(v), "double")


# -- use of a trained model ---------------------------------------------------------------


def graded(scored: DataFrame, thresholds: DataFrame, overall: dict[str, float], score: str = "normality_score") -> DataFrame:
    """Thresholds, severity and prediction for rows with ``entity`` and a score."""
    rows = with_severity(with_thresholds(scored, thresholds, overall), score)
    return rows.withColumn("malicious_pred", malicious_pred(F.col("severity")))


def predict(events: DataFrame, model: Model, attach_features: bool = False, keep: list[str] = ("hostName", "userId", "seq")) -> DataFrame:
    """The prediction row of every event, behind ``keep`` and, if asked, the features."""
    m = model.meta
    require(events, m.user_col)
    entity = entity_key(m.group_mode, m.user_col, m.host_col or "hostName")
    rows = feature_rows(
        complete(events).withColumn("entity", entity), model.freq_tables, [*keep, "entity"], missing_is_thread=True
    )
    out = graded(with_scores(rows, model), model.thresholds, m.overall)
    wanted = ["entity", "normality_score", "low_threshold", "high_threshold", "severity", "malicious_pred"]
    return out.select(*keep, *(FEATURES if attach_features else []), *wanted)


def test(events: DataFrame, model: Model) -> DataFrame:
    """One-row report on labelled events."""
    require(events, "evil")
    policy = {
        "entity_mode": F.lit(model.meta.group_mode),
        "low_percentile": F.lit(model.meta.low_percentile),
        "high_percentile": F.lit(model.meta.high_percentile),
    }
    with Steps(events.sparkSession) as steps:
        labelled = steps.stored(predict(events, model, keep=["seq", "evil"]), "test")
        return _row(evaluate.test_report(labelled).withColumns(policy))


def live_grades(
    scored: DataFrame,
    thresholds: DataFrame,
    overall: dict[str, float],
    override: tuple[float | None, float | None] = (None, None),
    fold_case: bool = False,
) -> DataFrame:
    """Live score rows: severity with the infrastructure caps applied.

    ``scored`` has entity, raw_score, hostname, userId, processName, eventName.
    """
    rows = with_thresholds(scored, thresholds, override_global(overall, *override), per_field=True)
    rows = with_severity(rows, "raw_score")
    rows = rows.withColumn("severity_capped_at", capped_at(F.col("severity"), fold_case=fold_case))
    rows = rows.withColumn("severity", apply_cap(F.col("severity"), F.col("severity_capped_at")))
    return rows.withColumn("is_anomaly", is_anomaly(F.col("severity")))


LIVE_COLUMNS = [
    "raw_score", "severity", "is_anomaly", "userId", "processName", "eventName", "hostname", "severity_capped_at",
]


# -- the single-threshold variant -----------------------------------------------------------


@dataclass
class LegacyModel:
    scaler: dict[str, tuple[float, float]]
    forest: Forest
    threshold: float


def legacy_scores(events: DataFrame, model: LegacyModel, *keep: str) -> DataFrame:
    rows = scaled(legacy_vector(events, *keep), model.scaler)
    return rows.withColumn("normality_score", normality_score(events.sparkSession, model.forest, LEGACY_FEATURES))


def train_legacy(
    train_events: DataFrame, validation_events: DataFrame, n_trees: int = LEGACY_N_TREES,
    contamination: float = LEGACY_CONTAMINATION, metric: str = "f1", seed: int = SEED,
    train_sample: int | None = None, out_dir: str | None = None,
) -> LegacyModel:
    """Seven raw columns, one global threshold picked by a sweep on validation; stored if ``out_dir`` is given."""
    spark = train_events.sparkSession
    keys = [f"_{c}" for c in ROW_KEY]
    rows = benign(train_events).select("*", *[F.col(c).alias(k) for c, k in zip(ROW_KEY, keys)])
    with Steps(spark) as steps:
        features = steps.stored(legacy_vector(rows, *keys), "legacy")
        measured = materialize(scaler_statistics(features, LEGACY_FEATURES))
        stats = scaler_dict(measured)
        fitted = fit(
            scaled(features, stats), keys, n_trees, contamination, "auto", train_sample, seed, LEGACY_FEATURES
        )
        model = LegacyModel(stats, fitted.forest, float("nan"))
        scores = steps.stored(legacy_scores(validation_events, model, "evil").select("evil", "normality_score"), "scores")
        model.threshold = evaluate.pick_threshold(evaluate.sweep(scores), metric).first()["threshold"]
    if out_dir:
        save_table(fitted.nodes, out_dir, "forest_nodes")
        save_table(measured.coalesce(1), out_dir, "scaler_stats")
        meta = {"psi": model.forest.psi, "offset": model.forest.offset, "threshold": model.threshold, "features": LEGACY_FEATURES}
        save_meta(spark, meta, out_dir)
    return model


def load_legacy(spark: SparkSession, folder: str) -> LegacyModel:
    """What ``train_legacy`` stored; a model of other columns is refused."""
    meta = load_meta(spark, folder)
    if meta["features"] != LEGACY_FEATURES:
        raise ValueError(f"the model in {folder} has the columns {meta['features']}; train it again")
    nodes = spark.read.parquet(f"{folder}/forest_nodes").toPandas()  # a size that the parameters fix
    scaler = scaler_dict(spark.read.parquet(f"{folder}/scaler_stats"))
    return LegacyModel(scaler, Forest.from_nodes(nodes, meta["psi"], meta["offset"]), meta["threshold"])


def predict_legacy(
    events: DataFrame, model: LegacyModel, attach_features: bool = False, keep: list[str] = ("hostName", "userId", "seq")
) -> DataFrame:
    """``keep``, if asked the unscaled columns, the score, and 1 for rows below the threshold."""
    keep = list(dict.fromkeys([*keep, *(LEGACY_FEATURES if attach_features else [])]))
    renamed = {f"_{c}": F.col(c) for c in keep}  # the vector has columns of the same names
    rows = legacy_scores(events.withColumns(renamed), model, *renamed)
    below = (F.col("normality_score") < model.threshold).cast("int")
    return rows.select(*[F.col(f"_{c}").alias(c) for c in keep], "normality_score", below.alias("malicious_pred"))


def test_legacy(events: DataFrame, model: LegacyModel, name: str = "test") -> DataFrame:
    scores = materialize(legacy_scores(events, model, "evil").select("evil", "normality_score"))
    return evaluate.single_threshold_report(scores, model.threshold, name=name)


def train_per_host(train_events: DataFrame, validation_events: DataFrame, out_dir: str, options: TrainOptions | None = None) -> DataFrame:
    """The per-host two-tier variant: thresholds by host instead of by user."""
    o = options or TrainOptions()
    o.group_mode, o.host_col = "host", o.host_col or "hostName"
    return train(train_events, validation_events, out_dir, o)


__all__ = [
    "TrainOptions", "train", "train_legacy", "load_legacy", "predict_legacy", "train_per_host", "predict", "test", "test_legacy", "live_grades",
    "graded", "load_model",
]
