"""Evaluation of scores and severities against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hostgauge.fixed_values import SWEEP_FROM, SWEEP_STEPS, SWEEP_TO
from hostgauge.operators.filters import require_labels
from hostgauge.operators.ordered import bin_by, quantile_array, rank_curve, side_by_side


def _ratio(top: Column, bottom: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return p, r, _ratio(2 * p * r, p + r)


def _cells(predicted: Column, prefix: str = "") -> list[Column]:
    evil = F.col("evil")
    cases = {
        "tn": (evil == 0) & ~predicted,
        "fp": (evil == 0) & predicted,
        "fn": (evil == 1) & ~predicted,
        "tp": (evil == 1) & predicted,
    }
    return [F.count_if(c).alias(prefix + k) for k, c in cases.items()]


def _with_metrics(df: DataFrame, prefix: str = "") -> DataFrame:
    p, r, f1 = precision_recall_f1(*[F.col(prefix + c) for c in ("tp", "fp", "fn")])
    return df.withColumns({prefix + "precision": p, prefix + "recall": r, prefix + "f1": f1})


def confusion(df: DataFrame) -> DataFrame:
    """One row per policy ("low_or_high": severity >= 1, "high_only": >= 2)."""
    require_labels(df)
    policies = F.array(
        F.struct(F.lit("low_or_high").alias("policy"), F.lit(1).alias("least")),
        F.struct(F.lit("high_only").alias("policy"), F.lit(2).alias("least")),
    )
    one_pass = df.agg(*_cells(F.col("severity") >= 1, "a_"), *_cells(F.col("severity") >= 2, "b_"))
    names = ["tn", "fp", "fn", "tp"]
    rows = one_pass.select(F.explode(policies).alias("p"), "*")
    picked = rows.select(
        "p.policy", *[F.when(F.col("p.least") == 1, F.col("a_" + n)).otherwise(F.col("b_" + n)).alias(n) for n in names]
    )
    return _with_metrics(picked)


def ranking(df: DataFrame, score: str = "normality_score", label: str = "evil") -> DataFrame:
    """One row (roc_auc, avg_precision) of the reversed score against the label.

    Ties count half in the AUC and as one step in the average precision. Null
    without positives, and the AUC also without negatives.
    """
    pos = F.col(label).cast("bigint")
    curve = rank_curve(df, score, {"pos": pos, "neg": 1 - pos})
    c = F.col
    beaten = c("neg_all") - c("neg_below") - c("neg")  # negatives with a higher score
    won = F.sum(c("pos") * (beaten + c("neg") / 2))
    reached = c("pos_below") + c("pos")
    precision_here = reached / (reached + c("neg_below") + c("neg"))
    stepped = F.sum(c("pos") * precision_here)
    p, n = F.max("pos_all"), F.max("neg_all")
    return curve.agg(
        F.when((p > 0) & (n > 0), won / (p.cast("double") * n)).alias("roc_auc"),
        F.when(p > 0, stepped / p).alias("avg_precision"),
    )


def test_report(df: DataFrame, score: str = "normality_score") -> DataFrame:
    """One row: size, positives, both confusions with their metrics, ranking."""
    require_labels(df)
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum("evil"), F.lit(0)).cast("bigint").alias("evil_count"),
        *_cells(F.col("severity") >= 1, "any_"),
        *_cells(F.col("severity") >= 2, "high_"),
    )
    counts = _with_metrics(_with_metrics(counts, "any_"), "high_")
    return side_by_side(counts, ranking(df, score))


def validation_report(df: DataFrame, score: str = "normality_score") -> DataFrame:
    """One row: entities, positives, rows, ranking."""
    per_entity = df.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.sum("evil").alias("evil"))
    size = per_entity.agg(
        F.count(F.lit(1)).alias("entities"),
        F.coalesce(F.sum("evil"), F.lit(0)).cast("bigint").alias("evil_count"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows"),
    )
    return side_by_side(size, ranking(df, score))


def sweep(df: DataFrame, score: str = "normality_score", steps: int = SWEEP_STEPS) -> DataFrame:
    """Precision, recall and F1 of "score < threshold" at evenly spaced percentiles.

    The percentiles are a fixed number of values, so they are fetched and used
    as literals; every row then only needs to know how many of them it is below.
    """
    require_labels(df)
    width = (SWEEP_TO - SWEEP_FROM) / (steps - 1)
    percentiles = [SWEEP_FROM + i * width for i in range(steps)]
    row = quantile_array(df, score, [p / 100 for p in percentiles]).first()
    if not row["n_scores"]:
        raise ValueError("no scores to sweep")
    thresholds = row["quantiles"]

    # rows of bin b are positive for the candidates b, b + 1, ...
    bins = (
        df.where(F.col(score).isNotNull())
        .groupBy(bin_by(F.col(score), thresholds).alias("step"))
        .agg(F.sum("evil").alias("pos"), F.count(F.lit(1)).alias("n"))
    )
    candidates = df.sparkSession.createDataFrame(
        [(i, percentiles[i], thresholds[i]) for i in range(steps)] + [(steps, None, None)],
        "step int, percentile double, threshold double",
    )
    up_to = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    filled = candidates.join(bins, "step", "left").fillna(0, ["pos", "n"])
    cells = filled.select(
        "step", "percentile", "threshold",
        F.sum("pos").over(up_to).alias("tp"),
        (F.sum("n").over(up_to) - F.sum("pos").over(up_to)).alias("fp"),
        (F.sum("pos").over(everything) - F.sum("pos").over(up_to)).alias("fn"),
    )
    return _with_metrics(cells).where(F.col("step") < steps)


def pick_threshold(swept: DataFrame, metric: str = "f1") -> DataFrame:
    """The row of the first threshold that reaches the best value of ``metric``."""
    if metric not in ("f1", "precision", "recall"):
        raise ValueError(f"no threshold can be picked by {metric!r}")
    return swept.orderBy(F.desc(metric), "step").limit(1)


def single_threshold_report(df: DataFrame, threshold: float, score: str = "normality_score", name: str = "test") -> DataFrame:
    """One row: confusion and metrics of "score < threshold", ranking, size."""
    require_labels(df)
    counts = df.agg(F.count(F.lit(1)).alias("n"), *_cells(F.col(score) < threshold))
    counts = _with_metrics(counts).withColumns({"threshold": F.lit(float(threshold)), "name": F.lit(name)})
    return side_by_side(counts, ranking(df, score))
