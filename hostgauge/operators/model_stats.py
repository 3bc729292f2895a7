"""What training learns besides the forest: frequencies, scaling, thresholds, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hostgauge.fixed_values import (
    FALLBACK_HIGH, FALLBACK_LOW, FEATURES, HIGH_PERCENTILE, LOW_PERCENTILE, SCORES_PER_ENTITY, SEED, TRAIN_SAMPLE,
)
from hostgauge.functions.event_features import folded_name
from hostgauge.functions.severity import severity
from hostgauge.operators.ordered import exact_quantiles, first_rows, hash_bin, row_hash, with_random_rank
from hostgauge.session import lookup_side

FREQUENCY_KEYS = {
    "eventId": lambda: F.col("eventId").cast("bigint").cast("string"),
    "mountNamespace": lambda: F.col("mountNamespace").cast("bigint").cast("string"),
    "processName": folded_name,
}


def frequency_tables(benign_rows: DataFrame) -> DataFrame:
    """(table_name, key, log_count) for the three categorical columns, in one pass.

    Null ids are not counted; a null name counts as "".
    """
    pairs = F.array(*[
        F.struct(F.lit(name).alias("table_name"), key().alias("key")) for name, key in FREQUENCY_KEYS.items()
    ])
    return (
        benign_rows.select(F.explode(pairs).alias("p"))
        .select("p.table_name", "p.key")
        .where(F.col("key").isNotNull())
        .groupBy("table_name", "key")
        .agg(F.log1p(F.count(F.lit(1))).alias("log_count"))
    )


def with_frequencies(df: DataFrame, tables: DataFrame) -> DataFrame:
    """``<column>_freq`` for the three columns, 0 for values not in the tables.

    ``tables`` are stored rows: each side is counted before it is broadcast.
    """
    for name, key in FREQUENCY_KEYS.items():
        out = f"{name}_freq"
        if name not in df.columns:
            df = df.withColumn(out, F.lit(0.0))
            continue
        side = lookup_side(
            tables.where(F.col("table_name") == name).select(F.col("key").alias("_key"), F.col("log_count").alias(out))
        )
        df = (
            df.withColumn("_key", key())
            .join(side, "_key", "left")
            .drop("_key")
            .withColumn(out, F.coalesce(out, F.lit(0.0)))
        )
    return df


def scaler_statistics(features: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    """(feature, mean, std): population std, with 1 in place of 0."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    one = features.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__std").alias("std"))
        for c in columns
    ])
    return (
        one.select(F.explode(rows).alias("s")).select("s.*")
        .withColumn("std", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")))
    )


def scaled(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """(x - mean) / std for each feature of ``stats``, as expressions with literals."""
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()})


def scaler_dict(stats: DataFrame) -> dict[str, tuple[float, float]]:
    """One row per feature, so a fixed 22 rows."""
    return {r["feature"]: (r["mean"], r["std"]) for r in stats.collect()}


# -- samples -----------------------------------------------------------------------


def uniform_sample(df: DataFrame, key: list[str], k: int = TRAIN_SAMPLE, seed: int = SEED) -> DataFrame:
    """At most ``k`` rows, each equally likely; the rows with the smallest hashes."""
    return with_random_rank(df, key, seed, rank="_rank", limit=k).drop("_rank")


def capped_per_entity(
    df: DataFrame, key: list[str], cap: int = SCORES_PER_ENTITY, seed: int = SEED, entity: str | None = "entity"
) -> DataFrame:
    """At most ``cap`` rows per entity (or overall), a uniform sample of each."""
    rows = df.withColumn("_h", row_hash(key, seed))
    groups = [entity] if entity else []
    return first_rows(rows, cap, [F.col("_h"), *[F.col(c) for c in key]], [hash_bin(F.col("_h")), hash_bin(F.col("_h"), 24)], groups).drop("_h")


# -- thresholds ----------------------------------------------------------------------


def _probs(low: float, high: float) -> dict[str, float]:
    return {"low": low / 100, "high": high / 100}


def entity_thresholds(
    scores: DataFrame, low: float = LOW_PERCENTILE, high: float = HIGH_PERCENTILE, score: str = "normality_score"
) -> DataFrame:
    """(entity, low, high, n_scores)."""
    return exact_quantiles(scores, score, _probs(low, high), ["entity"])


def global_thresholds(
    scores: DataFrame, low: float = LOW_PERCENTILE, high: float = HIGH_PERCENTILE, score: str = "normality_score"
) -> DataFrame:
    """One row (low, high, n_scores)."""
    return exact_quantiles(scores, score, _probs(low, high))


def override_global(
    thresholds: dict[str, float] | None, low: float | None = None, high: float | None = None
) -> dict[str, float]:
    """The operator's values replace the model's global ones, never an entity's."""
    t = thresholds or {}
    return {
        "low": float(low if low is not None else t.get("low", FALLBACK_LOW)),
        "high": float(high if high is not None else t.get("high", FALLBACK_HIGH)),
    }


def with_thresholds(df: DataFrame, per_entity: DataFrame, overall: dict[str, float], per_field: bool = False) -> DataFrame:
    """``low_threshold`` and ``high_threshold`` by entity, else the global ones.

    In training an entity's row is used whole, so its null stays (no severity);
    serving falls back field by field (``per_field``).
    """
    side = lookup_side(per_entity.select("entity", F.col("low").alias("_low"), F.col("high").alias("_high"), F.lit(True).alias("_known")))
    joined = df.join(side, "entity", "left")

    def pick(own: str, fallback: float) -> Column:
        if per_field:
            return F.coalesce(own, F.lit(fallback))
        return F.when(F.col("_known"), F.col(own)).otherwise(F.lit(fallback))

    return joined.withColumns({
        "low_threshold": pick("_low", overall["low"]),
        "high_threshold": pick("_high", overall["high"]),
    }).drop("_low", "_high", "_known")


def with_severity(df: DataFrame, score: str = "normality_score") -> DataFrame:
    return df.withColumn("severity", severity(F.col(score), F.col("low_threshold"), F.col("high_threshold")))
