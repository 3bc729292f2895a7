"""A trained model as Parquet tables in one folder."""

from __future__ import annotations

import json
import warnings
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from hostgauge.fixed_values import FEATURES, HIGH_PERCENTILE, LOW_PERCENTILE
from hostgauge.operators.isolation_forest import Forest
from hostgauge.operators.model_stats import scaler_dict

TABLES = ["forest_nodes", "scaler_stats", "freq_tables", "thresholds", "model_meta"]


@dataclass
class Meta:
    psi: int
    offset: float
    global_low: float
    global_high: float
    global_n_scores: int
    features: list[str] = field(default_factory=lambda: list(FEATURES))
    user_col: str = "userId"
    host_col: str | None = None
    group_mode: str = "user"
    low_percentile: float = LOW_PERCENTILE
    high_percentile: float = HIGH_PERCENTILE

    @property
    def overall(self) -> dict[str, float]:
        return {"low": self.global_low, "high": self.global_high}


@dataclass
class Model:
    meta: Meta
    forest: Forest
    scaler: dict[str, tuple[float, float]]
    freq_tables: DataFrame
    thresholds: DataFrame


def save_table(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes one model table and returns it as read back."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def save_meta(spark: SparkSession, meta: Meta | dict, folder: str) -> None:
    values = meta if isinstance(meta, dict) else asdict(meta)
    one = spark.createDataFrame([(json.dumps(values),)], "meta string")
    save_table(one.coalesce(1), folder, "model_meta")


def load_meta(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.parquet(f"{folder}/model_meta").first()["meta"])


def load_model(spark: SparkSession, folder: str) -> Model:
    """All tables but frequencies and thresholds have a size the parameters fix."""
    t = {name: spark.read.parquet(f"{folder}/{name}") for name in TABLES}
    meta = Meta(**load_meta(spark, folder))
    check_features(meta)
    forest = Forest.from_nodes(t["forest_nodes"].toPandas(), meta.psi, meta.offset)
    return Model(meta, forest, scaler_dict(t["scaler_stats"]), t["freq_tables"], t["thresholds"])


def check_features(meta: Meta) -> bool:
    """A model of other features is reported, not refused."""
    if list(meta.features) == FEATURES:
        return True
    warnings.warn(f"the model has {len(meta.features)} features, this engine {len(FEATURES)}; train it again")
    return False
