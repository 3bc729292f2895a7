"""Session and small helpers that act at plan-building time."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

# A lookup side is broadcast up to this many rows (a few columns each, so well
# under 100 MB); above it the join shuffles and AQE splits skewed keys.
BROADCAST_ROWS = 1_000_000


def build_session(app: str = "hostgauge", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # stored intermediate results go once nothing refers to them any more
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is named, a local run takes a temporary one; a cluster refuses."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="hostgauge-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def lookup_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a stored lookup table for broadcast if its counted size allows it.

    Give it stored rows (a read table or ``materialize``), as it counts them.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df
