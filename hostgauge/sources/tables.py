"""The generic ``events`` table read as host telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hostgauge.functions.text import ntz_to_micros
from hostgauge.schemas import EVENT_SCHEMA

EVENT_NAMES = {"click": "openat", "view": "close", "purchase": "connect", "error": "execve", "signup": "security_file_open"}
EVENT_IDS = {"openat": 257, "close": 3, "connect": 42, "execve": 59, "security_file_open": 1000}
PROCESS_NAMES = ["bash", "python3", "id", "nmap", "curl", "sudo", "sshd", "snapd"]
ARG_VALUES = ["/etc/shadow", "/home/u/.aws/credentials", "../../x", "ls | wc", "http://10.0.0.1/a", "/tmp/a"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choose(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _case(column: str, mapping: dict) -> Column:
    keys = list(mapping)
    out = F.when(F.col(column) == keys[0], F.lit(mapping[keys[0]]))
    for k in keys[1:]:
        out = out.when(F.col(column) == k, F.lit(mapping[k]))
    return out


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_telemetry(table(spark, sf_dir, "events"))


def telemetry_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return as_telemetry(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*"))


def as_telemetry(events: DataFrame) -> DataFrame:
    """``events`` in the event layout, plus ``ts_us``, ``seq`` and ``value``."""
    e = events.select(
        F.col("event_id").alias("seq"),
        ntz_to_micros("ts").alias("ts_us"),
        F.col("user_id").alias("userId"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    error = F.col("event_type") == "error"
    process = F.col("userId") * 10 + F.col("k") % 2
    e = e.select(
        (F.col("ts_us") / 1_000_000).alias("timestamp"),
        process.alias("processId"),
        (process + F.when(F.col("seq") % 10 == 0, 1).otherwise(0)).alias("threadId"),
        F.col("userId").alias("parentProcessId"),
        "userId",
        (F.lit(4026531840).cast("bigint") + F.col("userId") % 6).alias("mountNamespace"),
        _choose(F.col("k") % 8, PROCESS_NAMES).alias("processName"),
        F.concat(F.lit("host-"), (F.col("userId") % 7).cast("string")).alias("hostName"),
        _case("event_type", EVENT_NAMES).alias("eventName"),
        F.lit("[]").alias("stackAddresses"),
        (F.col("k") % 5).alias("argsNum"),
        F.when(error, F.lit(-13).cast("bigint")).otherwise(F.floor("value")).alias("returnValue"),
        F.concat(
            F.lit('[{"name":"p","type":"t","value":"'), _choose(F.col("k") % 6, ARG_VALUES), F.lit('"}]')
        ).alias("args"),
        error.cast("int").alias("sus"),
        (error & (F.col("value") > 20)).cast("int").alias("evil"),
        "ts_us",
        "seq",
        "value",
    ).withColumn("eventId", _case("eventName", EVENT_IDS))
    return e.select(*EVENT_SCHEMA.names, "ts_us", "seq", "value")


def with_surrogate_score(df: DataFrame, name: str = "normality_score") -> DataFrame:
    """A score that needs no forest, for exact checks of what follows scoring."""
    return df.withColumn(
        name, F.lit(0.2) - F.col("value") / 500 - F.when(F.col("sus") == 1, 0.1).otherwise(0.0)
    )
