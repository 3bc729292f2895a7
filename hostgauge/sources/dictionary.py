"""Names and numbers of kernel events. The dictionary is a parameter: a stored table or a kernel header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hostgauge.fixed_values import HOOK_EVENT_IDS
from hostgauge.session import lookup_side

SCHEMA = "event_name string, event_id int"


def with_hooks(calls: DataFrame) -> DataFrame:
    """``calls`` and the kernel hooks, whose names and numbers are the project's own."""
    hooks = calls.sparkSession.createDataFrame(list(HOOK_EVENT_IDS.items()), SCHEMA)
    return calls.select("event_name", "event_id").unionByName(hooks).distinct()


def stored_dictionary(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A table of event_name and event_id, with the hooks."""
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    rows = reader.format(fmt).load(path)
    calls = rows.select(F.lower("event_name").alias("event_name"), F.col("event_id").try_cast("int").alias("event_id"))
    return with_hooks(calls.dropna())


def syscall_dictionary(spark: SparkSession, header: str) -> DataFrame:
    """All system calls that a kernel header (``unistd_64.h``, on shared storage) numbers, with the hooks."""
    define = r"^\s*#define\s+__NR_(\w+)\s+(\d+)"
    lines = spark.read.text(header).where(F.col("value").rlike(define))
    calls = lines.select(
        F.lower(F.regexp_extract("value", define, 1)).alias("event_name"),
        F.regexp_extract("value", define, 2).try_cast("int").alias("event_id"),
    )
    return with_hooks(calls.dropna())


def learned_dictionary(events: DataFrame) -> DataFrame:
    """The names and ids an event table already holds."""
    return (
        events.select(F.lower("eventName").alias("event_name"), F.col("eventId").cast("int").alias("event_id"))
        .dropna()
        .groupBy("event_name")
        .agg(F.min("event_id").alias("event_id"))
    )


def unnamed(event_id: Column) -> Column:
    return F.concat(F.lit("syscall_"), event_id.cast("string"))


def with_event_id(df: DataFrame, dictionary: DataFrame, name: str = "eventName", out: str = "eventId") -> DataFrame:
    """Id of the lower-cased name, 0 for unknown names."""
    side = lookup_side(dictionary.select(F.col("event_name").alias("__name"), F.col("event_id").alias("__id")))
    return (
        df.withColumn("__name", F.lower(name))
        .join(side, "__name", "left")
        .withColumn(out, F.coalesce("__id", F.lit(0)))
        .drop("__name", "__id")
    )


def with_event_name(df: DataFrame, dictionary: DataFrame, event_id: str = "eventId", out: str = "eventName") -> DataFrame:
    """Name of the id, ``syscall_<id>`` for unknown ids."""
    names = dictionary.groupBy(F.col("event_id").alias("__id")).agg(F.min("event_name").alias("__name"))
    return (
        df.withColumn("__id", F.col(event_id))
        .join(lookup_side(names), "__id", "left")
        .withColumn(out, F.coalesce("__name", unnamed(F.col(event_id))))
        .drop("__id", "__name")
    )
