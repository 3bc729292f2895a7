"""Table layouts shared by readers, operators and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

EVENT_SCHEMA = T.StructType([
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("processId", T.LongType()),
    T.StructField("threadId", T.LongType()),
    T.StructField("parentProcessId", T.LongType()),
    T.StructField("userId", T.LongType()),
    T.StructField("mountNamespace", T.LongType()),
    T.StructField("processName", T.StringType()),
    T.StructField("hostName", T.StringType()),
    T.StructField("eventId", T.IntegerType()),
    T.StructField("eventName", T.StringType()),
    T.StructField("stackAddresses", T.StringType()),
    T.StructField("argsNum", T.IntegerType()),
    T.StructField("returnValue", T.LongType()),
    T.StructField("args", T.StringType()),
    T.StructField("sus", T.IntegerType()),
    T.StructField("evil", T.IntegerType()),
])
EVENT_COLUMNS = EVENT_SCHEMA.names

# Columns read as numbers; text that is not a number becomes null.
NUMERIC_COLUMNS = [f.name for f in EVENT_SCHEMA if not isinstance(f.dataType, T.StringType)]

PROCESS_KEY = ["hostName", "userId", "processId"]
USER_KEY = ["hostname", "user_id"]


def present(df: DataFrame, *columns: str) -> bool:
    return all(c in df.columns for c in columns)


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}; available: {df.columns}")


def conform(df: DataFrame) -> DataFrame:
    """The 16 event columns with their types, absent ones as typed nulls."""
    cols = []
    for f in EVENT_SCHEMA:
        kind = f.dataType.simpleString()
        if f.name not in df.columns:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif f.name in NUMERIC_COLUMNS and kind != "double":
            # through double, so that text such as "1000.0" is read too
            as_is = F.expr(f"try_cast(`{f.name}` as {kind})")
            by_double = F.expr(f"try_cast(try_cast(`{f.name}` as double) as {kind})")
            cols.append(F.coalesce(as_is, by_double).alias(f.name))
        else:
            cols.append(F.expr(f"try_cast(`{f.name}` as {kind})").alias(f.name))
    extra = [F.col(c) for c in df.columns if c not in EVENT_COLUMNS]
    return df.select(*cols, *extra)


def with_clock(df: DataFrame) -> DataFrame:
    """Adds ``ts_us`` (whole microseconds) from the seconds in ``timestamp``."""
    return df.withColumn("ts_us", F.round(F.col("timestamp") * 1_000_000).cast("bigint"))
