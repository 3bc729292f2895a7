"""Message streams of all hosts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from hostgauge.functions.columns import whole_json
from hostgauge.operators.filters import complete, remote_sessions_only, without_collectors
from hostgauge.operators.ordered import running_total
from hostgauge.schemas import with_clock
from hostgauge.session import lookup_side, materialize
from hostgauge.sources.events import ENVELOPE_SCHEMA, decode_batches

# One trigger covers what the collectors flush: 100 events or 5 seconds.
TRIGGER = {"processingTime": "5 seconds"}
DRAIN = {"availableNow": True}


def file_messages(spark: SparkSession, path: str, fmt: str = "json", max_files: int | None = None) -> DataFrame:
    """Envelopes from a folder, oldest first; new files and hosts join as they come.

    A micro-batch takes all files that are there, or at most ``max_files``.
    """
    reader = spark.readStream.format(fmt).schema(ENVELOPE_SCHEMA)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def kafka_messages(
    spark: SparkSession, servers: str, pattern: str = r"events\..*", max_offsets: int | None = None
) -> DataFrame:
    """Envelopes from one topic per host, from the beginning. Needs the Kafka package."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribePattern", pattern)
        .option("startingOffsets", "earliest")
    )
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load().select(
        F.col("topic").alias("stream"),
        F.concat_ws("-", "partition", "offset").alias("msg_id"),
        F.col("timestamp").alias("ingest_ts"),
        F.col("value").cast("string").alias("data"),
    )


def _sized(messages: DataFrame) -> DataFrame:
    """``_n``: events in the message, complete or not."""
    events = F.try_variant_get(whole_json(F.col("data")), "$", "array<variant>")
    return messages.withColumn("_n", F.coalesce(F.when(events.isNotNull(), F.size(events)), F.lit(0)).cast("bigint"))


def numbered_messages(
    messages: DataFrame, first: int = 0, store: Callable[[DataFrame], DataFrame] = materialize
) -> DataFrame:
    """``_start``: the arrival number of a message's first event; ``_n``: its events.

    Numbers run without gaps from ``first`` on, by (time of arrival, stream, number of
    the message, position); so they are the same however the messages are split into
    batches, as long as earlier batches hold earlier messages. ``_start`` comes from
    counts per millisecond and stream, added up. Messages that repeat in all of that are numbered one after the other.
    """
    rows = store(_sized(messages).withColumn("_row", F.monotonically_increasing_id()))  # stored with its row numbers
    at = F.coalesce(F.unix_micros("ingest_ts"), F.lit(0))
    stream = F.coalesce("stream", F.lit(""))
    numbers = F.transform(F.split(F.coalesce("msg_id", F.lit("")), "-"), lambda p: p.try_cast("bigint"))
    keys = rows.select(
        "_row", "_n", at.alias("_at"), stream.alias("_stream"), numbers.alias("_numbers"), F.coalesce("msg_id", F.lit("")).alias("_id"),
        F.xxhash64("data").alias("_hash"),
    )
    order = [F.col(c) for c in ("_at", "_numbers", "_id", "_hash", "_row")]
    bins = [F.floor(F.col("_at") / 1_000_000), F.floor(F.col("_at") / 1000), F.col("_at"), F.col("_stream")]
    starts = running_total(keys, "_n", order, bins, out="_start", store=store)
    starts = starts.select("_row", (F.col("_start") + F.lit(first)).alias("_start"))
    return rows.join(lookup_side(store(starts)), "_row").drop("_row")


def arriving_events(
    messages: DataFrame, collectors: DataFrame | None = None, sessions: DataFrame | None = None, first: int = 0,
    time_col: str | None = None, store: Callable[[DataFrame], DataFrame] = materialize,
) -> DataFrame:
    """Decoded, complete events that the collectors would forward, with ``ts_us`` and ``seq``.

    ``seq`` is the number of arrival, from ``first`` on; events that are dropped leave
    gaps. ``time_col="ingest_ts"`` counts an event from when its message came in.
    """
    numbered = numbered_messages(messages, first, store)
    events = complete(decode_batches(numbered, ["_start"])).withColumn("seq", F.col("_start") + F.col("pos")).drop("pos", "_start")
    if collectors is not None:
        events = without_collectors(events, collectors)
    if sessions is not None:
        events = remote_sessions_only(events, sessions)
    if time_col is not None:
        return events.withColumn("ts_us", F.unix_micros(time_col))
    # an event without time counts from when its message came in
    return with_clock(events).withColumn("ts_us", F.coalesce("ts_us", F.unix_micros("ingest_ts")))
