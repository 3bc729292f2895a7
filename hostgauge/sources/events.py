"""Event and prediction tables on storage, and message envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from hostgauge.functions.columns import whole_json
from hostgauge.operators.filters import complete
from hostgauge.schemas import EVENT_COLUMNS, EVENT_SCHEMA, NUMERIC_COLUMNS, conform
from hostgauge.session import lookup_side, materialize

# the writer would else cut white space off the ends of fields
_CSV_OUT = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
ENVELOPE_SCHEMA = "stream string, msg_id string, ingest_ts timestamp, data string"


def _escaped(df: DataFrame) -> DataFrame:
    """Text columns with each backslash doubled and line breaks as a backslash and a letter."""

    def shown(c: str) -> Column:
        out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
        return F.replace(F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))

    return df.withColumns({f.name: shown(f.name) for f in df.schema.fields if f.dataType == T.StringType()})


def _unescaped(df: DataFrame) -> DataFrame:
    def plain(c: str) -> Column:
        # doubled backslashes first, so that what is between them holds escapes only
        parts = F.transform(
            F.split(c, r"\\\\", -1),
            lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")),
        )
        return F.when(F.col(c).isNotNull(), F.array_join(parts, "\\"))

    return df.withColumns({c: plain(c) for c in df.columns})


def read_events(
    spark: SparkSession, path: str, fmt: str = "parquet", strict: list[str] | None = None, escaped: bool = False,
    numbered: bool = False,
) -> DataFrame:
    """Event table with the 16 columns; absent ones are null, bad numbers too.

    Rows without eventId or mountNamespace are dropped, as far as the table has
    these columns. ``strict`` names columns that must exist and be complete.

    CSV fields may hold line breaks, so one task reads a CSV file. Files that
    ``write_events`` wrote ``escaped`` hold none and are read in parts.

    ``numbered`` adds ``seq``: 0, 1, 2, ... through the files by name and each file from
    its top (so it tells rows of one time stamp apart); a ``seq`` in the table goes. The
    numbers do not depend on how the files are split among tasks.
    """
    if fmt == "csv":
        # all as text, so that a bad number costs its cell and not the row
        raw = spark.read.option("header", True).option("escape", '"').option("multiLine", not escaped).csv(path)
        raw = _unescaped(raw) if escaped else raw
    else:
        raw = spark.read.format(fmt).load(path)
    if numbered:  # before any row is dropped, so that every use of the table sees the same numbers
        raw = _numbered(raw)
    return tidy_events(raw, strict)


def _numbered(raw: DataFrame) -> DataFrame:
    """``seq`` by file, block of the file and place in the block.

    Rows of a block are read in order by one task, so their distance from its first
    row is their place. The rows per block are counted first and added up over all files.
    """
    block = ["_file", "_block"]
    placed = raw.drop("seq").select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    counts = placed.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    # a row per block, as the driver lists them anyway
    before = F.sum("_n").over(Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*block, "_first", F.coalesce(before, F.lit(0)).alias("_start"))
    found = placed.join(lookup_side(materialize(starts)), block)
    return found.withColumn("seq", F.col("_start") + F.col("_id") - F.col("_first")).drop(*block, "_id", "_first", "_start")


def tidy_events(raw: DataFrame, strict: list[str] | None = None) -> DataFrame:
    needed = [c for c in ("eventId", "mountNamespace") if c in raw.columns]
    if strict:
        missing = [c for c in strict if c not in raw.columns]
        if missing:
            raise ValueError(f"missing columns: {missing}")
        needed = list(strict)
    return complete(conform(raw), needed)


def missing_columns(df: DataFrame) -> list[str]:
    """Event columns the table lacks; features that need them get their default."""
    return [c for c in EVENT_COLUMNS if c not in df.columns]


def host_from_file(path: Column) -> Column:
    base = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(base, r"\.(csv|CSV)$", "")


def with_host_from_path(df: DataFrame) -> DataFrame:
    """``hostName`` from the name of the file a row was read from."""
    return df.withColumn("hostName", host_from_file(F.col("_metadata.file_name")))


def write_events(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", escaped: bool = False) -> None:
    """The 16 columns in order; CSV with header (``escaped``: no line break inside a field), Parquet partitioned by host."""
    out = df.select(*EVENT_COLUMNS)
    if fmt == "csv":
        out = _escaped(out) if escaped else out
        out.write.mode(mode).options(**_CSV_OUT).csv(path)
    else:
        out.write.mode(mode).partitionBy("hostName").format(fmt).save(path)


def write_predictions(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.options(**_CSV_OUT)
    writer.format(fmt).save(path)


# -- envelopes -----------------------------------------------------------------------


def stream_host(stream: Column) -> Column:
    """The host of a stream ``events.<host>``; only the leading prefix goes."""
    return F.regexp_replace(stream, r"^events\.", "")


def _field(event: Column, f: T.StructField) -> Column:
    if f.name in NUMERIC_COLUMNS:
        return F.try_variant_get(event, f"$.{f.name}", f.dataType.simpleString())
    # text stays as it is, lists (such as args) become their JSON text
    return F.try_variant_get(event, f"$.{f.name}", "string")


def decode_batches(messages: DataFrame, keep: list[str] = ()) -> DataFrame:
    """One row per event of each message, next to ``keep`` columns of the message; its host is the stream's.

    Messages that are no JSON array, and empty arrays, give no rows. ``seq`` is
    the event's position within ``msg_id``.
    """
    events = F.try_variant_get(whole_json(F.col("data")), "$", "array<variant>")
    exploded = messages.select(
        stream_host(F.col("stream")).alias("_host"), "msg_id", "ingest_ts", *keep, F.posexplode(events).alias("pos", "_event")
    )
    cols = [_field(F.col("_event"), f).alias(f.name) for f in EVENT_SCHEMA if f.name != "hostName"]
    picked = exploded.select("_host", "msg_id", "ingest_ts", "pos", *keep, *cols)
    return picked.withColumnRenamed("_host", "hostName").select(*EVENT_COLUMNS, "msg_id", "ingest_ts", "pos", *keep)


def encode_batches(events: DataFrame, batch: Column) -> DataFrame:
    """The reverse: messages of the events that share a host and ``batch``."""
    cols = [c for c in EVENT_COLUMNS]
    body = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.struct(*cols).alias("e")))), lambda s: s["e"])
    return (
        events.withColumn("_batch", batch)
        .groupBy("hostName", "_batch")
        .agg(F.to_json(body).alias("data"), F.max("ts_us").alias("_us"))
        .select(
            F.concat(F.lit("events."), "hostName").alias("stream"),
            F.col("_batch").cast("string").alias("msg_id"),
            F.timestamp_micros("_us").alias("ingest_ts"),
            "data",
        )
    )
