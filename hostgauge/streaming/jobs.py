"""The chained streams: messages -> events -> scores -> alerts.

Every stage publishes its micro-batch once (see ``tables``): a batch that is repeated
after a restart finds its folder and leaves it alone, so no stage loses or doubles
rows. The next stage reads the batches as a stream. With ``keep`` a stage holds its
table to a number of newest rows per host.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from hostgauge.fixed_values import DRIFT_SAMPLE, FEATURES, RETAIN_COMMANDS, RETAIN_EVENTS, RETAIN_SCORES
from hostgauge.functions.event_features import entity_key, with_scalar_features, zero_if_null
from hostgauge.functions.text import trigger_text
from hostgauge.operators.model_stats import with_frequencies
from hostgauge.operators.monitor import drift_of_parts, drift_part
from hostgauge.operators.sessions import events_in_sessions
from hostgauge.plans.jobs import LIVE_COLUMNS, Steps, live_grades, with_scores
from hostgauge.schemas import EVENT_SCHEMA, USER_KEY
from hostgauge.session import lookup_side
from hostgauge.sources.model_store import Model
from hostgauge.sources.storage import Storage
from hostgauge.streaming.source import TRIGGER, arriving_events
from hostgauge.streaming.state import (
    CROSSING_SCHEMA, REVISION_SCHEMA, ROCKSDB, ROLLING_COLUMNS, stream_alert_revisions, stream_rolling_features,
)
from hostgauge.streaming.tables import BatchTable, Keep

EVENT_TABLE = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in EVENT_SCHEMA) + (
    ", msg_id string, ingest_ts timestamp, seq bigint, ts_us bigint"
)
SCORE_TABLE = (
    "raw_score double, severity int, is_anomaly boolean, userId bigint, processName string, eventName string, "
    "hostname string, severity_capped_at int, user_id bigint, ts_us bigint, seq bigint"
)
ALERT_TABLE = CROSSING_SCHEMA + ", `trigger` string"
CORRECTION_TABLE = REVISION_SCHEMA + ", `trigger` string"
# as many rows as a stream of one host holds
KEEP_SCORES = Keep(RETAIN_SCORES)
KEEP_EVENTS = Keep(RETAIN_EVENTS, ("hostName",))
KEEP_ALERTS = Keep(RETAIN_COMMANDS)
# how far behind the newest event of the batches before a row may come; later rows go to the side table
LATENESS_S = 120
_SCORING_DELAY = "10 minutes"  # more than LATENESS_S, so that scoring drops nothing that ingest let pass

_STARTING = threading.Lock()  # two streams that start at once must not mix up the settings


def write_batch(df: DataFrame, path: str, batch_id: int) -> bool:
    """Publishes a micro-batch once; false if it was published before."""
    return BatchTable(df.sparkSession, path, "").publish(df, batch_id)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stage's table as batch rows; ``batch_id`` is a column."""
    return BatchTable(spark, path, schema).rows()


def stream_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return BatchTable(spark, path, schema).stream().drop("batch_id")


def prepare(spark: SparkSession, path: str, schema: str) -> None:
    """An empty table, so that later stages can start first."""
    BatchTable(spark, path, schema).prepare()


def _start(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict) -> StreamingQuery:
    return start_stream(df.writeStream.foreachBatch(each), checkpoint, trigger, df.sparkSession)


def start_stream(writer: DataStreamWriter, checkpoint: str, trigger: dict, spark: SparkSession | None = None) -> StreamingQuery:
    """Starts with state in RocksDB. A batch without rows follows where the watermark has moved, so that
    state whose time has come goes without waiting for more data."""
    conf = (spark or SparkSession.active()).conf
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "true"}
    with _STARTING:
        before = {name: conf.get(name) for name in wanted}
        for name, value in wanted.items():
            conf.set(name, value)
        try:
            # the stream keeps a copy of the settings it was started with
            return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()
        finally:
            for name, value in before.items():
                conf.set(name, value)


def _advance(batch: DataFrame) -> None:
    """Runs a batch whose rows are stored already, as its state is not."""
    batch.write.format("noop").mode("overwrite").save()


def _bounded(table: BatchTable, keep: Keep | None, batch_id: int, consumed: Callable[[], int] | None = None) -> None:
    """Compacts every ``keep.every`` batches. Batches go once ``consumed()`` says that later stages have read them."""
    if keep is not None and (batch_id + 1) % keep.every == 0:
        table.compact(keep)
        if consumed is not None:
            table.vacuum(consumed())


# -- ingest ----------------------------------------------------------------------------


class Marks:
    """What is known once a batch is through: ``events`` numbered, newest time ``max_us``, sessions used (``sessions_us``).

    Written before the batch is published, and never again, so a repeated batch finds
    the marks that it had. Older marks go.
    """

    START = {"events": 0, "max_us": None, "sessions_us": None}

    def __init__(self, spark: SparkSession, path: str):
        self._storage = Storage(spark, path)

    def get(self, batch_id: int) -> dict | None:
        if batch_id < 0:
            return self.START
        return self._storage.read_json(f"_marks/{batch_id}") if self._storage.exists(f"_marks/{batch_id}") else None

    def put(self, batch_id: int, marks: dict) -> dict:
        self._storage.write_json(f"_marks/{batch_id}", marks, f"_staged/marks-{batch_id}")
        if self._storage.exists(f"_marks/{batch_id - 100}"):
            self._storage.delete(f"_marks/{batch_id - 100}")
        return self.get(batch_id)


def start_ingest(
    messages: DataFrame, events_path: str, checkpoint: str, trigger: dict = TRIGGER,
    collectors: Callable[[], DataFrame] | None = None, sessions: Callable[[], DataFrame] | None = None,
    session_log: Callable[[], DataFrame] | None = None, late_path: str | None = None, lateness_s: float = LATENESS_S,
    time_col: str | None = None, keep: Keep | None = None, consumed: Callable[[], int] | None = None,
) -> StreamingQuery:
    """Messages to the event table.

    ``sessions`` and ``collectors`` are read anew for every batch. ``session_log``
    gives dated snapshots (hostName, taken_us, userId) instead: an event is judged by
    the snapshot in force at its time, and a repeated batch by the snapshots it had.
    With ``late_path`` rows that lie more than ``lateness_s`` behind the newest event of earlier batches go to
    that table instead. ``time_col="ingest_ts"`` times events by their arrival.
    """
    spark = messages.sparkSession
    table = BatchTable(spark, events_path, EVENT_TABLE)
    table.prepare()
    late = BatchTable(spark, late_path, EVENT_TABLE) if late_path else None
    if late is not None:
        late.prepare()
    marks = Marks(spark, events_path)

    def each(batch: DataFrame, batch_id: int) -> None:
        if table.published(batch_id):
            return
        before = marks.get(batch_id - 1)
        if before is None:
            raise RuntimeError(f"{events_path}: nothing is known of the batch before {batch_id}")
        with Steps(spark) as steps:
            names = iter(range(1 << 30))

            def store(df: DataFrame) -> DataFrame:
                return steps.stored(df, f"step{next(names)}")

            events = store(arriving_events(
                batch, collectors() if collectors else None, sessions() if sessions else None, before["events"], time_col, store
            ))
            found = marks.get(batch_id)
            if found is None:
                n, newest = batch_size(steps), events.agg(F.max("ts_us")).first()[0]
                known = [t for t in (before["max_us"], newest) if t is not None]
                log = session_log().agg(F.max("taken_us")).first()[0] if session_log else None
                found = marks.put(batch_id, {
                    "events": before["events"] + n, "max_us": max(known, default=None), "sessions_us": log,
                })
            if session_log:
                known = session_log().where(F.col("taken_us") <= F.lit(found["sessions_us"]))
                events = store(events_in_sessions(events, known, store))
            if late is not None:
                oldest = None if before["max_us"] is None else before["max_us"] - int(lateness_s * 1_000_000)
                behind = F.lit(False) if oldest is None else F.coalesce(F.col("ts_us") < oldest, F.lit(False))
                late.publish(events.where(behind), batch_id)
                events = events.where(~behind)
            table.publish(events, batch_id)
        _bounded(table, keep, batch_id, consumed)

    def batch_size(steps: Steps) -> int:
        """Events of the batch's messages, complete or not; the messages are the first thing that is stored."""
        return spark.read.parquet(f"{steps.folder}/step0").agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]

    return _start(messages, each, checkpoint, trigger)


# -- scoring ---------------------------------------------------------------------------


def score_stream(events: DataFrame, model: Model, delay: str = _SCORING_DELAY, **rolling) -> DataFrame:
    """Scores of an event stream, without the text of the events: the scalar features are worked out first, and only
    numbers go through the rolling state. ``events`` may have ``batch_id``, the batch where its text is found."""
    rows = with_frequencies(with_scalar_features(events), model.freq_tables)
    wanted = {"hostName", "userId", "processId", "ts_us", "seq", "batch_id", "eventId", "argsNum", "returnValue", *FEATURES}
    rows = rows.select(*[c for c in rows.columns if c in wanted - set(ROLLING_COLUMNS)])
    rows = stream_rolling_features(rows, delay=delay, **rolling)
    rows = rows.withColumns({c: zero_if_null(c) for c in ("argsNum", "returnValue")})
    kept = [c for c in ("hostName", "userId", "ts_us", "seq", "batch_id") if c in rows.columns]
    return with_scores(rows, model, "raw_score").select(*kept, "raw_score")


def graded_live(scores: DataFrame, texts: DataFrame, model: Model, override: tuple = (None, None)) -> DataFrame:
    """``SCORE_TABLE`` rows: the scores, the names from the events they belong to (``batch_id``, ``seq``), and grades."""
    m = model.meta
    names = dict.fromkeys(["processName", "eventName", m.user_col, m.host_col or "hostName"])
    names = [c for c in names if c in texts.columns and c not in scores.columns]
    named = scores.join(texts.select("batch_id", "seq", *names), ["batch_id", "seq"])
    rows = named.withColumns({
        "entity": entity_key(m.group_mode, m.user_col, m.host_col or "hostName"), "hostname": F.col("hostName"),
    })
    grades = live_grades(rows, model.thresholds, m.overall, override)
    return grades.select(*LIVE_COLUMNS, F.col("userId").alias("user_id"), "ts_us", "seq")


def start_scoring(
    events_path: str, model: Model, scores_path: str, checkpoint: str, trigger: dict = TRIGGER,
    drift_path: str | None = None, feed_path: str | None = None, override: tuple = (None, None),
    keep: Keep | None = None, feed_keep: Keep | None = None, consumed: Callable[[], int] | None = None,
    spark: SparkSession | None = None, drift_sample: int = DRIFT_SAMPLE, **options,
) -> StreamingQuery:
    """The event table to the score table; on request also to a feed and to drift figures.

    A batch's scores are worked out once, into a table of its own that goes when the
    batch is through; the names come from the batches of events that it was read from.
    """
    spark = spark or SparkSession.active()
    source = BatchTable(spark, events_path, EVENT_TABLE)
    table = BatchTable(spark, scores_path, SCORE_TABLE)
    table.prepare()
    feed = BatchTable(spark, feed_path, SCORE_TABLE) if feed_path else None

    def each(batch: DataFrame, batch_id: int) -> None:
        if table.published(batch_id):
            _advance(batch)
        else:
            with Steps(spark) as steps:
                scores = steps.stored(batch, "scores")
                parts = [r[0] for r in scores.select("batch_id").distinct().collect()]  # batches of events
                table.publish(graded_live(scores, source.of_batches(parts), model, override), batch_id)
        stored = table.of_batches([batch_id]).drop("batch_id")
        if feed is not None:
            feed.publish(stored, batch_id)
            _bounded(feed, feed_keep, batch_id, lambda: batch_id)
        if drift_path:
            g = model.meta.overall
            publish_drift(spark, table, drift_path, batch_id, g["low"], g["high"], model.meta, drift_sample)

        def read() -> int:
            ring = _ring_start(spark, drift_path)
            return consumed() if ring is None else min(consumed(), ring - 1)

        _bounded(table, keep, batch_id, read if consumed is not None else None)

    return _start(score_stream(source.stream(), model, **options), each, checkpoint, trigger)


DRIFT_PART = (
    "n bigint, mean double, m2 double, least double, most double, below_low bigint, below_high bigint, from_batch bigint"
)


def publish_drift(
    spark: SparkSession, scores: BatchTable, path: str, batch_id: int, low: float, high: float, meta, sample: int = DRIFT_SAMPLE
) -> None:
    """The drift figures of the newest scores by arrival, after ``batch_id``.

    Of every batch there is one row of sums, kept in a ring; the figures are the sums of
    the batches that the sample covers whole, and of the oldest one, which alone is read again, its newest rows.
    """
    parts, out = BatchTable(spark, f"{path}/_parts", DRIFT_PART), BatchTable(spark, path, "")
    if out.published(batch_id):
        return
    before = parts.batches()
    start = parts.of_batches(before[-1:]).first()["from_batch"] if before else 0
    ring = [b for b in before if start <= b < batch_id]
    own = drift_part(scores.of_batches([batch_id]), low, high).first().asDict()
    rows = {r["batch_id"]: r.asDict() for r in parts.of_batches(ring).collect()} | {batch_id: own}  # a row per batch of the ring
    whole, left = [], sample
    for b in sorted(rows, reverse=True):
        if not left:
            break
        start = b
        if rows[b]["n"] > left:  # the oldest batch that is still in the sample, in part
            newest = scores.of_batches([b]).where("raw_score is not null").orderBy(F.desc("seq")).limit(left)
            whole.append(drift_part(newest, low, high).first().asDict())
            break
        whole.append(rows[b])
        left -= rows[b]["n"]
    names = [c.split(" ")[0] for c in DRIFT_PART.split(", ")]
    parts.publish(spark.createDataFrame([tuple({**own, "from_batch": start}[c] for c in names)], DRIFT_PART), batch_id)
    figures = drift_of_parts(whole, low, high, meta.low_percentile, meta.high_percentile, len(FEATURES))
    out.publish(spark.createDataFrame([figures], DRIFT_ROW), batch_id)
    for b in before:
        if b < start:
            parts.drop(b)


def _ring_start(spark: SparkSession, path: str | None) -> int | None:
    """The oldest batch of scores that the drift figures may read again."""
    if path is None:
        return None
    parts = BatchTable(spark, f"{path}/_parts", DRIFT_PART)
    held = parts.batches()
    return parts.of_batches(held[-1:]).first()["from_batch"] if held else 0


DRIFT_ROW = (
    "samples bigint, status string, global_low_threshold double, global_high_threshold double, expected_low_pct double, "
    "expected_high_pct double, n_features int, observed_low_pct double, observed_high_pct double, score_mean double, "
    "score_std double, score_min double, score_max double"
)


# -- alerts ----------------------------------------------------------------------------


def _with_trigger(rows: DataFrame) -> DataFrame:
    # a correction that leaves no crossing has no events to name
    total = F.nullif(F.col("total_count"), F.lit(0))
    return rows.withColumn("trigger", F.when(total.isNotNull(), trigger_text(F.col("severity2_count"), total)))


def publish_alerts(crossings: DataFrame, alerts_path: str, batch_id: int) -> None:
    """Adds the users that have no alert yet, from crossings of any source; reads the table to know them.
    A repeated batch ignores what it wrote itself. ``start_alerts`` keeps the latch in state instead."""
    table = BatchTable(crossings.sparkSession, alerts_path, ALERT_TABLE)
    known = table.rows().where(F.col("batch_id") < batch_id)
    first = crossings.groupBy(*USER_KEY).agg(
        F.min(F.struct("ts_us", "seq", "severity2_count", "total_count")).alias("a")
    ).select(*USER_KEY, "a.*")
    fresh = first.join(lookup_side(known.select(*USER_KEY)), USER_KEY, "left_anti")
    table.publish(_with_trigger(fresh), batch_id)


def start_alerts(
    scores: DataFrame, alerts_path: str, checkpoint: str, trigger: dict = TRIGGER, keep: Keep | None = None,
    consumed: Callable[[], int] | None = None, **gates,
) -> StreamingQuery:
    """Scores to the alert table, one alert per user, as soon as a window passes both gates.

    The latch is state, so a batch costs the same however many alerts there are. Where a
    late row moves or undoes a crossing that was told, the alert stays, and the correction
    goes to a table beside it (``corrected_alerts`` reads both).
    """
    spark = scores.sparkSession
    table, corrections = _alert_tables(spark, alerts_path)
    table.prepare()

    def each(batch: DataFrame, batch_id: int) -> None:
        if table.published(batch_id):
            return _advance(batch)
        with Steps(spark) as steps:
            told = steps.stored(_with_trigger(batch), "told")
            corrections.publish(told.where("revision > 1"), batch_id)
            table.publish(told.where("revision = 1").drop("revision"), batch_id)
        _bounded(table, keep, batch_id, consumed)

    return _start(stream_alert_revisions(scores, **gates), each, checkpoint, trigger)


def _alert_tables(spark: SparkSession, path: str) -> tuple[BatchTable, BatchTable]:
    return BatchTable(spark, path, ALERT_TABLE), BatchTable(spark, f"{path}/_corrections", CORRECTION_TABLE)


def corrected_alerts(spark: SparkSession, alerts_path: str) -> DataFrame:
    """Each user's first crossing as all rows so far have it, late ones included."""
    table, corrections = _alert_tables(spark, alerts_path)
    columns = [f for f in table.rows().columns if f != "batch_id"]
    told = table.rows().drop("batch_id").withColumn("revision", F.lit(1)).unionByName(corrections.rows().drop("batch_id"))
    last = told.groupBy(*USER_KEY).agg(F.max_by(F.struct(*columns), "revision").alias("last"))
    return last.select("last.*").where("ts_us is not null")
