"""Streams run over the whole table until it is used up; results are read from storage."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hostgauge.operators import model_stats as ms
from hostgauge.queries.alerting import GATES, WINDOWS
from hostgauge.queries.features import rolling_sql
from hostgauge.queries.models import trained_folder
from hostgauge.queries.registry import DAY_S, DAY_US, T, query, rounded
from hostgauge.queries.statistics import scored_events
from hostgauge.functions.event_features import entity_key
from hostgauge.session import materialize, shared_folder
from hostgauge.sources.events import encode_batches
from hostgauge.sources.model_store import load_model
from hostgauge.sources.tables import telemetry, telemetry_stream, with_surrogate_score
from hostgauge.streaming import jobs, source, state


def _folder(spark, what: str) -> str:
    return f"{shared_folder(spark)}/hostgauge-{what}-{uuid.uuid4().hex}"


def _run(df, each, folder: str, mode: str = "append") -> None:
    writer = df.writeStream.foreachBatch(each).outputMode(mode)
    jobs.start_stream(writer, f"{folder}/checkpoint", source.DRAIN).awaitTermination()


@query("stream_rolling_features", f"""
WITH {T}, {rolling_sql('t', DAY_US, 2 * DAY_US)}
SELECT seq, syscall_rate_5s, unique_syscalls_5s, round(failed_call_ratio_5s, 6) AS failed_call_ratio_5s,
       round(inter_arrival_ms, 3) AS inter_arrival_ms
FROM w JOIN i USING (seq)
""")
def stream_rolling_features(spark, sf_dir):
    folder = _folder(spark, "rolling")
    events = telemetry_stream(spark, sf_dir).select("hostName", "userId", "processId", "ts_us", "seq", "eventId", "returnValue")
    rows = state.stream_rolling_features(events, DAY_S, 2 * DAY_S)
    _run(rows, lambda df, i: jobs.write_batch(df, f"{folder}/rows", i), folder)
    out = spark.read.parquet(f"{folder}/rows").select("seq", *state.ROLLING_COLUMNS)
    return rounded(rounded(out, 6, "failed_call_ratio_5s"), 3, "inter_arrival_ms")


@query("stream_alerts", WINDOWS + " SELECT * FROM a")
def stream_alerts(spark, sf_dir):
    """The alerts of the batch query, raised by the stateful stream."""
    folder = _folder(spark, "alerts")
    thresholds = materialize(ms.entity_thresholds(scored_events(spark, sf_dir), 20, 10))
    live = with_surrogate_score(telemetry_stream(spark, sf_dir)).withColumn("entity", entity_key())
    graded = ms.with_severity(ms.with_thresholds(live, thresholds, {"low": 0.0, "high": 0.0}))
    scored = graded.withColumnsRenamed({"hostName": "hostname", "userId": "user_id"})
    q = jobs.start_alerts(scored, f"{folder}/alerts", f"{folder}/checkpoint", source.DRAIN, **GATES)
    q.awaitTermination()
    return jobs.read_table(spark, f"{folder}/alerts", jobs.ALERT_TABLE).drop("batch_id")


@query("stream_activity", f"""
WITH {T}
SELECT hostName AS hostname, ts_us // {DAY_US} * {DAY_US} AS from_us, count(*) AS events, max(ts_us) AS last_seen_us
FROM t GROUP BY 1, 2
""")
def stream_activity(spark, sf_dir):
    folder = _folder(spark, "activity")
    counts = state.stream_activity(telemetry_stream(spark, sf_dir), "2 days", "1 day")
    _run(counts, lambda df, i: jobs.write_batch(df, f"{folder}/rows", i), folder, "update")
    rows = spark.read.parquet(f"{folder}/rows").groupBy("hostname", "window").agg(
        F.max("events_per_min").alias("events"), F.max("last_seen").alias("last_seen")
    )
    return rows.select("hostname", F.unix_micros("window.start").alias("from_us"), "events", F.unix_micros("last_seen").alias("last_seen_us"))


@query("stream_decoded_events", f"WITH {T} SELECT hostName, eventName, count(*) AS n, CAST(sum(processId) AS BIGINT) AS pids FROM t GROUP BY 1, 2")
def stream_decoded_events(spark, sf_dir):
    """Messages of all hosts, read as a stream into the event table."""
    folder = _folder(spark, "ingest")
    _ingest(spark, sf_dir, folder)
    events = jobs.read_table(spark, f"{folder}/events", jobs.EVENT_TABLE)
    return events.groupBy("hostName", "eventName").agg(F.count(F.lit(1)).alias("n"), F.sum("processId").alias("pids"))


def _ingest(spark, sf_dir, folder: str) -> None:
    messages = encode_batches(telemetry(spark, sf_dir), F.floor(F.col("seq") / 100))
    messages.write.parquet(f"{folder}/messages")
    stream = source.file_messages(spark, f"{folder}/messages", "parquet")
    jobs.start_ingest(stream, f"{folder}/events", f"{folder}/c1", source.DRAIN).awaitTermination()


@query("stream_live_scores")
def stream_live_scores(spark, sf_dir):
    """The whole chain: messages, events, scores of a trained model, alerts."""
    folder = _folder(spark, "live")
    model = load_model(spark, trained_folder(spark, sf_dir)[0])
    _ingest(spark, sf_dir, folder)
    jobs.start_scoring(
        f"{folder}/events", model, f"{folder}/scores", f"{folder}/c2", source.DRAIN, f"{folder}/drift", f"{folder}/feed",
        spark=spark, window_s=DAY_S, gap_s=2 * DAY_S,
    ).awaitTermination()
    scores = jobs.stream_table(spark, f"{folder}/scores", jobs.SCORE_TABLE)
    jobs.start_alerts(scores, f"{folder}/alerts", f"{folder}/c3", source.DRAIN, **GATES).awaitTermination()
    return jobs.read_table(spark, f"{folder}/scores", jobs.SCORE_TABLE).drop("batch_id")
