"""Streams give what the batch queries give, in any split into micro-batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostgauge.operators import alerts as al
from hostgauge.operators.rolling import with_serving_features
from hostgauge.sources import events as store
from hostgauge.streaming import jobs, source, state
from tests.test_rolling import COLS, as_events, got, random_rows


def table_stream(spark, df, folder, parts, key="seq"):
    """``df`` as a stream of ``parts`` files, in the order of ``key``."""
    rows = df.orderBy(key).collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        part = spark.createDataFrame(rows[i * size:(i + 1) * size], df.schema).coalesce(1)
        part.write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(df, path, checkpoint):
    writer = df.writeStream.foreachBatch(lambda b, i: jobs.write_batch(b, path, i))
    jobs.start_stream(writer, checkpoint, source.DRAIN).awaitTermination()


@pytest.mark.parametrize("parts", [1, 3])
def test_rolling_features(spark, tmp_path, parts):
    rows = sorted(random_rows(5, 240, 300), key=lambda r: r["us"])
    rows = [{**r, "seq": i} for i, r in enumerate(rows)]
    df = as_events(spark, rows)
    stream = table_stream(spark, df, str(tmp_path / "in"), parts)
    run(state.stream_rolling_features(stream, bucket_windows=1), str(tmp_path / "out"), str(tmp_path / "c"))
    batch = got(with_serving_features(df))
    live = got(spark.read.parquet(str(tmp_path / "out")))
    assert live.keys() == batch.keys()
    for seq, w in batch.items():
        assert live[seq] == pytest.approx(w), seq


def scored_rows(spark, n=400):
    rng = np.random.default_rng(4)
    rows = [
        ("h", 1500 if rng.random() < 0.4 else 1501 + int(rng.integers(4)), i * 700_000, i, int(rng.choice([0, 1, 2], p=[0.7, 0.1, 0.2])))
        for i in range(n)
    ] + [("h", 0, i * 1000, n + i, 2) for i in range(20)]
    return spark.createDataFrame(rows, "hostname string, user_id bigint, ts_us bigint, seq bigint, severity int")


GATES = {"window_s": 20, "count": 3, "min_rate": 0.3}


def test_alerts_over_several_batches(spark, tmp_path):
    df = scored_rows(spark)
    stream = table_stream(spark, df, str(tmp_path / "in"), 3)
    out = str(tmp_path / "alerts")
    jobs.start_alerts(stream, out, str(tmp_path / "c"), source.DRAIN, bucket_windows=1, **GATES).awaitTermination()
    live = jobs.read_table(spark, out, jobs.ALERT_TABLE).drop("batch_id")
    batch = al.alerts(df, **GATES)
    assert sorted(map(tuple, live.select(*batch.columns).collect())) == sorted(map(tuple, batch.collect()))
    assert live.count() >= 3


def test_repeated_batch_neither_loses_nor_doubles(spark, tmp_path):
    out = str(tmp_path / "alerts")
    jobs.prepare(spark, out, jobs.ALERT_TABLE)
    crossing = spark.createDataFrame([("h", 1500, 5, 1, 3, 3), ("h", 1500, 9, 2, 4, 4)], state.CROSSING_SCHEMA)
    later = spark.createDataFrame([("h", 1500, 99, 7, 3, 3), ("h", 1501, 99, 8, 3, 3)], state.CROSSING_SCHEMA)
    for batch_id, rows in [(0, crossing), (0, crossing), (1, later), (1, later)]:
        jobs.publish_alerts(rows, out, batch_id)
    got_rows = jobs.read_table(spark, out, jobs.ALERT_TABLE).orderBy("user_id").collect()
    assert [(r["user_id"], r["seq"]) for r in got_rows] == [(1500, 1), (1501, 8)]


def test_ingest_reads_sessions_anew(spark, tmp_path):
    from tests.conftest import events

    first = events(spark, [{"hostName": "a", "userId": 1500 + i % 2, "timestamp": float(i)} for i in range(4)])
    messages = store.encode_batches(first, F.lit(0))
    folder, sessions = str(tmp_path / "in"), str(tmp_path / "sessions")
    messages.write.parquet(folder)
    schema = "hostName string, userId bigint"
    spark.createDataFrame([("a", 1500)], schema).write.parquet(sessions)

    def ingest():
        stream = source.file_messages(spark, folder, "parquet")
        jobs.start_ingest(
            stream, str(tmp_path / "events"), str(tmp_path / "c"), source.DRAIN,
            sessions=lambda: spark.read.schema(schema).parquet(sessions),
        ).awaitTermination()
        rows = jobs.read_table(spark, str(tmp_path / "events"), jobs.EVENT_TABLE)
        return sorted(r["userId"] for r in rows.collect())

    assert ingest() == [1500, 1500]
    spark.createDataFrame([("a", 1501)], schema).write.mode("append").parquet(sessions)
    messages.write.mode("append").parquet(folder)
    assert ingest() == [1500, 1500, 1500, 1500, 1501, 1501]


def test_activity(spark, tmp_path):
    df = spark.range(100).select(F.lit("h").alias("hostName"), (F.col("id") * 1_000_000).alias("ts_us"), F.col("id").alias("seq"))
    stream = table_stream(spark, df, str(tmp_path / "in"), 2)
    counts = state.stream_activity(stream)
    out = str(tmp_path / "out")
    writer = counts.writeStream.outputMode("update").foreachBatch(lambda b, i: jobs.write_batch(b, out, i))
    jobs.start_stream(writer, str(tmp_path / "c"), source.DRAIN).awaitTermination()
    last = spark.read.parquet(out).groupBy("window").agg(F.max("events_per_min")).collect()
    assert sorted(r[1] for r in last) == [40, 60]


def test_late_rows_are_kept(spark, tmp_path):
    df = as_events(spark, [{"seq": i, "us": us, "timestamp": us / 1e6} for i, us in enumerate([0, 900_000_000, 1_000_000])])
    stream = table_stream(spark, df, str(tmp_path / "in"), 3)
    run(state.stream_rolling_features(stream), str(tmp_path / "out"), str(tmp_path / "c"))
    live = {r["seq"]: tuple(r[c] for c in COLS) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert live[2] == (2.0, 1.0, 0.0, 1000.0) and len(live) == 3
