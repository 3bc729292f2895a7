"""Keys share the state of a shard: calls do not grow with the keys, and keys do not see each other."""

import numpy as np
from pyspark.sql import functions as F

from hostgauge.operators import alerts as al
from hostgauge.operators.rolling import with_serving_features
from hostgauge.streaming import jobs, source, state
from tests.test_rolling import as_events, got
from tests.test_streaming import GATES, table_stream


def test_many_keys_in_few_states(spark, tmp_path):
    rows = [{"userId": 2000 + i % 1200, "processId": i % 1200, "us": 1_000_000_000 + 700 * i, "seq": i, "timestamp": 1.0} for i in range(2400)]
    rows = [{**r, "returnValue": None if i % 7 == 0 else (1 << 60) + i} for i, r in enumerate(rows)]
    rows = [{**r, "userId": None} if r["processId"] % 50 == 0 else r for r in rows]
    df = as_events(spark, rows)
    stream = table_stream(spark, df, str(tmp_path / "in"), 2)
    writer = state.stream_rolling_features(stream).writeStream.foreachBatch(lambda b, i: jobs.write_batch(b, str(tmp_path / "out"), i))
    q = jobs.start_stream(writer, str(tmp_path / "c"), source.DRAIN)
    q.awaitTermination()
    held = max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"])
    assert 0 < held < 1000  # 1200 keys
    out = spark.read.parquet(str(tmp_path / "out"))
    assert got(out) == got(with_serving_features(df))
    exact = {r["seq"]: (r["userId"], r["returnValue"]) for r in out.select("seq", "userId", "returnValue").collect()}
    assert exact == {r["seq"]: (r["userId"], r["returnValue"]) for r in rows}


def test_alerts_of_many_users(spark, tmp_path):
    rng = np.random.default_rng(12)
    rows = [("h", 1500 + int(rng.integers(1500)), i * 10_000, i, int(rng.choice([0, 2]))) for i in range(6000)]
    rows += [(None, 1500, 5, 9000 + i, 2) for i in range(3)]
    df = spark.createDataFrame(rows, "hostname string, user_id bigint, ts_us bigint, seq bigint, severity int")
    stream = table_stream(spark, df.withColumn("key", F.hash("seq")), str(tmp_path / "in"), 3, "key")
    q = jobs.start_alerts(stream, str(tmp_path / "a"), str(tmp_path / "c"), source.DRAIN, delay="1 hour", **GATES)
    q.awaitTermination()
    for operator in (0, 1):
        assert max(p["stateOperators"][operator]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= 2 * (state.SHARDS + 1)
    batch = al.alerts(df, **GATES)
    live = jobs.corrected_alerts(spark, str(tmp_path / "a")).select(*batch.columns)
    order = lambda found: sorted(map(tuple, found.where("hostname is not null").collect()))
    assert order(live) == order(batch) and len(order(batch)) > 200
    assert [tuple(r) for r in live.where("hostname is null").select("user_id", "seq").collect()] == [(1500, 9002)]
