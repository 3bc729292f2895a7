"""Stream tables under replay, arrival numbers, sessions, flushes, drift and the outbox, against plain versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostgauge.operators import alerts as al, monitor
from hostgauge.operators.batching import with_flushes
from hostgauge.operators.ordered import quantile_array, running_total
from hostgauge.operators.sessions import events_in_sessions
from hostgauge.sources import events as store
from hostgauge.streaming import jobs, source, state
from hostgauge.streaming.outbox import Outbox, consumed
from hostgauge.streaming.tables import BatchTable, Keep
from tests.conftest import events, plan_of
from tests.test_streaming import GATES, run, scored_rows, table_stream

ROWS = "hostname string, ts_us bigint, seq bigint, x string"


def batches_of(rng, n_batches, n=60):
    seq, out = 0, []
    for _ in range(n_batches):
        rows = []
        for _ in range(n):
            rows.append((rng.choice(["a", "a", "a", "b", None]), rng.choice([None, rng.randrange(5), rng.randrange(10**7)]), seq, "t"))
            seq += 1
        out.append(rows)
    return out


def newest(rows, n, key):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    return sorted((r for g in groups.values() for r in sorted(g, key=key, reverse=True)[:n]), key=lambda r: r[2])


@pytest.mark.parametrize("arrival", [False, True])
def test_generations(spark, tmp_path, arrival):
    batches = batches_of(random.Random(1), 5)
    table, keep = BatchTable(spark, str(tmp_path / "t"), ROWS), Keep(25, arrival=arrival)
    key = (lambda r: r[2]) if arrival else (lambda r: (r[1] or 0, r[2]))
    table.prepare()
    so_far = []
    for i, rows in enumerate(batches):
        so_far += rows
        assert table.publish(spark.createDataFrame(rows, ROWS), i)
        for b in range(i + 1):  # replayed, and other rows under an old number
            assert not table.publish(spark.createDataFrame(batches[0], ROWS), b)
        before = [tuple(r) for r in table.rows().drop("batch_id").collect()]
        assert len(before) == len(set(before)) and set(newest(so_far, 25, key)) <= set(before)
        table.compact(keep)
        assert table.compact(keep) == table.manifest()
        held = sorted((tuple(r) for r in table.rows().drop("batch_id").collect()), key=lambda r: r[2])
        assert held == newest(so_far, 25, key)
        table.vacuum(i - 1)
        assert sorted((tuple(r) for r in table.rows().drop("batch_id").collect()), key=lambda r: r[2]) == held
        assert not table.publish(spark.createDataFrame(rows, ROWS), max(i - 1, 0))  # its folder is gone
        seen = {r["hostname"]: (r["seen"], r["dropped"]) for r in table.seen(("hostname",)).collect()}
        for host in {r[0] for r in so_far}:
            n = sum(r[0] == host for r in so_far)
            assert seen[host] == (n, max(0, n - 25))
    assert table.batches() == [4]


def test_a_reader_between_the_steps_of_a_compaction(spark, tmp_path):
    """A generation without manifest does not exist; one that was left by a crash is written anew."""
    table, keep = BatchTable(spark, str(tmp_path / "t"), ROWS), Keep(2)
    for i, rows in enumerate(batches_of(random.Random(2), 2, 10)):
        table.publish(spark.createDataFrame(rows, ROWS), i)
    spark.createDataFrame([("a", 1, 1, "wrong", 0)], ROWS + ", batch_id bigint").write.parquet(str(tmp_path / "t/_kept/generation=1"))
    assert table.rows().count() == 20
    table.compact(keep)
    assert table.rows().where("x = 'wrong'").isEmpty()


def test_streams_read_on_over_compactions(spark, tmp_path):
    path = str(tmp_path / "t")
    table = BatchTable(spark, path, ROWS)
    table.prepare()
    batches = batches_of(random.Random(3), 4, 20)
    for i, rows in enumerate(batches):
        table.publish(spark.createDataFrame(rows, ROWS), i)
        run(jobs.stream_table(spark, path, ROWS), str(tmp_path / "out"), str(tmp_path / "c"))
        table.compact(Keep(3))
        table.vacuum(i)
    assert sorted(r["seq"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(80))


# -- arrival -----------------------------------------------------------------------------


def messages(spark, rng, n=40):
    """Messages of few distinct times; one holds 5,000 events, some are broken, one repeats another."""
    rows, t = [], 1_700_000_000_000_000
    for i in range(n):
        size = 5000 if i == 7 else rng.randrange(0, 4)
        host = rng.choice(["a", "b"])
        t += rng.choice([0, 0, 1000])
        data = "[" + ",".join(f'{{"eventId":1,"mountNamespace":2,"processId":{i * 10000 + j}}}' for j in range(size)) + "]"
        rows.append((f"events.{host}", f"5-{i}", t, data if i % 9 else "[" + data))
    rows.append(rows[-1])
    return spark.createDataFrame(rows, "stream string, msg_id string, us bigint, data string").select(
        "stream", "msg_id", F.timestamp_micros("us").alias("ingest_ts"), "data"
    )


def test_arrival_numbers_do_not_depend_on_the_split(spark, tmp_path):
    m = messages(spark, random.Random(4))
    whole = source.arriving_events(m.repartition(3)).select("seq", "processId", "ts_us").collect()
    n = len(whole)
    assert n > 5000 and sorted(r["seq"] for r in whole) == list(range(n))
    by_seq = [r["processId"] for r in sorted(whole, key=lambda r: r["seq"])]
    in_order = sorted(m.collect(), key=lambda r: (r["ingest_ts"], r["stream"], int(r["msg_id"][2:])))
    assert by_seq == [int(p) for r in in_order if not r["data"].startswith("[[") for p in re.findall(r"processId.:(\d+)", r["data"])]
    # in two halves by time, numbered on from where the first ended
    cut = sorted({r["ingest_ts"] for r in m.collect()})[3]
    first = source.arriving_events(m.where(F.col("ingest_ts") < cut)).select("seq", "processId").collect()
    second = source.arriving_events(m.where(F.col("ingest_ts") >= cut), first=len(first)).select("seq", "processId").collect()
    assert sorted((r["seq"], r["processId"]) for r in [*first, *second]) == list(enumerate(by_seq))


def test_running_total(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.randrange(40), i, rng.randrange(4)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, t bigint, i bigint, w bigint")
    got = running_total(df, "w", [F.col("t"), F.col("i")], [F.floor(F.col("t") / 10), F.floor(F.col("t") / 2)], ["g"])
    for r in got.collect():
        assert r["start"] == sum(w for g, t, i, w in rows if g == r["g"] and (t, i) < (r["t"], r["i"]))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_places_in_files(spark, tmp_path, fmt):
    rows = events(spark, [{"timestamp": float(i), "eventId": None if i % 7 == 0 else 1, "args": "a,\n\"b\"" * 20} for i in range(900)])
    path = str(tmp_path / "e")
    store.write_events(rows.repartitionByRange(3, "seq").sortWithinPartitions("seq"), path, "csv", escaped=True) if fmt == "csv" else (
        rows.repartitionByRange(3, "seq").sortWithinPartitions("seq").write.parquet(path))
    setting = "spark.sql.files.maxPartitionBytes"
    before, found = spark.conf.get(setting), []
    try:
        for size in ("20000", "100000000"):
            spark.conf.set(setting, size)
            read = store.read_events(spark, path, fmt, escaped=True, numbered=True)
            found.append((read.rdd.getNumPartitions(), sorted((r["seq"], r["timestamp"]) for r in read.collect())))
    finally:
        spark.conf.set(setting, before)
    assert found[0][1] == found[1][1] == [(i, float(i)) for i in range(900) if i % 7]
    assert fmt == "parquet" or found[0][0] > found[1][0]  # small Parquet files have one row group each


def test_late_rows_go_to_the_side_and_none_is_lost(spark, tmp_path):
    at = [[100.0, 200.0, 150.0], [50.0, 210.0, 81.0], [500.0, 379.0, 380.0, None]]
    folder = str(tmp_path / "m")
    for i, times in enumerate(at):
        e = events(spark, [{"timestamp": t, "processId": i * 10 + j} for j, t in enumerate(times)])
        e = e.withColumn("ts_us", F.coalesce("ts_us", F.lit(1_000_000)))
        store.encode_batches(e, F.lit(i)).coalesce(1).write.mode("append").parquet(folder)
    args = dict(late_path=str(tmp_path / "late"), lateness_s=120, trigger=source.DRAIN)
    stream = source.file_messages(spark, folder, "parquet", 1)
    jobs.start_ingest(stream, str(tmp_path / "e"), str(tmp_path / "c"), **args).awaitTermination()
    ids = lambda p: sorted(r["processId"] for r in jobs.read_table(spark, str(tmp_path / p), jobs.EVENT_TABLE).collect())
    assert ids("late") == [10] and ids("e") == [0, 1, 2, 11, 12, 20, 21, 22, 23]
    # a restart from scratch finds everything published
    stream = source.file_messages(spark, folder, "parquet", 1)
    jobs.start_ingest(stream, str(tmp_path / "e"), str(tmp_path / "c2"), **args).awaitTermination()
    assert ids("late") == [10] and len(ids("e")) == 9


# -- state -----------------------------------------------------------------------------


def state_rows(query):
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_no_text_enters_the_step_and_idle_state_goes(spark, tmp_path):
    us = lambda s: int(s * 1_000_000)
    rows = [(i, us(1_000_000 + i)) for i in range(50)] + [(50, us(2_000_000)), (51, us(2_000_001))]
    df = events(spark, [{"seq": s, "timestamp": t / 1e6, "processId": 1 if s < 50 else 2} for s, t in rows])
    stream = table_stream(spark, df, str(tmp_path / "in"), 2)
    features = state.stream_rolling_features(stream, delay="1 minute")
    assert "args" not in features.columns and "processName" not in features.columns
    writer = features.writeStream.foreachBatch(lambda b, i: jobs.write_batch(b, str(tmp_path / "out"), i))
    q = jobs.start_stream(writer, str(tmp_path / "c"), source.DRAIN)
    q.awaitTermination()
    held = state_rows(q)
    # no further row of process 1 ever comes; its state goes with the watermark
    assert max(held) >= 3 and held[-1] == 1
    assert spark.read.parquet(str(tmp_path / "out")).count() == 52


@pytest.mark.parametrize("seed", [1, 2])
def test_alerts_out_of_order(spark, tmp_path, seed):
    df = scored_rows(spark)
    shuffled = df.withColumn("key", F.hash("seq", F.lit(seed)))
    stream = table_stream(spark, shuffled, str(tmp_path / "in"), 4, "key")
    out = str(tmp_path / "alerts")
    q = jobs.start_alerts(stream, out, str(tmp_path / "c"), source.DRAIN, bucket_windows=2, delay="1 hour", **GATES)
    q.awaitTermination()
    batch = al.alerts(df, **GATES)
    live = jobs.corrected_alerts(spark, out).select(*batch.columns)
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, batch.collect()))
    # the table itself names each user once
    users = [(r["hostname"], r["user_id"]) for r in jobs.read_table(spark, out, jobs.ALERT_TABLE).collect()]
    assert len(users) == len(set(users)) >= batch.count()


def test_a_final_alert_costs_one_value(spark, tmp_path):
    rows = [("h", 1500, (10**6 + i) * 1_000_000, i, 2) for i in range(300)]
    df = spark.createDataFrame(rows, "hostname string, user_id bigint, ts_us bigint, seq bigint, severity int")
    stream = table_stream(spark, df, str(tmp_path / "in"), 3)
    q = jobs.start_alerts(stream, str(tmp_path / "a"), str(tmp_path / "c"), source.DRAIN, bucket_windows=1, delay="1 second", **GATES)
    q.awaitTermination()
    latch = [p["stateOperators"] for p in q.recentProgress][-1]
    assert min(s["numRowsTotal"] for s in latch) <= 2
    assert jobs.read_table(spark, str(tmp_path / "a"), jobs.ALERT_TABLE).count() == 1


# -- the rest ----------------------------------------------------------------------------


@pytest.mark.parametrize("size, seconds", [(4, 5.0), (100, 2.0), (3, 1000.0)])
def test_flushes(spark, size, seconds):
    rng = random.Random(6)
    rows, t = [], 0
    for i in range(120):
        t += rng.choice([0, 0, 500_000, 2_000_000, 5_000_000])
        rows.append((rng.choice(["a", "b"]), i, t))
    rows += [("c", 500, None), ("c", 501, 7)]
    df = spark.createDataFrame(rows, "hostName string, seq bigint, ts_us bigint")
    got = {(r["hostName"], r["seq"]): (r["batch"], r["flushed"]) for r in with_flushes(df, size, seconds).collect()}
    for host in "ab":
        mine = sorted((t, s) for h, s, t in rows if h == host)
        last, batches, batch = mine[0][0], [], []
        for i, (t, s) in enumerate(mine, 1):
            why = "count" if i % size == 0 else "time" if t - last >= seconds * 1e6 else None
            batch.append((s, why))
            if why:
                last = t
                batches.append(batch)
                batch = []
        batches += [batch] if batch else []
        assert [[(s, got[host, s][1]) for s, _ in b] for b in batches] == batches
        numbers = [{got[host, s][0] for s, _ in b} for b in batches]
        assert all(len(n) == 1 for n in numbers) and sorted(n for s in numbers for n in s) == [n for s in numbers for n in s]
    assert ("c", 500) in got and len(got) == 122


def test_sessions_in_force(spark):
    rng = random.Random(7)
    log = [(h, t, u) for h in "ab" for t in (10, 20, 30) for u in range(4) if rng.random() < 0.5] + [("a", 25, None)]
    rows = [(h, t, u, i) for i, (h, t, u) in enumerate((rng.choice("abc"), rng.choice([None, *range(40)]), rng.randrange(4)) for _ in range(300))]
    e = spark.createDataFrame(rows, "hostName string, ts_us bigint, userId bigint, seq bigint")
    s = spark.createDataFrame(log, "hostName string, taken_us bigint, userId bigint")
    for strict in (False, True):
        got = {r["seq"] for r in events_in_sessions(e, s, strict=strict, bucket_us=7).collect()}
        for h, t, u, i in rows:
            taken = [x for g, x, _ in log if g == h and t is not None and x <= t]
            users = {v for g, x, v in log if g == h and taken and x == max(taken) and v is not None}
            assert (i in got) == (u in users or (not users and not strict)), (h, t, u)


def test_sessions_of_a_repeated_batch(spark, tmp_path):
    """A batch is judged by the snapshots that it had, also if a newer one came before it is repeated."""
    marks = jobs.Marks(spark, str(tmp_path))
    first = marks.put(0, {"events": 5, "max_us": 1, "sessions_us": 10})
    assert marks.put(0, {"events": 9, "max_us": 9, "sessions_us": 99}) == first == marks.get(0)
    assert marks.get(1) is None and marks.get(-1)["events"] == 0


@pytest.mark.parametrize("sample", [150, 100, 1000])
def test_drift_of_parts(spark, tmp_path, sample):
    rng = np.random.default_rng(8)
    schema = "ts_us bigint, seq bigint, raw_score double"
    table, seq = BatchTable(spark, str(tmp_path / "s"), schema), 0
    from types import SimpleNamespace

    meta = SimpleNamespace(low_percentile=2.0, high_percentile=0.2)
    for b, n in enumerate([60, 0, 90, 100, 10, 260]):
        rows = [(seq + i, seq + i, None if rng.random() < 0.05 else float(rng.normal())) for i in range(n)]
        seq += n
        table.publish(spark.createDataFrame(rows, schema), b)
        for _ in range(2):
            jobs.publish_drift(spark, table, str(tmp_path / "d"), b, -0.5, -1.5, meta, sample)
        got = jobs.read_table(spark, str(tmp_path / "d"), jobs.DRIFT_ROW).where(F.col("batch_id") == b).drop("batch_id").first().asDict()
        want = monitor.drift(table.rows(), -0.5, -1.5, 2.0, sample).first().asDict()
        assert got.keys() == want.keys()
        assert got == pytest.approx(want)


def test_outbox(spark, tmp_path):
    rng = random.Random(9)
    table = BatchTable(spark, str(tmp_path / "a"), jobs.ALERT_TABLE)
    box = Outbox(spark, str(tmp_path / "a"), str(tmp_path / "o"))
    waiting, offers = set(), {}
    for r in range(6):
        if r < 4:
            users = [100 * r + i for i in range(5)]
            table.publish(spark.createDataFrame([("h", u, 1, 1, 1, 1, "t") for u in users], jobs.ALERT_TABLE), r)
            waiting |= set(users)
        offered = {x["user_id"]: x["alert_id"] for x in box.offer(r).collect()}
        assert set(offered) == waiting
        for u in offered:
            offers[u] = offers.get(u, 0) + 1
        heard = [u for u in sorted(waiting) if rng.random() < 0.5 or r == 4]
        acks = [(offered[u], r) for u in heard for _ in range(rng.choice([1, 2]))] + [("unknown", r)]
        box.acknowledge(spark.createDataFrame(acks, "alert_id string, round int"), r)
        waiting -= set(heard)
    assert not waiting
    got = consumed(box.deliveries.of_batches(box.deliveries.batches())).collect()
    assert {x["user_id"]: x["offers"] for x in got} == offers
    with pytest.raises(ValueError):
        box.offer(9)


@pytest.mark.parametrize("most", [10, 1])
def test_crowded_bins_are_split(spark, most):
    """Values that share a bin of the logarithm, down to neighbouring doubles; one value that most rows have."""
    rng = np.random.default_rng(10)
    x = np.concatenate([1.7e9 + rng.random(400), np.nextafter(3.0, np.arange(4)) + 0.0, np.full(300, 1.7e9 + 0.5), [5e-324, 1e-323, 0.0, 1.5e308, 1.7e308, np.inf]])
    df = spark.createDataFrame([("g" if i % 3 else "h", float(v)) for i, v in enumerate(x)], "g string, v double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.9]
    got = quantile_array(df, "v", probs, sorted_at_once=most).first()
    assert got["quantiles"] == pytest.approx(np.quantile(x, probs).tolist(), rel=1e-15)
    for r in quantile_array(df, "v", probs, ["g"], sorted_at_once=most).collect():
        own = np.array([v for i, v in enumerate(x) if ("g" if i % 3 else "h") == r["g"]])
        assert r["quantiles"] == pytest.approx(np.quantile(own, probs).tolist(), rel=1e-15)
