"""Input that must not end a job, vanish, or count twice."""

import json

import pytest
from pyspark.sql import functions as F

from hostgauge.functions.columns import whole_json
from hostgauge.functions.event_features import args_blob
from hostgauge.operators.monitor import latest_rows
from hostgauge.operators.ordered import exact_quantiles
from hostgauge.operators.isolation_forest import assign_subsamples
from hostgauge.operators.rolling import with_serving_features
from hostgauge.sources import events as store, logs
from hostgauge.streaming import jobs, source
from tests.conftest import events, plan_of
from tests.test_logs import AUDIT, lines, names, one  # noqa: F401


@pytest.mark.parametrize("key, column, value, expected", [
    ("eventId", "eventId", 5_000_000_000, 59), ("processId", "processId", 1e30, 0), ("userId", "userId", 10**25, 0),
    ("returnValue", "returnValue", -1e300, 0), ("processId", "processId", "12", 12),
])
def test_probe_numbers_out_of_range(spark, names, key, column, value, expected):  # noqa: F811
    line = json.dumps({"eventName": "execve", "eventId": 59, "processId": 7, "userId": 8, "returnValue": 9} | {key: value})
    assert one(logs.ingest_probe_json(lines(spark, line), names))[column] == expected


@pytest.mark.parametrize("old, column", [
    ("syscall=59", "eventId"), ("ppid=10", "parentProcessId"), (" pid=11", "processId"), ("exit=-13", "returnValue"), ("uid=33 ", "userId"),
])
def test_audit_numbers_out_of_range(spark, names, old, column):  # noqa: F811
    line = AUDIT.replace(old, old.split("=")[0] + "=" + "9" * 30 + (" " if old.endswith(" ") else ""), 1 if old != "uid=33 " else -1)
    row = one(logs.ingest_auditd(lines(spark, line), names))
    assert row[column] in (0, 1000)
    kv = one(logs.ingest_audit_kv(lines(spark, line)))
    assert kv["eventId"] in (0, 59)


def test_white_space_around_lines(spark, names):  # noqa: F811
    assert one(logs.ingest_auditd(lines(spark, "\t " + AUDIT + " \r"), names))["processName"] == "sh"
    line = '\t{"eventName":"execve","processName":"sh"}\r'
    assert one(logs.ingest_probe_json(lines(spark, line), names))["processName"] == "sh"


@pytest.mark.parametrize("text, found", [
    ('{"a":1}', '{"a":1}'), (' [1,2] ', "[1,2]"), ('{"a":1}]junk', None), ('[1]],x', None), ("1,2", None), ('1,"x"]', None), ("", None),
    ("{bad", None), ('{"a":1,"a":2}', '{"a":2}'), (None, None), ("null", "null"), ('"]"', '"]"'),
])
def test_json_is_one_value(spark, text, found):
    df = spark.createDataFrame([(text,)], "t string").select(F.to_json(whole_json(F.col("t"))).alias("j"))
    assert df.first()["j"] == found


def test_a_repeated_key_hides_nothing(spark):
    df = spark.createDataFrame([('[{"value":"a","value":"/etc/shadow"}]',)], "args string")
    assert df.select(args_blob(F.col("args")).alias("b")).first()["b"] == "/etc/shadow"
    body = '[{"eventId":59,"eventId":60,"mountNamespace":1},{"eventId":3,"mountNamespace":1}]'
    message = spark.createDataFrame([("events.h", "m", None, body)], store.ENVELOPE_SCHEMA)
    assert sorted(r["eventId"] for r in store.decode_batches(message).collect()) == [3, 60]


@pytest.mark.parametrize("escaped", [True, False])
def test_csv_keeps_line_breaks(spark, tmp_path, escaped):
    odd = ["a\nb", "c\r\nd", "e\\nf", "g\\", '"h", i', "\\\n"]
    df = events(spark, [{"processName": n} for n in odd])
    store.write_events(df.coalesce(1), str(tmp_path / "csv"), "csv", escaped=escaped)
    back = store.read_events(spark, str(tmp_path / "csv"), "csv", escaped=escaped)
    got = sorted(r["processName"] for r in back.collect())
    if not escaped:
        got = [n.replace("\r\n", "\n") for n in got]
        odd = [n.replace("\r\n", "\n") for n in odd]
    assert got == sorted(odd)


def test_infinite_values_have_quantiles(spark):
    df = spark.createDataFrame([(float(x),) for x in (-float("inf"), 1, 2, 3, float("inf"))], "v double")
    assert exact_quantiles(df, "v", {"q": 0.5}).first()["q"] == 2.0


def test_newest_rows_of_one_minute_are_not_sorted_together(spark):
    df = spark.range(200_000).select(F.lit("h").alias("hostname"), (F.col("id") * 300).alias("ts_us"), F.col("id").alias("seq"))
    newest = latest_rows(df, 12_345)
    assert newest.agg(F.count("*"), F.min("seq"), F.max("seq")).first()[:] == (12_345, 200_000 - 12_345, 199_999)
    assert "_bin2" in plan_of(newest)  # the sort is within a millisecond
    per_host = latest_rows(df.unionAll(df.withColumn("hostname", F.lit("g")).limit(5)), 10, ["hostname"])
    assert {r["hostname"]: r["count"] for r in per_host.groupBy("hostname").count().collect()} == {"h": 10, "g": 5}


@pytest.mark.parametrize("n", [5, 8 * 16 - 1, 8 * 16, 5000])
def test_every_tree_gets_as_many_distinct_rows(spark, n):
    ranked = spark.range(n).select(F.col("id").alias("rank"), F.col("id").cast("double").alias("x"))
    drawn = assign_subsamples(ranked, n, 16, 50, 3).groupBy("tree_id").agg(F.count("*").alias("n"), F.countDistinct("rank").alias("d")).collect()
    assert len(drawn) == 50 and {(r["n"], r["d"]) for r in drawn} == {(min(16, n), min(16, n))}


def test_rows_without_time_stay_apart(spark):
    df = events(spark, [{"timestamp": None, "seq": s} for s in (1, 1 + 2**40, 2**62, 2**62 + 2**40)])
    assert [r["syscall_rate_5s"] for r in with_serving_features(df).collect()] == [1.0] * 4


def test_long_messages_keep_their_order(spark):
    first = events(spark, [{"timestamp": 5.0, "processId": i} for i in range(5000)])
    arrived = source.arriving_events(store.encode_batches(first, F.lit(0))).select("seq", "processId").orderBy("seq").collect()
    assert len({r["seq"] for r in arrived}) == 5000 and [r["processId"] for r in arrived] == list(range(5000))


def test_a_repeated_batch_of_any_stage_is_seen_once(spark, tmp_path):
    """Every stage's sink is called again with an old batch while the next stage reads on."""
    schema = "hostname string, user_id bigint, ts_us bigint, seq bigint, severity int"
    scores, alerts = str(tmp_path / "scores"), str(tmp_path / "alerts")
    batches = [[("h", 1500, i * 1_000_000 + b, 10 * b + i, 2) for i in range(3)] for b in range(3)]

    def read_on():
        stream = spark.readStream.schema(schema + ", batch_id bigint").parquet(scores).drop("batch_id")
        jobs.start_alerts(stream, alerts, str(tmp_path / "c"), source.DRAIN, count=5, min_rate=0.3).awaitTermination()
        return jobs.read_table(spark, alerts, jobs.ALERT_TABLE).count()

    assert jobs.write_batch(spark.createDataFrame(batches[0], schema), scores, 0)
    assert read_on() == 0
    for _ in range(3):
        assert not jobs.write_batch(spark.createDataFrame(batches[0], schema), scores, 0)
        assert read_on() == 0  # three severe events stay three
    assert spark.read.parquet(scores).count() == 3
    assert jobs.write_batch(spark.createDataFrame(batches[1], schema), scores, 1)
    assert read_on() == 1
    assert not jobs.write_batch(spark.createDataFrame(batches[1], schema), scores, 1)
    assert jobs.write_batch(spark.createDataFrame(batches[2], schema), scores, 2)
    assert read_on() == 1


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from hostgauge.session import shared_folder

    conf = SimpleNamespace(get=lambda *_: None, set=lambda *_: None)
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://somewhere:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(conf=conf, sparkContext=context))
