import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from hostgauge.fixed_values import HOOK_EVENT_IDS
from hostgauge.operators import filters, monitor
from hostgauge.schemas import EVENT_COLUMNS, conform
from hostgauge.sources import events as store, logs

INGEST = dt.datetime(2024, 5, 1, 12, 0, 0, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="module")
def names(spark):
    from hostgauge.session import materialize

    calls = {"read": 0, "openat": 257, "execve": 59, **HOOK_EVENT_IDS}
    return materialize(spark.createDataFrame(list(calls.items()), "event_name string, event_id int"))


def lines(spark, *text):
    return spark.createDataFrame([(i, t, INGEST) for i, t in enumerate(text)], "i int, value string, ingest_ts timestamp")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


AUDIT = (
    'type=SYSCALL msg=audit(1.5:2): arch=c000003e syscall=59 success=no exit=-13 a0=7f a1=1 items=2 '
    'ppid=10 pid=11 auid=1000 uid=33 gid=33 comm="sh"'
)


def test_auditd_record(spark, names):
    r = one(logs.ingest_auditd(lines(spark, AUDIT), names, "box"))
    assert (r["returnValue"], r["argsNum"], r["processId"], r["parentProcessId"]) == (-13, 2, 11, 10)
    assert (r["userId"], r["uid"], r["auid"]) == (33, 33, 1000)
    assert (r["eventName"], r["processName"], r["hostName"], r["timestamp"]) == ("execve", "sh", "box", 1.5)
    assert not r["time_from_ingest"]
    assert one(logs.ingest_auditd(lines(spark, AUDIT), names, uid_source="auid"))["userId"] == 1000


@pytest.mark.parametrize("line,expected", [
    (AUDIT.replace("success=no exit=-13", "success=no exit=7"), -7),
    (AUDIT.replace("success=no exit=-13", "success=YES exit=7"), 7),
    (AUDIT.replace("success=no exit=-13", "success=yes exit=-2"), -2),
])
def test_auditd_return_value(spark, names, line, expected):
    assert one(logs.ingest_auditd(lines(spark, line), names))["returnValue"] == expected


def test_auditd_drops_other_lines(spark, names):
    other = ["", "noise", AUDIT.replace("SYSCALL", "PATH"), AUDIT.replace(' comm="sh"', ""), AUDIT.replace("type=SYSCALL", "type=syscall")]
    assert logs.ingest_auditd(lines(spark, *other), names).count() == 0


def test_auditd_unknown_call_and_missing_time(spark, names):
    r = one(logs.ingest_auditd(lines(spark, AUDIT.replace("syscall=59", "syscall=999").replace("msg=audit(1.5:2): ", "")), names))
    assert r["eventName"] == "syscall_999" and r["time_from_ingest"] and r["timestamp"] == INGEST.timestamp()


def test_audit_pairs(spark):
    r = one(logs.ingest_audit_kv(lines(spark, AUDIT), "hp"))
    assert (r["userId"], r["eventId"], r["eventName"], r["returnValue"], r["timestamp"]) == (33, 59, "execve", -13, 1.5)
    assert (r["argsNum"], r["args"], r["mountNamespace"]) == (0, "[]", 0)


def test_audit_pairs_defaults_and_last_wins(spark):
    r = one(logs.ingest_audit_kv(lines(spark, "type=SYSCALL pid=1 syscall=x7 pid=2")))
    assert (r["processId"], r["userId"], r["eventId"], r["eventName"], r["timestamp"]) == (2, -1, 0, "syscall_x7", 0.0)


def probe(spark, names, obj, **kw):
    text = obj if isinstance(obj, str) else json.dumps(obj)
    return logs.ingest_probe_json(lines(spark, text), names, "me", **kw)


def test_probe_plain(spark, names):
    r = one(probe(spark, names, {
        "timestamp": "2024-01-02T03:04:05Z", "eventName": "OPENAT", "eventId": 0, "returnValue": None,
        "args": [{"name": "p", "type": "c", "value": True}, 5, {"value": None}, {"value": 7}, {}],
        "context": {"pid": 3, "comm": "sh", "hostname": "h1"}, "processId": 9, "userId": 4, "hostName": "top",
    }))
    assert (r["eventId"], r["eventName"], r["returnValue"], r["argsNum"]) == (257, "OPENAT", 0, 5)
    assert [a["value"] for a in json.loads(r["args"])] == ["True", "None", "7", ""]
    assert (r["processId"], r["userId"], r["processName"], r["hostName"]) == (3, 4, "sh", "h1")
    assert r["timestamp"] == dt.datetime(2024, 1, 2, 3, 4, 5, tzinfo=dt.timezone.utc).timestamp()


def test_probe_wrapped_and_flat_context(spark, names):
    r = one(probe(spark, names, {"event": {"event_name": "execve", "context": "none", "pid": 8, "uid": 5, "hostName": "h2", "ts": 12.5}}))
    assert (r["eventId"], r["processId"], r["userId"], r["hostName"], r["timestamp"]) == (59, 8, 5, "h2", 12.5)


def test_probe_legacy(spark, names):
    r = one(probe(spark, names, {"syscall": "execve", "pid": 1, "uid": 2, "ret": -1, "args": ["a", "b"], "timestamp": 3}))
    assert (r["eventId"], r["returnValue"], r["argsNum"], r["args"], r["hostName"]) == (59, -1, 2, '["a","b"]', "me")


def test_probe_time_unit(spark, names):
    assert one(probe(spark, names, {"eventId": 59, "timestamp": 5_000_000_000}, time_unit=1e-9))["timestamp"] == 5.0


@pytest.mark.parametrize("text", ["", "   ", "{bad", "[1]", "7", '{"foo":1}', '{"eventId":1} tail'])
def test_probe_drops(spark, names, text):
    assert probe(spark, names, text).count() == 0


def test_envelopes(spark):
    data = ['[{"eventId":59,"args":"[]","hostName":"liar"},{"eventId":3,"args":[]}]', "[]", "{bad", '{"eventId":1}', None, '[{"eventId":1}] x']
    rows = [("events.web.events.1", str(i), INGEST, d) for i, d in enumerate(data)]
    out = store.decode_batches(spark.createDataFrame(rows, store.ENVELOPE_SCHEMA)).orderBy("pos").collect()
    assert [(r["hostName"], r["pos"], r["eventId"], r["args"]) for r in out] == [("web.events.1", 0, 59, "[]"), ("web.events.1", 1, 3, "[]")]


def test_conform_and_read(spark, tmp_path):
    path = str(tmp_path / "day.csv")
    (tmp_path / "day.csv").write_text(
        "eventId,mountNamespace,userId,processName,extra\n59,4026531840,1e3,bash,1\nx,4026531840,1,sh,2\n3,,1,sh,3\n3.0,1,bad,,4\n"
    )
    rows = store.read_events(spark, path, "csv").orderBy("eventId").collect()
    assert [(r["eventId"], r["userId"], r["processName"]) for r in rows] == [(3, None, None), (59, 1000, "bash")]
    assert store.missing_columns(spark.read.option("header", True).csv(path))[:2] == ["timestamp", "processId"]
    with pytest.raises(ValueError):
        store.read_events(spark, path, "csv", strict=["argsNum"])
    hosts = store.with_host_from_path(spark.read.option("header", True).csv(path)).select("hostName").distinct().collect()
    assert [r[0] for r in hosts] == ["day"]


def test_event_table_round_trip(spark, tmp_path):
    from tests.conftest import events

    df = events(spark, [{"args": '[{"value":"a,\\"b\\" c"}]'}, {"hostName": "h2", "eventId": 3}])
    for fmt in ("csv", "parquet"):
        store.write_events(df, str(tmp_path / fmt), fmt)
        back = store.read_events(spark, str(tmp_path / fmt), fmt)
        assert back.columns == EVENT_COLUMNS
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.select(*EVENT_COLUMNS).collect()))


def test_sessions_and_collectors(spark):
    from tests.conftest import events

    df = events(spark, [
        {"hostName": "a", "userId": 1}, {"hostName": "a", "userId": 2}, {"hostName": "b", "userId": 3, "processId": 50},
        {"hostName": "b", "userId": 3, "parentProcessId": 40}, {"hostName": "a", "userId": 1, "processId": 50},
    ])
    sessions = spark.createDataFrame([("a", 1), ("a", 1)], "hostName string, userId bigint")
    assert sorted(r["seq"] for r in filters.remote_sessions_only(df, sessions).collect()) == [0, 2, 3, 4]
    assert sorted(r["seq"] for r in filters.remote_sessions_only(df, sessions, strict=True).collect()) == [0, 4]
    nobody = sessions.where("false")
    assert filters.remote_sessions_only(df, nobody).count() == 5
    collectors = spark.createDataFrame([("b", 50, 40), ("a", 9, 0)], "hostName string, pid bigint, ppid bigint")
    assert sorted(r["seq"] for r in filters.without_collectors(df, collectors).collect()) == [0, 1, 4]


def test_drift_states(spark):
    df = spark.range(300).select(F.col("id").alias("seq"), (F.col("id") * 1_000_000).alias("ts_us"), (F.col("id") / 300).alias("raw_score"))
    assert one(monitor.drift(df.limit(99), 0.1, 0.05))["status"] == "warming-up"
    r = one(monitor.drift(df, 0.1, 0.05))
    assert r["status"] == "drift-suspected" and r["observed_low_pct"] == pytest.approx(10.0)
    assert one(monitor.drift(df, 0.1, 0.05, expected_low_pct=None))["status"] == "ok"
    assert one(monitor.drift(df, 0.1, 0.05, sample=150))["samples"] == 150
    assert one(monitor.drift(df, 0.1, 0.05, sample=150))["score_min"] == 0.5


def test_conform_adds_typed_nulls(spark):
    df = conform(spark.createDataFrame([("7",)], "userId string"))
    assert df.columns == EVENT_COLUMNS and df.first()["userId"] == 7
