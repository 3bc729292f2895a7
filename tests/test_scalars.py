import json
import math

import pytest
from pyspark.sql import functions as F

from hostgauge.fixed_values import FEATURES
from hostgauge.functions import event_features as ef, severity as sv, text
from hostgauge.operators import filters
from hostgauge.operators.model_stats import override_global
from hostgauge.fixed_values import HOOK_EVENT_IDS
from hostgauge.sources.dictionary import stored_dictionary, syscall_dictionary, with_event_id, with_event_name
from tests.conftest import events


def python_blob(args):
    """What the joined argument text is, said in plain Python."""
    try:
        parsed = json.loads(args) if args else []
    except ValueError:
        return ""
    if not isinstance(parsed, list):
        return ""
    values = [a.get("value", "") for a in parsed if isinstance(a, dict)]
    return " ".join(str(v) for v in values if v is not None)


ARGS = [
    None, "", "[]", "[{bad", '{"value":"x"}', '[{"value":null}]', '[{"name":"z"}]', '[{"value":"a"},5,{"value":"b"}]',
    '[{"value":true}]', '[{"value":"true"}]', '[{"value":"żółć"}]', '[{"value":"a"}] tail', '[[{"value":"a"}]]', "null", "7",
    '"text"', '[{"value":""},{"value":"x"}]', '[{"value":12}]', '[{"value":1.5}]', ' [ {"value" : "s p"} ] ',
]


def test_args_blob(spark):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(ARGS)], "i int, args string")
    got = {r["i"]: r["b"] for r in df.select("i", ef.args_blob().alias("b")).collect()}
    for i, a in enumerate(ARGS):
        assert got[i] == python_blob(a), a


@pytest.mark.parametrize("blob,flags", [
    ("/etc/shadow", {"has_sensitive_path"}),
    ("/home/u/.aws/credentials", {"has_sensitive_path", "has_canary_path"}),
    ("x.env y", {"has_canary_path"}),
    ("x.environment", set()),
    ("../../x", {"has_path_traversal"}),
    ("$(id)", {"has_shell_metachar"}),
    ("a && b", {"has_shell_metachar"}),
    ("a & b", set()),
    ("http://x", {"has_url_or_ip"}),
    ("at 10.0.0.1.", {"has_url_or_ip"}),
    ("1234.0.0.1", set()),
    ("", set()),
])
def test_patterns(spark, blob, flags):
    r = spark.createDataFrame([(blob,)], "b string").select(*[c.alias(k) for k, c in ef.blob_features(F.col("b")).items()]).first().asDict()
    assert r.pop("args_total_length") == len(blob)
    assert {k for k, v in r.items() if v == 1.0} == flags


def test_scalar_features_without_columns(spark):
    df = spark.createDataFrame([(59,)], "eventId int")
    r = ef.with_scalar_features(df).first().asDict()
    assert all(r[k] == 0.0 for k in r if k != "eventId")
    assert set(r) - {"eventId"} < set(FEATURES)


NAN = float("nan")


@pytest.mark.parametrize("score,low,high,expected", [
    (-0.2, -0.02, -0.1, 2), (-0.1, -0.02, -0.1, 1), (-0.02, -0.02, -0.1, 0), (0.5, -0.02, -0.1, 0), (-9.0, NAN, -0.1, 0),
    (-9.0, -0.1, NAN, 0), (-9.0, None, -0.1, 0), (0.0, -0.0, -1.0, 0), (-0.5, -0.9, -0.1, 2),
])
def test_severity(spark, score, low, high, expected):
    df = spark.createDataFrame([(score, low, high)], "s double, l double, h double")
    assert df.select(sv.severity(F.col("s"), F.col("l"), F.col("h"))).first()[0] == expected


@pytest.mark.parametrize("name,sev,fold,cap", [
    ("snapd", 2, False, 0), ("snapd", 0, False, 0), ("SNAPD", 2, False, 0), ("sshd", 2, False, 1), ("sshd", 1, False, None),
    ("Xorg", 2, False, None), ("Xorg", 2, True, 0), (None, 2, False, None), ("bash", 2, False, None),
])
def test_caps(spark, name, sev, fold, cap):
    df = spark.createDataFrame([(name, sev)], "processName string, s int")
    c = sv.capped_at(F.col("s"), fold_case=fold)
    r = df.select(c.alias("c"), sv.apply_cap(F.col("s"), c).alias("s")).first()
    assert r["c"] == cap and r["s"] == (sev if cap is None else cap)


def test_thread_flag(spark):
    df = events(spark, [{"threadId": None}, {"threadId": 0}, {"threadId": 1235}, {}])
    r = df.select(ef.is_thread_event().alias("s"), ef.is_thread_event(True).alias("t")).collect()
    assert [(x["s"], x["t"]) for x in r] == [(0, 1), (0, 1), (1, 1), (0, 0)]


def test_entity_keys(spark):
    df = events(spark, [{"userId": 4294967295}, {"userId": None, "hostName": None}])
    r = [tuple(x) for x in df.select(*[ef.entity_key(m) for m in ("user", "host_user", "host")]).collect()]
    assert r == [("4294967295", "test-host:4294967295", "test-host"), ("UNKNOWN_USER", "UNKNOWN_HOST:UNKNOWN_USER", "UNKNOWN")]
    with pytest.raises(ValueError):
        ef.entity_key("team")


def test_trigger_rounds_half_to_even(spark):
    df = spark.createDataFrame([(1, 8), (3, 8), (3, 3)], "a int, b int")
    got = [r[0] for r in df.select(text.trigger_text(F.col("a"), F.col("b"))).collect()]
    assert got == [f"rate+threshold (sev2={a}/{b}={a / b:.0%})" for a, b in [(1, 8), (3, 8), (3, 3)]]


def test_time_since(spark):
    df = spark.createDataFrame([(None, 9.0), (0.0, 9.0), (100.0, 159.9), (100.0, 160.0), (100.0, 400.0)], "t double, n double")
    got = [r[0] for r in df.select(text.time_since(F.col("t"), F.col("n"))).collect()]
    assert got == ["never", "never", "59s ago", "1m ago", "5m ago"]


def test_gauges(spark):
    df = spark.createDataFrame([(3, 0.3), (4, 0.21), (9, 0.1)], "c int, r double")
    got = df.select(text.count_gauge(F.col("c")), text.rate_gauge(F.col("r"))).collect()
    assert [(a, round(b, 6)) for a, b in got] == [(60.0, 100.0), (80.0, 70.0), (100.0, 33.333333)]


def test_override():
    assert override_global(None) == {"low": -0.02, "high": -0.10}
    assert override_global({"low": 0.1, "high": 0.0}, high=-0.15) == {"low": 0.1, "high": -0.15}


def test_whitelist(spark):
    ids = [0, 1, 32, 33, 64, 65, 66, 99, 100, 125, 126, 992, 993, 998, 999, 1500]
    df = spark.createDataFrame([(i,) for i in ids], "userId bigint")
    assert [r[0] for r in filters.tracked_users(df).collect()] == [33, 64, 66, 99, 126, 992, 999, 1500]
    assert filters.parse_extra_users("33, 7x,,999") == [33, 999]


def test_labels_required(spark):
    df = spark.createDataFrame([(1,)], "a int")
    for f in (filters.benign, filters.require_labels):
        with pytest.raises(ValueError):
            f(df)


def test_dictionary(spark, tmp_path):
    header = tmp_path / "unistd.h"
    header.write_text("#ifndef X\n#define __NR_read 0\n#define __NR_rt_sigaction 13\n#define  __NR_openat 257\n#define OTHER 5\n")
    found = {r["event_name"]: r["event_id"] for r in syscall_dictionary(spark, str(header)).collect()}
    assert found == {"read": 0, "rt_sigaction": 13, "openat": 257, **HOOK_EVENT_IDS}
    table = str(tmp_path / "table")
    pairs = [(f"call_{i}", i) for i in range(312)] + [("OpenAt", 557), (None, 1), ("x", None)]
    spark.createDataFrame(pairs, "event_name string, event_id int").write.parquet(table)
    d = stored_dictionary(spark, table)
    assert d.count() == 313 + len(HOOK_EVENT_IDS) == 341
    df = spark.createDataFrame([("OpenAt",), ("nope",), (None,), ("call_311",), ("do_exit",)], "eventName string")
    assert [r["eventId"] for r in with_event_id(df, d).collect()] == [557, 0, 0, 311, 1203]
    ids = spark.createDataFrame([(557,), (999,), (0,), (1203,)], "eventId int")
    assert [r["eventName"] for r in with_event_name(ids, d).collect()] == ["openat", "syscall_999", "call_0", "do_exit"]


def test_math_of_log_counts(spark):
    from hostgauge.operators.model_stats import frequency_tables

    df = events(spark, [{"processName": None}, {"processName": "BASH"}, {}, {"mountNamespace": None}])
    got = {(r["table_name"], r["key"]): r["log_count"] for r in frequency_tables(df).collect()}
    assert got["processName", ""] == pytest.approx(math.log(2))
    assert got["processName", "bash"] == pytest.approx(math.log(4))
    assert got["mountNamespace", "4026531840"] == pytest.approx(math.log(4))
