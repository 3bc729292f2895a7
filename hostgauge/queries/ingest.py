"""Reading, decoding, filtering and storing events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from hostgauge.functions.columns import once
from hostgauge.operators import filters
from hostgauge.queries.registry import S, T, graded_sql, query
from hostgauge.schemas import EVENT_COLUMNS
from hostgauge.session import materialize, shared_folder
from hostgauge.sources import dictionary as names, events as store, logs
from hostgauge.sources.tables import telemetry, with_surrogate_score
from hostgauge.queries.statistics import graded_events


def _event_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(names.learned_dictionary(telemetry(spark, sf_dir)))


@query("read_events", f"""
WITH {T}
SELECT seq, CASE WHEN seq % 9 = 0 THEN NULL ELSE argsNum END AS argsNum, eventId, mountNamespace,
       CASE WHEN seq % 5 = 0 THEN NULL ELSE returnValue END AS returnValue, processName, NULL::VARCHAR AS args
FROM t WHERE seq % 7 <> 0 AND seq % 11 <> 0
""")
def read_events(spark, sf_dir):
    """A table of text columns with bad numbers and without ``args``, made whole."""
    e = telemetry(spark, sf_dir)
    text = e.select(
        "seq",
        F.when(F.col("seq") % 7 == 0, "n/a").otherwise(F.col("eventId").cast("string")).alias("eventId"),
        F.when(F.col("seq") % 11 != 0, F.concat(F.col("mountNamespace").cast("string"), F.lit(".0"))).alias("mountNamespace"),
        F.when(F.col("seq") % 9 == 0, "x1").otherwise(F.col("argsNum").cast("string")).alias("argsNum"),
        F.when(F.col("seq") % 5 == 0, "").otherwise(F.col("returnValue").cast("string")).alias("returnValue"),
        "processName",
    )
    tidy = store.tidy_events(text)
    return tidy.select("seq", "argsNum", "eventId", "mountNamespace", "returnValue", "processName", "args")


@query("host_from_file_name", f"WITH {T} SELECT hostName, count(*) AS n FROM t GROUP BY 1")
def host_from_file_name(spark, sf_dir):
    e = telemetry(spark, sf_dir)
    suffix = F.when(F.col("seq") % 2 == 0, ".csv").otherwise(".CSV")
    path = F.concat(F.lit("file:/logs/day.csv/"), "hostName", suffix)
    return e.groupBy(store.host_from_file(path).alias("hostName")).agg(F.count(F.lit(1)).alias("n"))


# -- probe JSON ---------------------------------------------------------------------------


def probe_lines(e: DataFrame) -> DataFrame:
    """Every event as a line in one of the shapes; the fifth kind is junk."""
    args = F.array(F.struct(F.lit("p").alias("name"), F.lit("t").alias("type"), F.get_json_object("args", "$[0].value").alias("value")))
    iso = F.concat(
        F.date_format(F.to_utc_timestamp(F.timestamp_micros("ts_us"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")
    )
    plain = F.to_json(F.struct(
        F.col("timestamp"), "eventName", "eventId", args.alias("args"), "returnValue",
        F.struct(
            F.col("processId").alias("pid"), F.col("threadId").alias("tid"), F.col("parentProcessId").alias("ppid"),
            F.col("userId").alias("uid"), F.col("mountNamespace").alias("mntNS"), F.col("processName").alias("comm"), "hostName",
        ).alias("context"),
    ))
    wrapped = F.to_json(F.struct(F.struct(
        iso.alias("ts"), F.upper("eventName").alias("event_name"), args.alias("arguments"), F.col("returnValue").alias("retval"),
        F.struct("processId", "threadId", "parentProcessId", "userId", "mountNamespace", "processName", F.col("hostName").alias("hostname")).alias("processContext"),
    ).alias("event")))
    legacy = F.to_json(F.struct(
        F.col("eventName").alias("syscall"), "timestamp", F.col("processId").alias("pid"), F.col("parentProcessId").alias("ppid"),
        F.col("userId").alias("uid"), F.col("mountNamespace").alias("mnt_ns"), F.col("processName").alias("comm"),
        F.col("returnValue").alias("ret"), F.array(F.lit("a"), F.lit("b")).alias("args"),
    ))
    flat = F.to_json(F.struct(
        F.lit(0).alias("eventId"), "eventName", F.lit("none").alias("context"), "processId", F.col("threadId").alias("tid"),
        "userId", "hostName", F.lit("oops").alias("ts"), F.lit("text").alias("returnValue"),
    ))
    junk = F.when(F.col("seq") % 2 == 0, '{"foo":1}').otherwise("{bad")
    kind = F.col("seq") % 5
    line = F.when(kind == 0, plain).when(kind == 1, wrapped).when(kind == 2, legacy).when(kind == 3, flat).otherwise(junk)
    ingested = F.timestamp_micros(F.col("ts_us") + 1_000_000)
    return e.select("seq", once(F.concat(F.lit("  "), line)).alias("value"), ingested.alias("ingest_ts"))


@query("probe_json_ingest", f"""
WITH {T}, x AS (SELECT *, seq % 5 AS kind FROM t WHERE seq % 5 < 4)
SELECT seq,
       CASE WHEN kind = 3 THEN ts_us + 1000000 ELSE ts_us END AS ts_us,
       processId,
       CASE WHEN kind = 2 THEN 0 ELSE threadId END AS threadId,
       CASE WHEN kind = 3 THEN 0 ELSE parentProcessId END AS parentProcessId,
       userId,
       CASE WHEN kind = 3 THEN 0 ELSE mountNamespace END AS mountNamespace,
       CASE WHEN kind = 3 THEN '' ELSE processName END AS processName,
       CASE WHEN kind = 2 THEN 'here' ELSE hostName END AS hostName,
       eventId,
       CASE WHEN kind = 1 THEN upper(eventName) ELSE eventName END AS eventName,
       CASE WHEN kind = 3 THEN 0 WHEN kind = 2 THEN 2 ELSE 1 END AS argsNum,
       CASE WHEN kind = 3 THEN 0 ELSE returnValue END AS returnValue,
       CASE WHEN kind = 3 THEN '[]' WHEN kind = 2 THEN '["a","b"]'
            ELSE '[{{"name":"p","type":"t","value":"' || arg || '"}}]' END AS args,
       kind = 3 AS time_from_ingest
FROM x
""")
def probe_json_ingest(spark, sf_dir):
    lines = probe_lines(telemetry(spark, sf_dir))
    out = logs.ingest_probe_json(lines, _event_names(spark, sf_dir), "here", keep=("seq",))
    return out.withColumn("ts_us", F.round(F.col("timestamp") * 1e6).cast("bigint")).drop(
        "timestamp", "stackAddresses", "sus", "evil"
    )


# -- audit lines ----------------------------------------------------------------------------


def audit_lines(e: DataFrame) -> DataFrame:
    """Every event as an audit record. Some lack the time, some the command."""
    seconds = F.concat(
        F.floor(F.col("ts_us") / 1_000_000).cast("string"), F.lit("."),
        F.lpad((F.col("ts_us") % 1_000_000).cast("string"), 6, "0"),
    )
    stamp = F.when(F.col("seq") % 13 == 0, "").otherwise(
        F.concat(F.lit(" msg=audit("), seconds, F.lit(":"), F.col("seq").cast("string"), F.lit("):"))
    )
    comm = F.when(F.col("seq") % 11 == 0, "").otherwise(F.concat(F.lit(' comm="'), "processName", F.lit('"')))
    line = F.concat(
        F.when(F.col("seq") % 17 == 0, "type=PATH").otherwise("type=SYSCALL"), stamp,
        F.lit(" arch=c000003e syscall="), F.col("eventId").cast("string"),
        F.lit(" success="), F.when(F.col("seq") % 3 == 0, "no").otherwise("yes"),
        F.lit(" exit="), F.col("returnValue").cast("string"),
        F.lit(" a0=7f a1=1"), F.when(F.col("seq") % 2 == 0, " a2=0").otherwise(""),
        F.lit(" items=2 ppid="), F.col("parentProcessId").cast("string"),
        F.lit(" pid="), F.col("processId").cast("string"),
        F.lit(" auid="), (F.col("userId") + 1000).cast("string"),
        F.lit(" uid="), F.col("userId").cast("string"), F.lit(" gid=33"), comm,
    )
    return e.select("seq", once(line).alias("value"), F.timestamp_micros(F.col("ts_us") + 1_000_000).alias("ingest_ts"))


@query("auditd_ingest", f"""
WITH {T}
SELECT seq, CASE WHEN seq % 13 = 0 THEN ts_us + 1000000 ELSE ts_us END AS ts_us,
       processId, parentProcessId, userId, userId + 1000 AS auid, processName, 'here' AS hostName, eventId, eventName,
       2 + CASE WHEN seq % 2 = 0 THEN 1 ELSE 0 END AS argsNum,
       CASE WHEN seq % 3 = 0 THEN -abs(returnValue) ELSE returnValue END AS returnValue,
       seq % 13 = 0 AS time_from_ingest
FROM t WHERE seq % 17 <> 0 AND seq % 11 <> 0
""")
def auditd_ingest(spark, sf_dir):
    lines = audit_lines(telemetry(spark, sf_dir))
    out = logs.ingest_auditd(lines, _event_names(spark, sf_dir), "here", keep=("seq",))
    return out.select(
        "seq", F.round(F.col("timestamp") * 1e6).cast("bigint").alias("ts_us"), "processId", "parentProcessId", "userId",
        "auid", "processName", "hostName", "eventId", "eventName", "argsNum", "returnValue", "time_from_ingest",
    )


@query("audit_kv_ingest", f"""
WITH {T}
SELECT seq, CASE WHEN seq % 13 = 0 THEN 0 ELSE ts_us END AS ts_us, processId, parentProcessId, userId, eventId,
       CASE eventId WHEN 59 THEN 'execve' WHEN 257 THEN 'openat' ELSE 'syscall_' || eventId END AS eventName,
       0 AS argsNum, returnValue, '[]' AS args
FROM t WHERE seq % 17 <> 0
""")
def audit_kv_ingest(spark, sf_dir):
    out = logs.ingest_audit_kv(audit_lines(telemetry(spark, sf_dir)), "here", keep=("seq",))
    return out.select(
        "seq", F.round(F.col("timestamp") * 1e6).cast("bigint").alias("ts_us"), "processId", "parentProcessId", "userId",
        "eventId", "eventName", "argsNum", "returnValue", "args",
    )


@query("envelope_decode", f"""
WITH {T}
SELECT seq // 100 AS batch, hostName,
       row_number() OVER (PARTITION BY hostName, seq // 100 ORDER BY seq) - 1 AS pos,
       processId, eventId, eventName, returnValue, '[{{"name":"p","type":"t","value":"' || arg || '"}}]' AS args
FROM t
""")
def envelope_decode(spark, sf_dir):
    messages = store.encode_batches(telemetry(spark, sf_dir), F.floor(F.col("seq") / 100))
    broken = messages.withColumn("data", F.concat("data", F.lit(",")))
    empty = messages.withColumn("data", F.lit("[]"))
    out = store.decode_batches(messages.union(broken).union(empty))
    return out.select(
        F.col("msg_id").cast("bigint").alias("batch"), "hostName", F.col("pos").cast("bigint").alias("pos"),
        "processId", "eventId", "eventName", "returnValue", "args",
    )


@query("event_id_lookup", f"""
WITH {T}
SELECT seq, CASE WHEN seq % 4 = 0 THEN 0 ELSE eventId END AS found_id FROM t
""")
def event_id_lookup(spark, sf_dir):
    e = telemetry(spark, sf_dir)
    called = F.when(F.col("seq") % 4 == 0, "no_such_call").otherwise(F.upper("eventName"))
    return names.with_event_id(
        e.select("seq", called.alias("name")), _event_names(spark, sf_dir), "name", "found_id"
    ).select("seq", "found_id")


@query("event_name_lookup", f"""
WITH {T}
SELECT seq, CASE WHEN seq % 4 = 0 THEN 'syscall_' || (eventId + 5000) ELSE eventName END AS found_name FROM t
""")
def event_name_lookup(spark, sf_dir):
    e = telemetry(spark, sf_dir)
    number = F.when(F.col("seq") % 4 == 0, F.col("eventId") + 5000).otherwise(F.col("eventId"))
    return names.with_event_name(
        e.select("seq", number.alias("n")), _event_names(spark, sf_dir), "n", "found_name"
    ).select("seq", "found_name")


def _new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/hostgauge-{what}-{uuid.uuid4().hex}"


@query("event_sink", f"""
WITH {T}
SELECT hostName, count(*) AS n, CAST(sum(processId) AS BIGINT) AS pids, min(eventName) AS first_name,
       CAST(sum(length(arg)) + 36 * count(*) AS BIGINT) AS args_chars, CAST(sum(evil) AS BIGINT) AS evil
FROM t GROUP BY 1
""")
def event_sink(spark, sf_dir):
    """Written as CSV with header, read back."""
    path = _new_folder(spark, "events")
    store.write_events(telemetry(spark, sf_dir), path, "csv")
    back = store.read_events(spark, path, "csv")
    assert back.columns == EVENT_COLUMNS
    return back.groupBy("hostName").agg(
        F.count(F.lit(1)).alias("n"), F.sum("processId").alias("pids"), F.min("eventName").alias("first_name"),
        F.sum(F.length("args")).alias("args_chars"), F.sum("evil").alias("evil"),
    )


@query("prediction_sink", f"""
WITH {graded_sql(20, 10)}
SELECT entity, severity, CASE WHEN severity >= 1 THEN 1 ELSE 0 END AS malicious_pred, count(*) AS n,
       round(sum(score), 6) AS score_sum
FROM g GROUP BY 1, 2
""")
def prediction_sink(spark, sf_dir):
    path = _new_folder(spark, "predictions")
    cols = ["entity", "normality_score", "low_threshold", "high_threshold", "severity", "malicious_pred"]
    rows = graded_events(spark, sf_dir, 20, 10).withColumn("malicious_pred", (F.col("severity") >= 1).cast("int"))
    store.write_predictions(rows.select(*cols), path)
    return spark.read.parquet(path).groupBy("entity", "severity", "malicious_pred").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("normality_score"), 6).alias("score_sum")
    )


# -- filters ------------------------------------------------------------------------------


@query("benign_rows", f"WITH {T} SELECT seq, eventName FROM t WHERE sus = 0 AND evil = 0")
def benign_rows(spark, sf_dir):
    return filters.benign(telemetry(spark, sf_dir)).select("seq", "eventName")


@query("complete_rows", f"WITH {T} SELECT seq FROM t WHERE seq % 6 <> 0 AND seq % 4 <> 0")
def complete_rows(spark, sf_dir):
    e = telemetry(spark, sf_dir).withColumns({
        "eventId": F.when(F.col("seq") % 6 != 0, F.col("eventId")),
        "mountNamespace": F.when(F.col("seq") % 4 != 0, F.col("mountNamespace")),
    })
    return filters.complete(e).select("seq")


@query("without_collectors", f"""
WITH {T}, c AS (SELECT hostName, min(processId) AS pid, CASE WHEN hostName < 'host-3' THEN max(userId) ELSE 0 END AS ppid FROM t GROUP BY 1)
SELECT seq FROM t JOIN c USING (hostName)
WHERE processId <> pid AND parentProcessId <> pid
  AND (ppid = 0 OR (processId <> ppid AND parentProcessId <> ppid))
""")
def without_collectors(spark, sf_dir):
    e = telemetry(spark, sf_dir)
    c = e.groupBy("hostName").agg(
        F.min("processId").alias("pid"),
        F.when(F.col("hostName") < "host-3", F.max("userId")).otherwise(0).alias("ppid"),
    )
    return filters.without_collectors(e, materialize(c)).select("seq")


def _sessions(e: DataFrame) -> DataFrame:
    return materialize(
        e.where((F.col("eventId") == 1000) & (F.col("hostName") != "host-5") & (F.col("argsNum") == 0))
        .select("hostName", "userId")
    )


@query("remote_sessions", f"""
WITH {T}, ses AS (SELECT DISTINCT hostName, userId FROM t WHERE eventId = 1000 AND hostName <> 'host-5' AND argsNum = 0)
SELECT seq FROM t
WHERE EXISTS (SELECT 1 FROM ses WHERE ses.hostName = t.hostName AND ses.userId = t.userId)
   OR NOT EXISTS (SELECT 1 FROM ses WHERE ses.hostName = t.hostName)
""")
def remote_sessions(spark, sf_dir):
    e = telemetry(spark, sf_dir)
    return filters.remote_sessions_only(e, _sessions(e)).select("seq")


@query("remote_sessions_strict", f"""
WITH {T}, ses AS (SELECT DISTINCT hostName, userId FROM t WHERE eventId = 1000 AND hostName <> 'host-5' AND argsNum = 0)
SELECT seq FROM t WHERE EXISTS (SELECT 1 FROM ses WHERE ses.hostName = t.hostName AND ses.userId = t.userId)
""")
def remote_sessions_strict(spark, sf_dir):
    e = telemetry(spark, sf_dir)
    return filters.remote_sessions_only(e, _sessions(e), strict=True).select("seq")


@query("tracked_users", f"""
WITH {T}
SELECT userId, count(*) AS n FROM t
WHERE NOT (userId = 0 OR userId BETWEEN 1 AND 32 OR userId = 65 OR userId BETWEEN 100 AND 125
           OR userId BETWEEN 993 AND 998 OR userId IN (40, 41))
GROUP BY 1
""")
def tracked_users(spark, sf_dir):
    e = filters.tracked_users(telemetry(spark, sf_dir), extra=filters.parse_extra_users("40, x,41,-3"))
    return e.groupBy("userId").agg(F.count(F.lit(1)).alias("n"))


@query("declared_filters", f"""
WITH {T},
f AS (SELECT *, row_number() OVER (PARTITION BY hostName, ts_us // 1000000 ORDER BY ts_us, seq) AS rn FROM t
      WHERE eventName <> 'connect' AND userId NOT IN (7, 8) AND eventId >= 40)
SELECT seq, hostName FROM f WHERE rn <= 1
""")
def declared_filters(spark, sf_dir):
    return filters.declared_filters(
        telemetry(spark, sf_dir), exclude_syscalls=["connect"], exclude_users=[7, 8], min_event_id=40,
        max_events_per_second=1,
    ).select("seq", "hostName")


@query("sampled_events")
def sampled_events(spark, sf_dir):
    """A tenth of the events, the same ones on every run."""
    return filters.declared_filters(telemetry(spark, sf_dir), sampling_rate=0.1, seed=7).select("seq", "hostName")


@query("feed_filter", f"""
WITH {graded_sql(20, 10)}
SELECT seq, entity FROM g WHERE severity = 2 AND hostName = 'host-3'
""")
def feed_filter(spark, sf_dir):
    rows = graded_events(spark, sf_dir, 20, 10).withColumnRenamed("hostName", "hostname")
    return filters.feed(rows, 2, "host-3").select("seq", "entity")


@query("feed_hosts", f"WITH {T} SELECT DISTINCT hostName AS hostname FROM t")
def feed_hosts(spark, sf_dir):
    return filters.feed_hosts(telemetry(spark, sf_dir).withColumnRenamed("hostName", "hostname"))
