"""Event features: arguments, names, frequencies, windows, and all of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostgauge.fixed_values import ARGS_PATTERNS, FEATURES, NAME_LEXICONS
from hostgauge.functions import event_features as ef, text
from hostgauge.operators.filters import benign
from hostgauge.operators.model_stats import frequency_tables, scaled, scaler_dict, scaler_statistics, with_frequencies
from hostgauge.operators.rolling import with_rolling_features, with_trailing_counts
from hostgauge.plans.features import feature_rows
from hostgauge.queries.registry import DAY_S, DAY_US, T, WEEK_S, WEEK_US, query, rounded
from hostgauge.session import materialize
from hostgauge.sources.tables import table, telemetry


def _in_list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _flag(cond: str) -> str:
    return f"CAST(CASE WHEN {cond} THEN 1 ELSE 0 END AS DOUBLE)"


BLOB_FLAGS = ", ".join(f"{_flag(f'regexp_matches(blob, $${p}$$)')} AS {name}" for name, p in ARGS_PATTERNS.items())
NAME_FLAGS = ", ".join(f"{_flag(f'lower(processName) IN {_in_list(w)}')} AS {name}" for name, w in NAME_LEXICONS.items())
FREQ = """
b AS (SELECT * FROM t WHERE sus = 0 AND evil = 0),
fe AS (SELECT eventId, ln(1 + count(*)) AS f FROM b GROUP BY 1),
fm AS (SELECT mountNamespace, ln(1 + count(*)) AS f FROM b GROUP BY 1),
fp AS (SELECT lower(processName) AS p, ln(1 + count(*)) AS f FROM b GROUP BY 1)"""


def rolling_sql(rows: str, window_us: int, gap_us: int | None = None) -> str:
    """Windows as a self join, which spells out the frame row by row."""
    gap = "x.ts_us - p.ts_us" if gap_us is None else f"CASE WHEN x.ts_us - p.ts_us <= {gap_us} THEN x.ts_us - p.ts_us END"
    return f"""
w AS (
  SELECT x.seq, CAST(count(*) AS DOUBLE) AS syscall_rate_5s, CAST(count(DISTINCT y.eventId) AS DOUBLE) AS unique_syscalls_5s,
         CAST(sum(CASE WHEN y.returnValue < 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS failed_call_ratio_5s
  FROM {rows} x JOIN {rows} y
    ON x.hostName = y.hostName AND x.userId = y.userId AND x.processId = y.processId
   AND y.ts_us >= x.ts_us - {window_us} AND (y.ts_us < x.ts_us OR (y.ts_us = x.ts_us AND y.seq <= x.seq))
  GROUP BY 1
),
o AS (SELECT *, lag(seq) OVER (PARTITION BY hostName, userId, processId ORDER BY ts_us, seq) AS prev FROM {rows}),
i AS (SELECT x.seq, coalesce(({gap}) / 1000, 0.0) AS inter_arrival_ms FROM o x LEFT JOIN {rows} p ON p.seq = x.prev)"""


@query("args_features", f"""
WITH {T}, x AS (
  SELECT seq, CASE seq % 6 WHEN 0 THEN '' WHEN 1 THEN arg || ' ' || ' ' || arg WHEN 2 THEN '' WHEN 3 THEN arg
                           WHEN 4 THEN '5 True ' || arg ELSE arg END AS blob FROM t
)
SELECT seq, blob, CAST(length(blob) AS DOUBLE) AS args_total_length, {BLOB_FLAGS} FROM x
""")
def args_features(spark, sf_dir):
    """The values joined and searched, for good, odd and broken argument text."""
    e = telemetry(spark, sf_dir)
    obj = F.expr("substring(args, 2, length(args) - 2)")
    kind = F.col("seq") % 6
    args = (
        F.when(kind == 0, F.when(F.col("seq") % 4 == 0, "[{bad").otherwise("[]"))
        .when(kind == 1, F.concat(F.lit("["), obj, F.lit(',{"name":"z"},7,{"value":null},'), obj, F.lit("]")))
        .when(kind == 2, obj)
        .when(kind == 3, F.concat(F.lit("["), obj, F.lit(',"text",null]')))
        .when(kind == 4, F.concat(F.lit('[{"value":5},{"value":true},'), obj, F.lit("]")))
        .otherwise(F.col("args"))
    )
    rows = e.select("seq", ef.args_blob(args).alias("blob"))
    return rows.withColumns(ef.blob_features(F.col("blob")))


@query("document_text_flags", f"""
WITH x AS (SELECT doc_id, text AS blob FROM documents)
SELECT doc_id, CAST(length(blob) AS DOUBLE) AS args_total_length, {BLOB_FLAGS} FROM x
""")
def document_text_flags(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", *[c.alias(k) for k, c in ef.blob_features(F.col("text")).items()])


@query("process_name_flags", f"""
WITH {T} SELECT seq, {NAME_FLAGS} FROM (SELECT seq, CASE WHEN seq % 10 = 3 THEN NULL ELSE processName END AS processName FROM t)
""")
def process_name_flags(spark, sf_dir):
    e = telemetry(spark, sf_dir).select(
        "seq", F.when(F.col("seq") % 10 != 3, F.initcap("processName")).alias("processName")
    )
    return e.select("seq", *[c.alias(k) for k, c in ef.name_features().items()])


@query("thread_flag", f"""
WITH {T}
SELECT seq,
       CASE WHEN seq % 4 <> 0 AND threadId <> processId THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS serving,
       CASE WHEN seq % 4 = 0 THEN (CASE WHEN processId <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
            WHEN threadId <> processId THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS training
FROM t
""")
def thread_flag(spark, sf_dir):
    e = telemetry(spark, sf_dir).withColumn("threadId", F.when(F.col("seq") % 4 != 0, F.col("threadId")))
    return e.select("seq", ef.is_thread_event().alias("serving"), ef.is_thread_event(True).alias("training"))


@query("frequency_lookup", f"""
WITH {T}, {FREQ}
SELECT seq, round(coalesce(fe.f, 0), 6) AS eventId_freq, round(coalesce(fm.f, 0), 6) AS mountNamespace_freq,
       round(coalesce(fp.f, 0), 6) AS processName_freq
FROM t LEFT JOIN fe USING (eventId) LEFT JOIN fm USING (mountNamespace) LEFT JOIN fp ON lower(t.processName) = fp.p
""")
def frequency_lookup(spark, sf_dir):
    e = telemetry(spark, sf_dir)
    tables = materialize(frequency_tables(benign(e)))
    found = with_frequencies(e.select("seq", "eventId", "mountNamespace", "processName"), tables)
    cols = ["eventId_freq", "mountNamespace_freq", "processName_freq"]
    return rounded(found.select("seq", *cols), 6, *cols)


@query("entity_keys", f"""
WITH {T}
SELECT seq,
       CASE WHEN seq % 7 = 0 THEN 'UNKNOWN_USER' ELSE CAST(userId AS VARCHAR) END AS by_user,
       CASE WHEN seq % 5 = 0 THEN 'UNKNOWN_HOST' ELSE hostName END || ':' ||
       CASE WHEN seq % 7 = 0 THEN 'UNKNOWN_USER' ELSE CAST(userId AS VARCHAR) END AS by_host_user,
       CASE WHEN seq % 5 = 0 THEN 'UNKNOWN' ELSE hostName END AS by_host
FROM t
""")
def entity_keys(spark, sf_dir):
    e = telemetry(spark, sf_dir).withColumns({
        "userId": F.when(F.col("seq") % 7 != 0, F.col("userId")),
        "hostName": F.when(F.col("seq") % 5 != 0, F.col("hostName")),
    })
    return e.select("seq", *[ef.entity_key(m).alias(f"by_{m}") for m in ("user", "host_user", "host")])


@query("legacy_features", f"""
WITH {T}
SELECT seq, CAST(processId AS DOUBLE) AS processId, CAST(parentProcessId AS DOUBLE) AS parentProcessId,
       CAST(userId AS DOUBLE) AS userId, CAST(mountNamespace AS DOUBLE) AS mountNamespace,
       CAST(eventId AS DOUBLE) AS eventId, CAST(argsNum AS DOUBLE) AS argsNum, CAST(returnValue AS DOUBLE) AS returnValue
FROM t WHERE seq % 8 <> 0
""")
def legacy_features(spark, sf_dir):
    e = telemetry(spark, sf_dir).withColumn("argsNum", F.when(F.col("seq") % 8 != 0, F.col("argsNum")))
    return ef.legacy_vector(e, "seq")


@query("lenient_numbers", f"""
WITH {T}
SELECT seq, CASE WHEN seq % 3 = 0 THEN NULL ELSE value END AS value,
       CASE WHEN seq % 3 = 0 THEN 0.0 ELSE value END AS zero_filled FROM t
""")
def lenient_numbers(spark, sf_dir):
    shown = F.when(F.col("seq") % 3 == 0, "abc").otherwise(F.col("value").cast("string"))
    e = telemetry(spark, sf_dir).select("seq", shown.try_cast("double").alias("value"))
    return e.withColumn("zero_filled", ef.zero_if_null("value"))


@query("event_times", f"""
WITH {T}
SELECT seq, CASE WHEN seq % 4 = 3 THEN ts_us + 9000000 WHEN seq % 4 = 1 THEN ts_us - 7200000000 ELSE ts_us END AS ts_us FROM t
""")
def event_times(spark, sf_dir):
    """ISO text with and without offset, numbers, and text that is no time."""
    e = telemetry(spark, sf_dir)
    utc = F.to_utc_timestamp(F.timestamp_micros("ts_us"), F.current_timezone())
    iso = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    kind = F.col("seq") % 4
    shown = (
        F.when(kind == 0, iso).when(kind == 1, F.concat(iso, F.lit("+02:00")))
        .when(kind == 2, F.col("timestamp").cast("decimal(20,6)").cast("string")).otherwise("yesterday")
    )
    seconds = text.epoch_seconds(shown, (F.col("ts_us") + 9_000_000) / 1_000_000)
    return e.select("seq", F.round(seconds * 1e6).cast("bigint").alias("ts_us"))


@query("rolling_features", f"""
WITH {T}, {rolling_sql('t', DAY_US)}
SELECT seq, syscall_rate_5s, unique_syscalls_5s, round(failed_call_ratio_5s, 6) AS failed_call_ratio_5s,
       round(inter_arrival_ms, 3) AS inter_arrival_ms
FROM w JOIN i USING (seq)
""")
def rolling_features(spark, sf_dir):
    rows = with_rolling_features(telemetry(spark, sf_dir), DAY_S)
    out = rows.select("seq", "syscall_rate_5s", "unique_syscalls_5s", "failed_call_ratio_5s", "inter_arrival_ms")
    return rounded(rounded(out, 6, "failed_call_ratio_5s"), 3, "inter_arrival_ms")


@query("serving_rolling_features", f"""
WITH {T}, {rolling_sql('t', DAY_US, 2 * DAY_US)}
SELECT seq, syscall_rate_5s, unique_syscalls_5s, round(failed_call_ratio_5s, 6) AS failed_call_ratio_5s,
       round(inter_arrival_ms, 3) AS inter_arrival_ms
FROM w JOIN i USING (seq)
""")
def serving_rolling_features(spark, sf_dir):
    rows = with_rolling_features(telemetry(spark, sf_dir), DAY_S, max_gap_s=2 * DAY_S, bucket_windows=2)
    out = rows.select("seq", "syscall_rate_5s", "unique_syscalls_5s", "failed_call_ratio_5s", "inter_arrival_ms")
    return rounded(rounded(out, 6, "failed_call_ratio_5s"), 3, "inter_arrival_ms")


@query("rolling_defaults", f"""
WITH {T} SELECT seq, 1.0::DOUBLE AS syscall_rate_5s, 1.0::DOUBLE AS unique_syscalls_5s, 0.0::DOUBLE AS failed_call_ratio_5s,
                0.0::DOUBLE AS inter_arrival_ms FROM t
""")
def rolling_defaults(spark, sf_dir):
    return with_rolling_features(telemetry(spark, sf_dir).select("seq"))


@query("trailing_counts", f"""
WITH {T}
SELECT x.seq, count(*) AS total_count, CAST(sum(CASE WHEN y.sus = 1 THEN 1 ELSE 0 END) AS BIGINT) AS match_count
FROM t x JOIN t y ON x.hostName = y.hostName AND x.userId = y.userId AND y.ts_us >= x.ts_us - {WEEK_US}
 AND (y.ts_us < x.ts_us OR (y.ts_us = x.ts_us AND y.seq <= x.seq))
GROUP BY 1
""")
def trailing_counts(spark, sf_dir):
    e = telemetry(spark, sf_dir).select("hostName", "userId", "ts_us", "seq", "sus")
    return with_trailing_counts(e, ["hostName", "userId"], F.col("sus") == 1, WEEK_S).select(
        "seq", "total_count", "match_count"
    )


_FEATURES_SQL = f"""
WITH {T}, {FREQ}, {rolling_sql('t', DAY_US)},
f AS (
  SELECT t.seq, t.sus, t.evil, CAST(argsNum AS DOUBLE) AS argsNum, CAST(returnValue AS DOUBLE) AS returnValue,
         coalesce(fe.f, 0) AS eventId_freq, coalesce(fm.f, 0) AS mountNamespace_freq, coalesce(fp.f, 0) AS processName_freq,
         CAST(length(arg) AS DOUBLE) AS args_total_length, {BLOB_FLAGS.replace('(blob,', '(arg,')}, {NAME_FLAGS},
         syscall_rate_5s, unique_syscalls_5s, failed_call_ratio_5s, inter_arrival_ms,
         CASE WHEN threadId <> processId THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_thread_event
  FROM t JOIN w USING (seq) JOIN i USING (seq)
  LEFT JOIN fe USING (eventId) LEFT JOIN fm USING (mountNamespace) LEFT JOIN fp ON lower(t.processName) = fp.p
)"""


def all_features(spark, sf_dir, keep=("seq",)):
    e = telemetry(spark, sf_dir)
    return feature_rows(e, materialize(frequency_tables(benign(e))), list(keep), window_s=DAY_S)


@query("event_features", _FEATURES_SQL + "SELECT seq, " + ", ".join(f"round({c}, 3) AS {c}" for c in FEATURES) + " FROM f")
def event_features(spark, sf_dir):
    return rounded(all_features(spark, sf_dir), 3, *FEATURES)


@query("scaler_statistics", _FEATURES_SQL + "".join(
    f"{'UNION ALL ' if n else ''}SELECT '{c}' AS feature, round(avg({c}), 3) AS mean, "
    f"round(CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END, 3) AS std FROM f WHERE sus = 0 AND evil = 0 "
    for n, c in enumerate(FEATURES)
))
def scaler_stats(spark, sf_dir):
    stats = scaler_statistics(benign(all_features(spark, sf_dir, ["sus", "evil"])))
    return rounded(stats, 3, "mean", "std")


_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("scaled_columns", "WITH m AS (SELECT " + ", ".join(
    f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in _LINE
) + " FROM lineitem) SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round((l.{c} - a_{c}) / s_{c}, 6) AS {c}" for c in _LINE
) + " FROM lineitem l, m")
def scaled_columns(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.col(c).cast("double") for c in _LINE])
    out = scaled(lines, scaler_dict(scaler_statistics(lines, _LINE)))
    return rounded(out, 6, *_LINE)
