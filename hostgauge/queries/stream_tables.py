"""Stream tables: retention, rings, drift, late rows, arrival numbers, sessions, publication. Every batch is published more than once."""

from __future__ import annotations

import uuid
from types import SimpleNamespace

from pyspark.sql import DataFrame, Window, functions as F

from hostgauge.operators import alerts as al
from hostgauge.operators.batching import with_flushes
from hostgauge.operators.ordered import exact_quantiles
from hostgauge.operators.sessions import events_in_sessions
from hostgauge.queries.alerting import GATES, WINDOWS, scored_users
from hostgauge.queries.monitoring import _scores
from hostgauge.queries.registry import DAY_US, S, T, query, rounded
from hostgauge.schemas import EVENT_COLUMNS
from hostgauge.session import materialize, shared_folder
from hostgauge.sources.events import encode_batches, read_events
from hostgauge.sources.storage import Storage
from hostgauge.sources.tables import telemetry
from hostgauge.streaming import jobs, source
from hostgauge.streaming.outbox import Outbox, consumed
from hostgauge.streaming.tables import BatchTable, Keep


def _folder(spark, what: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/hostgauge-{what}-{uuid.uuid4().hex}"


def _result(spark, folder: str, df: DataFrame) -> DataFrame:
    """``df`` on its own; the folder of the tables it was read from goes."""
    out = materialize(df)
    Storage(spark, folder).delete()
    return out


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _publish_in_parts(rows: DataFrame, table: BatchTable, parts: int, keep: Keep | None = None, after=None) -> None:
    """Rows as ``parts`` batches by arrival. Every batch before is published once more, which must change nothing."""
    last = rows.agg(F.max("seq")).first()[0] or 0
    batch = F.floor(F.col("seq") * parts / (last + 1))
    table.prepare()
    for i in range(parts):
        for b in range(i, -1, -1):
            if table.publish(rows.where(batch == b), b) != (b == i):
                raise RuntimeError(f"batch {b} was published twice or not at all")
        if after is not None:
            after(i)
        if keep is not None and (i + 1) % keep.every == 0:
            table.compact(keep)
            table.vacuum(i - 1)  # what reads on is one batch behind
            table.compact(keep)  # nothing new, so nothing happens


def _live_scores(spark, sf_dir) -> DataFrame:
    return materialize(_scores(spark, sf_dir).select("hostname", "ts_us", "seq", "raw_score"))


_NEWEST = f"WITH {S}, n AS (SELECT *, row_number() OVER (PARTITION BY hostName ORDER BY ts_us DESC, seq DESC) AS rn FROM s)"


@query("stream_retention", _NEWEST + " SELECT hostName AS hostname, seq, round(score, 9) AS raw_score FROM n WHERE rn <= 100")
def stream_retention(spark, sf_dir):
    """A table of scores held to its newest 100 rows per host, while batches come and are repeated."""
    folder = _folder(spark, "retention")
    rows = _live_scores(spark, sf_dir)
    table, keep = BatchTable(spark, folder, _schema(rows)), Keep(100, every=2)
    _publish_in_parts(rows, table, 5, keep)
    table.compact(keep)
    return _result(spark, folder, rounded(table.rows().select("hostname", "seq", "raw_score"), 9, "raw_score"))


@query("stream_feed", _NEWEST + """
SELECT hostName AS hostname, count(*) AS seen, least(count(*), 40) AS held, greatest(count(*) - 40, 0) AS dropped,
       min(seq) FILTER (WHERE rn <= 40) AS oldest
FROM n GROUP BY 1
""")
def stream_feed(spark, sf_dir):
    """A feed that holds the last 40 rows of a host and counts what it dropped."""
    folder = _folder(spark, "feed")
    rows = _live_scores(spark, sf_dir)
    table, keep = BatchTable(spark, folder, _schema(rows)), Keep(40, arrival=True, every=2)
    _publish_in_parts(rows, table, 5, keep)
    table.compact(keep)
    oldest = table.rows().groupBy("hostname").agg(F.min("seq").alias("oldest"))
    return _result(spark, folder, table.seen(("hostname",)).join(oldest, "hostname"))


@query("stream_drift", f"""
WITH {S}, th AS (SELECT quantile_cont(score, 0.02) AS low, quantile_cont(score, 0.002) AS high FROM s WHERE sus = 0),
b AS (SELECT s.*, CAST(floor(seq * 6 / (max(seq) OVER () + 1)) AS BIGINT) AS batch FROM s),
n AS (SELECT unnest(range(0, 6)) AS batch_id),
x AS (SELECT batch_id, score, low, high,
             row_number() OVER (PARTITION BY batch_id ORDER BY seq DESC) AS rn FROM n JOIN b ON b.batch <= n.batch_id, th)
SELECT batch_id, count(*) AS samples, round(max(low), 6) AS global_low_threshold, round(max(high), 6) AS global_high_threshold,
       2.0::DOUBLE AS expected_low_pct, 0.2::DOUBLE AS expected_high_pct, 22 AS n_features,
       round(avg(CASE WHEN score < low THEN 100.0 ELSE 0 END), 6) AS observed_low_pct,
       round(avg(CASE WHEN score < high THEN 100.0 ELSE 0 END), 6) AS observed_high_pct, round(avg(score), 6) AS score_mean,
       round(stddev_pop(score), 6) AS score_std, round(min(score), 6) AS score_min, round(max(score), 6) AS score_max,
       CASE WHEN count(*) < 100 THEN 'warming-up' WHEN avg(CASE WHEN score < low THEN 100.0 ELSE 0 END) > 6 THEN 'drift-suspected' ELSE 'ok' END AS status
FROM x WHERE rn <= 2500 GROUP BY 1
""")
def stream_drift(spark, sf_dir):
    """The drift figures after every batch, from sums of whole batches and the oldest one read again."""
    folder = _folder(spark, "drift")
    rows = _live_scores(spark, sf_dir)
    benign = materialize(_scores(spark, sf_dir).where("sus = 0").select("raw_score"))
    th = exact_quantiles(benign, "raw_score", {"low": 0.02, "high": 0.002}).first()
    table = BatchTable(spark, f"{folder}/scores", _schema(rows))
    meta = SimpleNamespace(low_percentile=2.0, high_percentile=0.2)

    def after(i: int) -> None:
        for b in (i, max(i - 1, 0)):
            jobs.publish_drift(spark, table, f"{folder}/drift", b, th["low"], th["high"], meta, 2500)

    _publish_in_parts(rows, table, 6, after=after)
    found = BatchTable(spark, f"{folder}/drift", jobs.DRIFT_ROW).rows()
    return _result(spark, folder, rounded(found, 6, *[c for c in found.columns if c not in ("samples", "status", "batch_id", "n_features")]))


# -- arrival -----------------------------------------------------------------------------

_MESSAGES = f"""
WITH {T},
m AS (SELECT *, seq // 100 AS msg, row_number() OVER (PARTITION BY hostName, seq // 100 ORDER BY seq) - 1 AS pos,
             max(ts_us) OVER (PARTITION BY hostName, seq // 100) AS ingest_us FROM t)"""


def _in_batches(rows: DataFrame, part, parts: int, folder: str, start) -> None:
    """``rows`` as ``parts`` micro-batches, each of as many files as there are tasks. The stream is drained after
    each of them, and goes on from its checkpoint."""
    for i in range(parts):
        rows.where(part == i).write.mode("append").parquet(folder)
        start().awaitTermination()


def _ingest(spark, sf_dir, folder: str, name: str, parts: int, part, **options) -> None:
    """The messages of all hosts to the event table ``folder``/e``name``, in ``parts`` batches."""
    messages = materialize(encode_batches(telemetry(spark, sf_dir), F.floor(F.col("seq") / 100)))
    arrived = f"{folder}/m{name}"
    _in_batches(messages, part(messages), parts, arrived, lambda: jobs.start_ingest(
        source.file_messages(spark, arrived, "parquet"), f"{folder}/e{name}", f"{folder}/c{name}", source.DRAIN, **options
    ))


@query("arrival_numbers", _MESSAGES + """,
a AS (SELECT row_number() OVER (ORDER BY ingest_us, hostName, msg, pos) - 1 AS seq, hostName, ts_us, processId, eventId FROM m)
SELECT a.*, f.parts FROM a, (SELECT unnest([1, 3]) AS parts) f
""")
def arrival_numbers(spark, sf_dir):
    """Events numbered as they arrive: the same numbers for one batch and for three."""
    folder, out = _folder(spark, "arrival"), None

    def by_time(parts: int):
        def part(messages: DataFrame):
            first, last = messages.agg(F.min("ingest_ts"), F.max("ingest_ts")).select(*[F.unix_micros(c) for c in ("min(ingest_ts)", "max(ingest_ts)")]).first()
            return F.floor((F.unix_micros("ingest_ts") - first) * parts / (last - first + 1))
        return part

    for parts in (1, 3):
        _ingest(spark, sf_dir, folder, str(parts), parts, by_time(parts))
        events = jobs.read_table(spark, f"{folder}/e{parts}", jobs.EVENT_TABLE)
        events = events.select("seq", "hostName", "ts_us", "processId", "eventId", F.lit(parts).alias("parts"))
        out = events if out is None else out.unionAll(events)
    return _result(spark, folder, out)


@query("late_events", _MESSAGES + f""",
b AS (SELECT *, (msg * 7 + 3) % 4 AS batch FROM m),
z AS (SELECT batch, max(ts_us) AS newest FROM b GROUP BY 1),
l AS (SELECT b.hostName, b.ts_us, b.processId, b.eventId,
             coalesce(b.ts_us < (SELECT max(newest) FROM z WHERE z.batch < b.batch) - {5 * DAY_US}, false) AS late FROM b)
SELECT * FROM l
""")
def late_events(spark, sf_dir):
    """Four batches of messages out of order: what lies five days behind the newest event of earlier batches goes to the side table."""
    folder = _folder(spark, "late")
    number = F.col("msg_id").cast("bigint")
    _ingest(
        spark, sf_dir, folder, "", 4, lambda _: (number * 7 + 3) % 4, late_path=f"{folder}/late", lateness_s=5 * DAY_US / 1e6
    )
    columns = ["hostName", "ts_us", "processId", "eventId"]
    sides = [
        jobs.read_table(spark, f"{folder}/{name}", jobs.EVENT_TABLE).select(*columns, F.lit(late).alias("late"))
        for name, late in (("e", False), ("late", True))
    ]
    return _result(spark, folder, sides[0].unionAll(sides[1]))


@query("events_by_arrival_time", _MESSAGES + " SELECT hostName, processId, ingest_us AS ts_us, pos FROM m")
def events_by_arrival_time(spark, sf_dir):
    """Events timed by when their message came in."""
    messages = encode_batches(telemetry(spark, sf_dir), F.floor(F.col("seq") / 100))
    events = source.arriving_events(messages, time_col="ingest_ts")
    first = F.min("seq").over(Window.partitionBy("hostName", "msg_id"))
    return events.select("hostName", "processId", "ts_us", (F.col("seq") - first).alias("pos"))


@query("numbered_events", f"""
WITH {T}, n AS (SELECT ts_us, row_number() OVER (ORDER BY seq) - 1 AS place FROM t)
SELECT n.*, fmt FROM n, (SELECT unnest(['parquet', 'csv']) AS fmt) f
""")
def numbered_events(spark, sf_dir):
    """The place of every event in its files, whatever way they are split among tasks."""
    folder, out = _folder(spark, "numbered"), None
    events = telemetry(spark, sf_dir)
    files = max(3, spark.sparkContext.defaultParallelism)
    split = max(100_000, 2 * events.count())  # bytes of some dozens of tasks
    events = events.repartitionByRange(files, "seq").sortWithinPartitions("seq")
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    try:
        for fmt in ("parquet", "csv"):
            events.select(*EVENT_COLUMNS).write.option("header", True).option("escape", '"').format(fmt).save(f"{folder}/{fmt}")
            spark.conf.set(setting, str(split) if fmt == "csv" else before)
            found = read_events(spark, f"{folder}/{fmt}", fmt, escaped=True, numbered=True)
            found = materialize(found.select(F.round(F.col("timestamp") * 1_000_000).cast("bigint").alias("ts_us"), F.col("seq").alias("place"), F.lit(fmt).alias("fmt")))
            out = found if out is None else out.unionAll(found)
    finally:
        spark.conf.set(setting, before)
    return _result(spark, folder, out)


@query("message_flushes", f"""
WITH RECURSIVE {T},
o AS (SELECT hostName, seq, ts_us, row_number() OVER (PARTITION BY hostName ORDER BY ts_us, seq) AS rn FROM t),
r AS (
  SELECT hostName, seq, ts_us, rn, ts_us AS last, 0 AS batch, CAST(NULL AS VARCHAR) AS flushed FROM o WHERE rn = 1
  UNION ALL
  SELECT o.hostName, o.seq, o.ts_us, o.rn,
         CASE WHEN o.rn % 20 = 0 OR o.ts_us - r.last >= {DAY_US // 3} THEN o.ts_us ELSE r.last END,
         CASE WHEN r.flushed IS NULL THEN r.batch ELSE r.batch + 1 END,
         CASE WHEN o.rn % 20 = 0 THEN 'count' WHEN o.ts_us - r.last >= {DAY_US // 3} THEN 'time' END
  FROM r JOIN o ON o.hostName = r.hostName AND o.rn = r.rn + 1
)
SELECT hostName, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n, max(flushed) AS flushed FROM r GROUP BY hostName, batch
""")
def message_flushes(spark, sf_dir):
    """What each host sends at a time: 20 events, or what came within eight hours."""
    found = with_flushes(materialize(telemetry(spark, sf_dir).select("hostName", "seq", "ts_us")), 20, DAY_US / 3e6)
    return found.groupBy("hostName", "batch").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("n"), F.max("flushed").alias("flushed")
    ).drop("batch")


# -- sessions ------------------------------------------------------------------------------

_SESSIONS = f"""
WITH {T},
v AS (SELECT DISTINCT hostName, (ts_us // {DAY_US} + 1) * {DAY_US} AS taken_us, userId FROM t WHERE eventName = 'close' AND userId % 3 <> 0),
h AS (SELECT DISTINCT hostName, taken_us FROM v),
e AS (SELECT t.seq, t.hostName, t.userId, h.taken_us FROM t ASOF LEFT JOIN h ON t.hostName = h.hostName AND t.ts_us >= h.taken_us)
SELECT seq FROM e WHERE taken_us IS NULL OR EXISTS (
  SELECT 1 FROM v WHERE v.hostName = e.hostName AND v.taken_us = e.taken_us AND v.userId = e.userId)"""


def _session_log(events: DataFrame) -> DataFrame:
    """A snapshot per host and day: who closed something the day before."""
    taken = (F.floor(F.col("ts_us") / DAY_US) + 1) * DAY_US
    return events.where("eventName = 'close' and userId % 3 <> 0").select("hostName", taken.alias("taken_us"), "userId").distinct()


@query("session_events", _SESSIONS)
def session_events(spark, sf_dir):
    """Events of users who had a session by the snapshot in force at the event's time."""
    events = materialize(telemetry(spark, sf_dir))
    return events_in_sessions(events, _session_log(events)).select("seq")


@query("stream_session_events", _SESSIONS.replace("SELECT seq FROM e", "SELECT hostName, userId, count(*) AS n FROM e") + " GROUP BY 1, 2")
def stream_session_events(spark, sf_dir):
    """The same from a stream in four batches, whose sessions start and end between and within batches."""
    folder = _folder(spark, "sessions")
    log = materialize(_session_log(telemetry(spark, sf_dir)))
    _ingest(spark, sf_dir, folder, "", 4, lambda _: F.col("msg_id").cast("bigint") % 4, session_log=lambda: log)
    events = jobs.read_table(spark, f"{folder}/e", jobs.EVENT_TABLE)
    return _result(spark, folder, events.groupBy("hostName", "userId").agg(F.count(F.lit(1)).alias("n")))


# -- alerts --------------------------------------------------------------------------------


@query("stream_out_of_order_alerts", WINDOWS + " SELECT * FROM a")
def stream_out_of_order_alerts(spark, sf_dir):
    """The batch alerts, from scores in three batches that lie across each other in time."""
    folder = _folder(spark, "disorder")
    rows = materialize(scored_users(spark, sf_dir))
    _in_batches(rows, F.pmod(F.xxhash64("seq"), F.lit(3)), 3, f"{folder}/scores", lambda: jobs.start_alerts(
        spark.readStream.schema(rows.schema).parquet(f"{folder}/scores"), f"{folder}/alerts", f"{folder}/c", source.DRAIN,
        delay="60 days", **GATES,
    ))
    return _result(spark, folder, jobs.corrected_alerts(spark, f"{folder}/alerts"))


@query("alert_deliveries", WINDOWS + """,
d AS (SELECT *, user_id % 2 AS since FROM a)
SELECT hostname, user_id, ts_us, "trigger", since AS "round",
       CAST(CASE (user_id + since) % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS offers FROM d
""")
def alert_deliveries(spark, sf_dir):
    """Alerts in two batches, offered until acknowledged: some acknowledgements get lost, others come twice, rounds are repeated."""
    folder = _folder(spark, "outbox")
    alerts = materialize(al.alerts(scored_users(spark, sf_dir), **GATES))
    table = BatchTable(spark, f"{folder}/alerts", jobs.ALERT_TABLE)
    box = Outbox(spark, f"{folder}/alerts", f"{folder}/outbox")
    for r in range(5):
        if r < 2:
            table.publish(alerts.where(F.col("user_id") % 2 == r), r)
        offered = box.offer(r)
        heard = offered.where((F.col("user_id") + r) % 4 >= 2).select("alert_id", F.lit(r).alias("round"))
        box.acknowledge(heard.unionAll(heard.where(F.hash("alert_id") % 2 == 0)), r)
        if box.offer(r).exceptAll(offered).count():
            raise RuntimeError(f"round {r} changed when it was repeated")
    if not box.offer(5).isEmpty():
        raise RuntimeError("alerts are left that were acknowledged")
    out = consumed(box.deliveries.of_batches(box.deliveries.batches()))
    return _result(spark, folder, out.select("hostname", "user_id", "ts_us", "trigger", "round", "offers"))
