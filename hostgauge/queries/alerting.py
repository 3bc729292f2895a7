"""Alerts and the user states behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hostgauge.functions.text import ntz_to_micros
from hostgauge.operators import alerts as al
from hostgauge.operators.monitor import with_username
from hostgauge.queries.registry import WEEK_S, WEEK_US, graded_sql, query, rounded
from hostgauge.queries.statistics import graded_events
from hostgauge.sources.tables import table

# Gates that fit events hours apart; the window stands for the 60 seconds.
GATES = {"window_s": WEEK_S, "count": 2, "min_rate": 0.15}


def scored_users(spark, sf_dir) -> DataFrame:
    """(hostname, user_id, ts_us, seq, severity) with the infrastructure caps left out."""
    g = graded_events(spark, sf_dir, 20, 10)
    return g.select(F.col("hostName").alias("hostname"), F.col("userId").alias("user_id"), "ts_us", "seq", "severity")


_TRACKED = """NOT (userId = 0 OR userId BETWEEN 1 AND 32 OR userId = 65 OR userId BETWEEN 100 AND 125 OR userId BETWEEN 993 AND 998)"""

WINDOWS = f"""
WITH {graded_sql(20, 10)},
u AS (SELECT hostName AS hostname, userId AS user_id, ts_us, seq, severity FROM g WHERE {_TRACKED}),
w AS (
  SELECT x.hostname, x.user_id, x.ts_us, x.seq, count(*) AS total_count,
         CAST(sum(CASE WHEN y.severity >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS severity2_count
  FROM u x JOIN u y ON x.hostname = y.hostname AND x.user_id = y.user_id AND y.ts_us >= x.ts_us - {WEEK_US}
   AND (y.ts_us < x.ts_us OR (y.ts_us = x.ts_us AND y.seq <= x.seq))
  GROUP BY 1, 2, 3, 4
),
n AS (SELECT *, row_number() OVER (PARTITION BY hostname, user_id ORDER BY ts_us, seq) AS rn FROM w
      WHERE severity2_count >= 2 AND severity2_count / total_count >= 0.15),
a AS (
  SELECT hostname, user_id, ts_us, seq, severity2_count, total_count,
         'rate+threshold (sev2=' || severity2_count || '/' || total_count || '=' ||
         CAST(round_even(severity2_count / total_count * 100, 0) AS BIGINT) || '%)' AS "trigger"
  FROM n WHERE rn = 1
),
l AS (SELECT *, row_number() OVER (PARTITION BY hostname, user_id ORDER BY ts_us DESC, seq DESC) AS rn FROM w),
st AS (
  SELECT l.hostname, l.user_id, a.seq IS NOT NULL AS alerted,
         coalesce(a.severity2_count, l.severity2_count) AS severity2_count, coalesce(a.total_count, l.total_count) AS total_count,
         2 AS severity2_threshold, 0.15::DOUBLE AS min_severity2_rate
  FROM l LEFT JOIN a ON a.hostname = l.hostname AND a.user_id = l.user_id WHERE l.rn = 1
),
states AS (SELECT *, severity2_count / total_count AS severity2_rate FROM st)"""


@query("alerts", WINDOWS + " SELECT * FROM a")
def alerts(spark, sf_dir):
    """Which users on which hosts first crossed both gates, when and how."""
    return al.alerts(scored_users(spark, sf_dir), **GATES)


@query("count_only_alerts", f"""
WITH {graded_sql(20, 10)},
u AS (SELECT hostName AS hostname, userId AS user_id, ts_us, seq FROM g WHERE severity >= 2 AND {_TRACKED}),
w AS (
  SELECT x.hostname, x.user_id, x.ts_us, x.seq, count(*) AS severity2_count
  FROM u x JOIN u y ON x.hostname = y.hostname AND x.user_id = y.user_id AND y.ts_us >= x.ts_us - {WEEK_US}
   AND (y.ts_us < x.ts_us OR (y.ts_us = x.ts_us AND y.seq <= x.seq))
  GROUP BY 1, 2, 3, 4
),
n AS (SELECT *, row_number() OVER (PARTITION BY hostname, user_id ORDER BY ts_us, seq) AS rn FROM w WHERE severity2_count >= 3)
SELECT hostname, user_id, ts_us, seq, severity2_count FROM n WHERE rn = 1
""")
def count_only_alerts(spark, sf_dir):
    return al.count_only_alerts(scored_users(spark, sf_dir), WEEK_S, 3)


@query("user_states", WINDOWS + """
SELECT hostname, user_id, alerted, severity2_count, total_count, round(severity2_rate, 9) AS severity2_rate,
       severity2_threshold, min_severity2_rate FROM states
""")
def user_states(spark, sf_dir):
    return rounded(al.user_states(scored_users(spark, sf_dir), **GATES), 9, "severity2_rate")


def _class_sql(pct: str) -> str:
    return f"CASE WHEN {pct} >= 100 THEN 'full' WHEN {pct} >= 70 THEN 'warn' ELSE 'ok' END"


@query("user_gauges", WINDOWS + f""",
p AS (SELECT *, least(severity2_count / severity2_threshold * 100, 100) AS c,
             least(severity2_rate * 100 / greatest(min_severity2_rate * 100, 0.01) * 100, 100) AS r FROM states)
SELECT hostname, user_id, round(c, 6) AS count_pct, {_class_sql('c')} AS count_class, round(r, 6) AS rate_pct,
       {_class_sql('r')} AS rate_class, severity2_count >= 2 AND severity2_rate >= 0.15 AS armed
FROM p
""")
def user_gauges(spark, sf_dir):
    g = al.with_gauges(al.user_states(scored_users(spark, sf_dir), **GATES))
    out = g.select("hostname", "user_id", "count_pct", "count_class", "rate_pct", "rate_class", "armed")
    return rounded(out, 6, "count_pct", "rate_pct")


@query("tracker_statistics", WINDOWS + f"""
SELECT count(*) AS tracked_entities, count(*) FILTER (WHERE alerted) AS alerted,
       count(*) FILTER (WHERE alerted AND hostname <> 'host-1') AS pending_alerts,
       2 AS alert_threshold, {WEEK_S} AS window_seconds, 0.15::DOUBLE AS min_severity2_rate
FROM states
""")
def tracker_statistics(spark, sf_dir):
    states = al.user_states(scored_users(spark, sf_dir), **GATES)
    published = states.where("alerted and hostname = 'host-1'")
    return al.tracker_statistics(states, published=published, **GATES)


_MANUAL = """
m AS (SELECT epoch_us(ts) AS ts_us, 'host-' || (user_id % 9) AS hostname, user_id, 'manual' AS "trigger"
      FROM events WHERE event_type = 'signup')"""


@query("alert_history", WINDOWS + f""", {_MANUAL}
SELECT ts_us, hostname, user_id, "trigger" FROM a
UNION ALL SELECT m.* FROM m WHERE hostname IN (SELECT hostName FROM g)
""")
def alert_history(spark, sf_dir):
    """Automatic and manual alerts, newest first; requests for unknown hosts are refused."""
    scored = scored_users(spark, sf_dir)
    manual = table(spark, sf_dir, "events").where("event_type = 'signup'")
    manual = manual.select(
        ntz_to_micros("ts").alias("ts_us"), F.concat(F.lit("host-"), (F.col("user_id") % 9).cast("string")).alias("hostname"), "user_id"
    )
    hosts = scored.select("hostname").distinct()
    return al.newest_first(al.alert_history(al.alerts(scored, **GATES), manual, hosts))


@query("alert_usernames", WINDOWS + """
SELECT a.hostname, a.user_id, coalesce(c.c_name, s.s_name) AS username, "trigger"
FROM a LEFT JOIN customer c ON c.c_custkey = a.user_id AND c.c_custkey % 2 = 0 AND 'host-' || (c.c_custkey % 7) = a.hostname
       LEFT JOIN supplier s ON s.s_suppkey = a.user_id
""")
def alert_usernames(spark, sf_dir):
    """Account names from the host's own table, else from the central one."""
    own = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(
        F.concat(F.lit("host-"), (F.col("c_custkey") % 7).cast("string")).alias("hostname"),
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"),
    )
    hints = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("username"))
    found = with_username(al.alerts(scored_users(spark, sf_dir), **GATES), own, hints)
    return found.select("hostname", "user_id", "username", "trigger")
