"""Read queries over scores, events and hosts."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostgauge.fixed_values import FEATURES
from hostgauge.functions.text import time_since
from hostgauge.operators import monitor
from hostgauge.operators.filters import tracked_users
from hostgauge.operators.ordered import exact_quantiles
from hostgauge.queries.registry import DAY_US, S, T, query, rounded
from hostgauge.queries.statistics import scored_events
from hostgauge.session import materialize
from hostgauge.sources.tables import table, telemetry


def _scores(spark, sf_dir):
    s = scored_events(spark, sf_dir)
    return s.withColumnsRenamed({"hostName": "hostname", "normality_score": "raw_score"})


@query("retained_scores", f"""
WITH {S}, n AS (SELECT *, row_number() OVER (PARTITION BY hostName ORDER BY ts_us DESC, seq DESC) AS rn FROM s)
SELECT hostName AS hostname, seq, round(score, 9) AS raw_score FROM n WHERE rn <= 200
""")
def retained_scores(spark, sf_dir):
    kept = monitor.retain_last(_scores(spark, sf_dir), 200)
    return rounded(kept.select("hostname", "seq", "raw_score"), 9, "raw_score")


@query("recent_scores", f"""
WITH {S} SELECT seq, processName, round(score, 9) AS raw_score FROM s WHERE hostName = 'host-2' ORDER BY ts_us DESC, seq DESC LIMIT 50
""")
def recent_scores(spark, sf_dir):
    return rounded(monitor.recent_scores(_scores(spark, sf_dir), "host-2").select("seq", "processName", "raw_score"), 9, "raw_score")


@query("live_tail", f"WITH {T} SELECT seq, hostName, eventName FROM t ORDER BY ts_us DESC, seq DESC LIMIT 500")
def live_tail(spark, sf_dir):
    return monitor.live_tail(telemetry(spark, sf_dir)).select("seq", "hostName", "eventName")


def _drift_sql(sample: int) -> str:
    return f"""
WITH {S}, th AS (SELECT quantile_cont(score, 0.02) AS low, quantile_cont(score, 0.002) AS high FROM s WHERE sus = 0),
x AS (SELECT s.*, th.low, th.high FROM s, th ORDER BY ts_us DESC, seq DESC LIMIT {sample}),
d AS (SELECT count(*) AS samples, round(avg(CASE WHEN score < low THEN 100.0 ELSE 0 END), 6) AS observed_low_pct,
             round(avg(CASE WHEN score < high THEN 100.0 ELSE 0 END), 6) AS observed_high_pct, round(avg(score), 6) AS score_mean,
             round(stddev_pop(score), 6) AS score_std, round(min(score), 6) AS score_min, round(max(score), 6) AS score_max,
             round(max(low), 6) AS global_low_threshold, round(max(high), 6) AS global_high_threshold,
             2.0::DOUBLE AS expected_low_pct, 0.2::DOUBLE AS expected_high_pct, {len(FEATURES)} AS n_features FROM x)
SELECT *, CASE WHEN samples < 100 THEN 'warming-up' WHEN observed_low_pct > 6 THEN 'drift-suspected' ELSE 'ok' END AS status FROM d"""


def _drift(spark, sf_dir, sample: int):
    s = _scores(spark, sf_dir)
    benign = materialize(s.where("sus = 0").select("raw_score"))
    th = exact_quantiles(benign, "raw_score", {"low": 0.02, "high": 0.002}).first()
    found = monitor.drift(s, th["low"], th["high"], 2.0, sample)
    return rounded(found, 6, *[c for c in found.columns if c not in ("samples", "status", "n_features")])


@query("score_drift", _drift_sql(100_000))
def score_drift(spark, sf_dir):
    """The newest 100 000 scores against thresholds learnt from unsuspicious rows."""
    return _drift(spark, sf_dir, 100_000)


@query("score_drift_recent", _drift_sql(500))
def score_drift_recent(spark, sf_dir):
    return _drift(spark, sf_dir, 500)


_ACTIVITY = f"""
WITH {T}, b AS (SELECT hostName AS hostname, seq // 100 AS msg, max(ts_us) AS ts_us, count(*) AS n FROM t WHERE hostName <> 'host-6' GROUP BY 1, 2),
z AS (SELECT max(ts_us) AS as_of FROM t),
a AS (SELECT hostname, count(*) FILTER (WHERE ts_us >= as_of - {DAY_US}) AS batches_per_min,
             CAST(coalesce(sum(n) FILTER (WHERE ts_us >= as_of - {DAY_US}), 0) AS BIGINT) AS events_per_min, max(ts_us) AS last_seen_us
      FROM b, z GROUP BY 1),
h AS (SELECT DISTINCT hostName AS hostname FROM t)"""


def _activity(spark, sf_dir):
    """A message is what a host sent of a hundred events; one host stays silent."""
    e = telemetry(spark, sf_dir).withColumnRenamed("hostName", "hostname")
    batches = (
        e.where("hostname <> 'host-6'").groupBy("hostname", F.floor(F.col("seq") / 100).alias("msg"))
        .agg(F.max("ts_us").alias("ts_us"), F.count(F.lit(1)).alias("n_events"))
    )
    as_of = e.agg(F.max("ts_us")).first()[0]
    return monitor.host_activity(batches, e.select("hostname").distinct(), F.lit(as_of), DAY_US), as_of


@query("host_activity", _ACTIVITY + """
SELECT h.hostname, coalesce(batches_per_min, 0) AS batches_per_min, coalesce(events_per_min, 0) AS events_per_min, last_seen_us
FROM h LEFT JOIN a USING (hostname)
""")
def host_activity(spark, sf_dir):
    return _activity(spark, sf_dir)[0]


@query("host_last_seen", _ACTIVITY + """, s AS (SELECT h.hostname, floor((as_of - last_seen_us) / 1000000) AS sec FROM h LEFT JOIN a USING (hostname), z)
SELECT hostname, CASE WHEN sec IS NULL THEN 'never' WHEN sec < 60 THEN CAST(sec AS BIGINT) || 's ago'
                      ELSE CAST(floor(sec / 60) AS BIGINT) || 'm ago' END AS seen FROM s
""")
def host_last_seen(spark, sf_dir):
    hosts, as_of = _activity(spark, sf_dir)
    # whole microseconds, so that the seconds are not blurred by rounding
    seen = time_since(F.lit(1.0), 1.0 + (F.lit(as_of) - F.col("last_seen_us")) / 1_000_000)
    return hosts.select("hostname", F.when(F.col("last_seen_us").isNull(), "never").otherwise(seen).alias("seen"))


@query("known_hosts", f"""
WITH {T} SELECT DISTINCT hostname FROM (
  SELECT 'host-' || (c_custkey % 12) AS hostname FROM customer UNION ALL SELECT hostName FROM t)
""")
def known_hosts(spark, sf_dir):
    name = F.concat(F.lit("host-"), (F.col("c_custkey") % 12).cast("string"))
    registered = table(spark, sf_dir, "customer").select(name.alias("hostname"))
    return monitor.known_hosts(registered, telemetry(spark, sf_dir).withColumnRenamed("hostName", "hostname"))


@query("run_counters", f"""
WITH {T}, f AS (SELECT count(*) AS events_forwarded FROM t
  WHERE NOT (userId BETWEEN 0 AND 32 OR userId = 65 OR userId BETWEEN 100 AND 125 OR userId BETWEEN 993 AND 998))
SELECT count(*) AS events_processed, count(DISTINCT hostName) AS hosts, max(events_forwarded) AS events_forwarded FROM t, f
""")
def run_counters(spark, sf_dir):
    e = telemetry(spark, sf_dir)
    return monitor.run_counters(e.withColumnRenamed("hostName", "hostname"), tracked_users(e))
