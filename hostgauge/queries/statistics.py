"""Frequencies, samples, percentiles, thresholds, severities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hostgauge.fixed_values import CAP_TO_ONE, CAP_TO_ZERO
from hostgauge.functions.event_features import entity_key
from hostgauge.functions.severity import apply_cap, capped_at, is_anomaly, malicious_pred, severity
from hostgauge.operators import model_stats as ms
from hostgauge.operators.filters import benign
from hostgauge.operators.isolation_forest import contamination_offset
from hostgauge.queries.registry import S, T, graded_sql, query, rounded
from hostgauge.session import materialize
from hostgauge.sources.tables import table, telemetry, with_surrogate_score


def scored_events(spark, sf_dir, mode: str = "host_user") -> DataFrame:
    return with_surrogate_score(telemetry(spark, sf_dir)).withColumn("entity", entity_key(mode))


def graded_events(spark, sf_dir, low: float, high: float, mode: str = "host_user") -> DataFrame:
    """Events with thresholds learnt from themselves, and severity."""
    s = scored_events(spark, sf_dir, mode)
    per_entity = materialize(ms.entity_thresholds(s, low, high))
    # every entity is known here, so the global row is never used
    return ms.with_severity(ms.with_thresholds(s, per_entity, {"low": 0.0, "high": 0.0}))


@query("frequency_tables", f"""
WITH {T}, b AS (SELECT * FROM t WHERE sus = 0 AND evil = 0)
SELECT 'eventId' AS table_name, CAST(eventId AS VARCHAR) AS key, round(ln(1 + count(*)), 6) AS log_count FROM b GROUP BY 2
UNION ALL SELECT 'mountNamespace', CAST(mountNamespace AS VARCHAR), round(ln(1 + count(*)), 6) FROM b WHERE seq % 3 <> 0 GROUP BY 2
UNION ALL SELECT 'processName', CASE WHEN seq % 4 = 0 THEN '' ELSE lower(processName) END, round(ln(1 + count(*)), 6) FROM b GROUP BY 2
""")
def frequency_tables(spark, sf_dir):
    e = telemetry(spark, sf_dir).withColumns({
        "mountNamespace": F.when(F.col("seq") % 3 != 0, F.col("mountNamespace")),
        "processName": F.when(F.col("seq") % 4 != 0, F.upper("processName")),
    })
    return rounded(ms.frequency_tables(benign(e)), 6, "log_count")


_TH = "SELECT {k} AS entity, round(quantile_cont({v}, 0.02), 9) AS low, round(quantile_cont({v}, 0.002), 9) AS high, count(*) AS n_scores FROM {t} GROUP BY 1"


@query("entity_thresholds", f"WITH {S} " + _TH.format(k="entity", v="score", t="s"))
def entity_thresholds(spark, sf_dir):
    return rounded(ms.entity_thresholds(scored_events(spark, sf_dir)), 9, "low", "high")


@query("host_thresholds", f"WITH {S} " + _TH.format(k="hostName", v="score", t="s"))
def host_thresholds(spark, sf_dir):
    return rounded(ms.entity_thresholds(scored_events(spark, sf_dir, "host")), 9, "low", "high")


@query("supplier_price_thresholds", _TH.format(k="CAST(l_suppkey AS VARCHAR)", v="CAST(l_extendedprice AS DOUBLE)", t="lineitem").replace(", 9)", ", 4)"))
def supplier_price_thresholds(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("entity"), F.col("l_extendedprice").cast("double").alias("normality_score")
    )
    return rounded(ms.entity_thresholds(lines), 4, "low", "high")


@query("global_thresholds", f"WITH {S} SELECT round(quantile_cont(score, 0.02), 9) AS low, round(quantile_cont(score, 0.002), 9) AS high, count(*) AS n_scores FROM s")
def global_thresholds(spark, sf_dir):
    return rounded(ms.global_thresholds(scored_events(spark, sf_dir)), 9, "low", "high")


@query("global_price_thresholds", "SELECT round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.02), 4) AS low, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.002), 4) AS high, count(*) AS n_scores FROM lineitem")
def global_price_thresholds(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").cast("double").alias("normality_score"))
    return rounded(ms.global_thresholds(lines), 4, "low", "high")


@query("contamination_offset", f"WITH {S} SELECT round(quantile_cont(score, 0.03), 9) AS score_offset, round(min(score) - quantile_cont(score, 0.03), 9) AS lowest FROM s WHERE sus = 0 AND evil = 0")
def contamination_offset_(spark, sf_dir):
    s = benign(scored_events(spark, sf_dir))
    offset = contamination_offset(s, 0.03, "normality_score")
    out = s.agg(F.lit(offset).alias("score_offset"), (F.min("normality_score") - offset).alias("lowest"))
    return rounded(out, 9, "score_offset", "lowest")


@query("uniform_sample")
def uniform_sample(spark, sf_dir):
    """A thousand benign events, each equally likely."""
    return ms.uniform_sample(benign(telemetry(spark, sf_dir)), ["hostName", "seq"], 1000).select("hostName", "seq")


@query("capped_scores", f"""
WITH {S} SELECT entity, least(count(*), 40) AS n FROM s GROUP BY 1
""")
def capped_scores(spark, sf_dir):
    sample = ms.capped_per_entity(scored_events(spark, sf_dir), ["seq"], 40)
    return sample.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


@query("capped_score_thresholds", f"WITH {S} " + _TH.format(k="entity", v="score", t="s"))
def capped_score_thresholds(spark, sf_dir):
    """A cap that no entity reaches changes nothing."""
    sample = ms.capped_per_entity(scored_events(spark, sf_dir), ["seq"], 500_000)
    return rounded(ms.entity_thresholds(sample), 9, "low", "high")


@query("severity_by_entity", f"""
WITH {graded_sql(20, 10)}
SELECT seq, entity, round(low, 9) AS low_threshold, round(high, 9) AS high_threshold, severity,
       CASE WHEN severity >= 1 THEN 1 ELSE 0 END AS malicious_pred, severity > 0 AS is_anomaly
FROM g
""")
def severity_by_entity(spark, sf_dir):
    g = graded_events(spark, sf_dir, 20, 10)
    out = g.select(
        "seq", "entity", "low_threshold", "high_threshold", "severity",
        malicious_pred(F.col("severity")).alias("malicious_pred"), is_anomaly(F.col("severity")).alias("is_anomaly"),
    )
    return rounded(out, 9, "low_threshold", "high_threshold")


@query("threshold_fallback", f"""
WITH {S},
th AS (SELECT entity, quantile_cont(score, 0.2) AS low, quantile_cont(score, 0.1) AS high FROM s WHERE userId % 3 = 0 GROUP BY 1),
j AS (SELECT s.seq, s.score, s.userId % 9 = 0 AS broken, coalesce(th.low, 0.0) AS low, coalesce(th.high, -0.15) AS high
      FROM s LEFT JOIN th USING (entity))
SELECT seq, round(low, 9) AS low_threshold,
       CASE WHEN broken THEN 0 WHEN score < high THEN 2 WHEN score < low THEN 1 ELSE 0 END AS severity
FROM j
""")
def threshold_fallback(spark, sf_dir):
    """Unknown entities get the operator's global values; NaN thresholds give 0."""
    s = scored_events(spark, sf_dir)
    known = materialize(ms.entity_thresholds(s.where(F.col("userId") % 3 == 0), 20, 10))
    overall = ms.override_global({"low": 0.0}, None, -0.15)
    j = ms.with_thresholds(s, known, overall)
    high = F.when(F.col("userId") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("high_threshold"))
    graded = j.withColumn("severity", severity(F.col("normality_score"), F.col("low_threshold"), high))
    return rounded(graded.select("seq", "low_threshold", "severity"), 9, "low_threshold")


def _quoted(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


@query("capped_severity", f"""
WITH {graded_sql(20, 10)},
c AS (SELECT *, CASE WHEN lower(processName) IN {_quoted(CAP_TO_ZERO)} THEN 0
                     WHEN lower(processName) IN {_quoted(CAP_TO_ONE)} AND severity > 1 THEN 1 END AS cap FROM g)
SELECT seq, processName, cap AS severity_capped_at, coalesce(cap, severity) AS severity FROM c
""")
def capped_severity(spark, sf_dir):
    g = graded_events(spark, sf_dir, 20, 10).withColumn("cap", capped_at(F.col("severity")))
    return g.select(
        "seq", "processName", F.col("cap").alias("severity_capped_at"), apply_cap(F.col("severity"), F.col("cap")).alias("severity")
    )
