"""Evaluation against labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostgauge.fixed_values import SWEEP_FROM, SWEEP_STEPS, SWEEP_TO
from hostgauge.operators import evaluate
from hostgauge.queries.registry import S, graded_sql, query, rounded
from hostgauge.queries.statistics import graded_events, scored_events
from hostgauge.session import materialize
from hostgauge.sources.tables import table


def metrics_sql(prefix: str = "") -> str:
    tp, fp, fn = f"{prefix}tp", f"{prefix}fp", f"{prefix}fn"
    return f"""round(CASE WHEN {tp} + {fp} > 0 THEN {tp} / ({tp} + {fp}) ELSE 0 END, 9) AS {prefix}precision,
       round(CASE WHEN {tp} + {fn} > 0 THEN {tp} / ({tp} + {fn}) ELSE 0 END, 9) AS {prefix}recall,
       round(CASE WHEN {tp} > 0 THEN 2 * {tp} / (2 * {tp} + {fp} + {fn}) ELSE 0 END, 9) AS {prefix}f1"""


def cells_sql(pred: str, prefix: str = "") -> str:
    return ", ".join(
        f"count(*) FILTER (WHERE evil = {y} AND {'' if p else 'NOT '}({pred})) AS {prefix}{n}"
        for n, y, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
    )


def ranking_sql(rows: str, score: str = "score", label: str = "evil") -> str:
    """``r``: one row (roc_auc, avg_precision)."""
    return f"""
d AS (SELECT {score} AS v, sum({label}) AS p, count(*) - sum({label}) AS n FROM {rows} GROUP BY 1),
q AS (SELECT *, sum(p) OVER (ORDER BY v) AS cp, sum(n) OVER (ORDER BY v) AS cn, sum(p) OVER () AS pp, sum(n) OVER () AS nn FROM d),
r AS (SELECT round(sum(p * (nn - cn + n / 2)) / (max(pp) * max(nn)), 9) AS roc_auc,
             round(sum(p / pp * (cp / (cp + cn))), 9) AS avg_precision FROM q)"""


@query("confusion", f"""
WITH {graded_sql(20, 10)},
c AS (SELECT 'low_or_high' AS policy, {cells_sql('severity >= 1')} FROM g
      UNION ALL SELECT 'high_only', {cells_sql('severity >= 2')} FROM g)
SELECT *, {metrics_sql()} FROM c
""")
def confusion(spark, sf_dir):
    return rounded(evaluate.confusion(graded_events(spark, sf_dir, 20, 10)), 9, "precision", "recall", "f1")


@query("ranking", f"WITH {S}, {ranking_sql('s')} SELECT * FROM r")
def ranking(spark, sf_dir):
    return rounded(evaluate.ranking(scored_events(spark, sf_dir)), 9, "roc_auc", "avg_precision")


@query("toxic_text_ranking", f"WITH j AS (SELECT toxic, n_chars FROM labels JOIN documents USING (doc_id)), {ranking_sql('j', 'n_chars', 'toxic')} SELECT * FROM r")
def toxic_text_ranking(spark, sf_dir):
    """Does a short text tend to be toxic? A label and score with many ties."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    rows = j.select(F.col("toxic").cast("int").alias("evil"), F.col("n_chars").cast("double").alias("normality_score"))
    return rounded(evaluate.ranking(rows), 9, "roc_auc", "avg_precision")


_WIDTH = (SWEEP_TO - SWEEP_FROM) / (SWEEP_STEPS - 1)
_CANDIDATES = ", ".join(f"({i}, {SWEEP_FROM + i * _WIDTH!r}::DOUBLE)" for i in range(SWEEP_STEPS))
_QUANTILES = ", ".join(f"{(SWEEP_FROM + i * _WIDTH) / 100!r}" for i in range(SWEEP_STEPS))
_SWEEP = f"""
WITH {S}, p(step, percentile) AS (VALUES {_CANDIDATES}),
qs AS (SELECT quantile_cont(score, [{_QUANTILES}]) AS l FROM s),
c AS (SELECT p.step, p.percentile, qs.l[p.step + 1] AS threshold FROM p, qs),
x AS (SELECT c.step, c.percentile, c.threshold,
             count(*) FILTER (WHERE evil = 1 AND score < threshold) AS tp,
             count(*) FILTER (WHERE evil = 0 AND score < threshold) AS fp,
             count(*) FILTER (WHERE evil = 1 AND NOT score < threshold) AS fn
      FROM c, s GROUP BY 1, 2, 3),
m AS (SELECT step, round(percentile, 9) AS percentile, round(threshold, 9) AS threshold, tp, fp, fn, {metrics_sql()} FROM x)"""


def _swept(spark, sf_dir):
    swept = evaluate.sweep(scored_events(spark, sf_dir))
    return rounded(swept, 9, "percentile", "threshold", "precision", "recall", "f1")


@query("threshold_sweep", _SWEEP + " SELECT * FROM m")
def threshold_sweep(spark, sf_dir):
    return _swept(spark, sf_dir)


@query("picked_threshold", _SWEEP + """
SELECT * FROM (SELECT 'f1' AS metric, * FROM m ORDER BY f1 DESC, step LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'precision' AS metric, * FROM m ORDER BY precision DESC, step LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'recall' AS metric, * FROM m ORDER BY recall DESC, step LIMIT 1)
""")
def picked_threshold(spark, sf_dir):
    swept = materialize(_swept(spark, sf_dir))
    picks = [evaluate.pick_threshold(swept, m).withColumn("metric", F.lit(m)) for m in ("f1", "precision", "recall")]
    return picks[0].unionByName(picks[1]).unionByName(picks[2])


@query("single_threshold_report", f"""
WITH {S}, {ranking_sql('s')}, c AS (SELECT count(*) AS n, {cells_sql('score < 0.05')} FROM s)
SELECT c.*, {metrics_sql()}, 0.05::DOUBLE AS threshold, 'test' AS name, r.* FROM c, r
""")
def single_threshold_report(spark, sf_dir):
    out = evaluate.single_threshold_report(scored_events(spark, sf_dir), 0.05)
    return rounded(out, 9, "precision", "recall", "f1", "roc_auc", "avg_precision")


@query("validation_report", f"""
WITH {S}, {ranking_sql('s')},
c AS (SELECT count(DISTINCT entity) AS entities, CAST(sum(evil) AS BIGINT) AS evil_count, count(*) AS "rows" FROM s)
SELECT c.*, r.* FROM c, r
""")
def validation_report(spark, sf_dir):
    return rounded(evaluate.validation_report(scored_events(spark, sf_dir)), 9, "roc_auc", "avg_precision")


@query("test_report", f"""
WITH {graded_sql(20, 10)}, {ranking_sql('g')},
c AS (SELECT count(*) AS "rows", CAST(sum(evil) AS BIGINT) AS evil_count, {cells_sql('severity >= 1', 'any_')}, {cells_sql('severity >= 2', 'high_')} FROM g)
SELECT c.*, {metrics_sql('any_')}, {metrics_sql('high_')}, r.* FROM c, r
""")
def test_report(spark, sf_dir):
    out = evaluate.test_report(graded_events(spark, sf_dir, 20, 10))
    shares = [f"{p}_{m}" for p in ("any", "high") for m in ("precision", "recall", "f1")]
    return rounded(out, 9, *shares, "roc_auc", "avg_precision")
