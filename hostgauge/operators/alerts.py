"""Alerts from the severity window of each user, and the state behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hostgauge.fixed_values import ALERT_COUNT, ALERT_MIN_RATE, ALERT_MIN_SEVERITY, ALERT_WINDOW_S
from hostgauge.functions.text import count_gauge, gauge_class, rate_gauge, trigger_text
from hostgauge.operators.filters import tracked_users
from hostgauge.operators.rolling import with_trailing_counts
from hostgauge.schemas import USER_KEY


def severity_windows(
    scored: DataFrame,
    window_s: float = ALERT_WINDOW_S,
    min_severity: int = ALERT_MIN_SEVERITY,
    time_col: str = "ts_us",
    untracked: list[int] | None = None,
) -> DataFrame:
    """Per event of a tracked user: events and severe events in the trailing window.

    ``scored`` has hostname, user_id, severity, seq and the time column. Users
    that are never tracked go first, as they are often the busiest.
    """
    rows = tracked_users(scored, "user_id", untracked).select(
        *USER_KEY, F.col(time_col).alias("ts_us"), "seq", "severity"
    )
    return with_trailing_counts(rows, USER_KEY, F.col("severity") >= min_severity, window_s)


def _crossed(count: int, min_rate: float) -> Column:
    high, total = F.col("match_count"), F.col("total_count")
    return (high >= count) & (high / total >= min_rate)


def user_windows(windows: DataFrame, count: int = ALERT_COUNT, min_rate: float = ALERT_MIN_RATE) -> DataFrame:
    """Per user the window at the first crossing of both gates, and the last window.

    Earlier windows do not depend on the latch, so the first crossing is the
    alert. Both are map-side combined aggregates.
    """
    at = F.struct("ts_us", "seq")
    here = F.struct("ts_us", "seq", "match_count", "total_count")
    crossed = _crossed(count, min_rate)
    return windows.groupBy(*USER_KEY).agg(
        F.min(F.when(crossed, here)).alias("first"),
        F.max_by(here, at).alias("last"),
    )


def alerts(
    scored: DataFrame,
    window_s: float = ALERT_WINDOW_S,
    count: int = ALERT_COUNT,
    min_rate: float = ALERT_MIN_RATE,
    min_severity: int = ALERT_MIN_SEVERITY,
    time_col: str = "ts_us",
    untracked: list[int] | None = None,
) -> DataFrame:
    """One row per user whose window first passed both gates."""
    users = user_windows(severity_windows(scored, window_s, min_severity, time_col, untracked), count, min_rate)
    return users.where("first is not null").select(
        *USER_KEY,
        F.col("first.ts_us").alias("ts_us"),
        F.col("first.seq").alias("seq"),
        F.col("first.match_count").alias("severity2_count"),
        F.col("first.total_count").alias("total_count"),
        trigger_text(F.col("first.match_count"), F.col("first.total_count")).alias("trigger"),
    )


def count_only_alerts(
    scored: DataFrame,
    window_s: float = ALERT_WINDOW_S,
    count: int = ALERT_COUNT,
    min_severity: int = ALERT_MIN_SEVERITY,
    untracked: list[int] | None = None,
) -> DataFrame:
    """The older rule: severe events only, no rate gate."""
    severe = scored.where(F.col("severity") >= min_severity)
    found = alerts(severe, window_s, count, 0.0, min_severity, untracked=untracked)
    return found.drop("total_count", "trigger")


def user_states(
    scored: DataFrame,
    window_s: float = ALERT_WINDOW_S,
    count: int = ALERT_COUNT,
    min_rate: float = ALERT_MIN_RATE,
    min_severity: int = ALERT_MIN_SEVERITY,
    untracked: list[int] | None = None,
) -> DataFrame:
    """Per tracked user the window as last seen; an alerted user's window stays as it was."""
    users = user_windows(severity_windows(scored, window_s, min_severity, untracked=untracked), count, min_rate)
    seen = F.coalesce("first", "last")
    return users.select(
        *USER_KEY,
        F.col("first").isNotNull().alias("alerted"),
        seen.getField("match_count").alias("severity2_count"),
        seen.getField("total_count").alias("total_count"),
        (seen.getField("match_count") / seen.getField("total_count")).alias("severity2_rate"),
        F.lit(count).alias("severity2_threshold"),
        F.lit(min_rate).alias("min_severity2_rate"),
    )


def with_gauges(states: DataFrame) -> DataFrame:
    count_pct = count_gauge(F.col("severity2_count"), F.col("severity2_threshold"))
    rate_pct = rate_gauge(F.col("severity2_rate"), F.col("min_severity2_rate"))
    return states.withColumns({
        "count_pct": count_pct,
        "count_class": gauge_class(count_pct),
        "rate_pct": rate_pct,
        "rate_class": gauge_class(rate_pct),
        "armed": (F.col("severity2_count") >= F.col("severity2_threshold"))
        & (F.col("severity2_rate") >= F.col("min_severity2_rate")),
    })


def tracker_statistics(
    states: DataFrame, window_s: float = ALERT_WINDOW_S, count: int = ALERT_COUNT,
    min_rate: float = ALERT_MIN_RATE, published: DataFrame | None = None,
) -> DataFrame:
    """One row: users tracked, alerted, alerts not yet published, parameters."""
    marked = states.withColumn("_sent", F.lit(False))
    if published is not None:
        sent = published.select(*USER_KEY).distinct().withColumn("_sent", F.lit(True))
        marked = states.join(sent, USER_KEY, "left").fillna(False, ["_sent"])
    return marked.agg(
        F.count(F.lit(1)).alias("tracked_entities"),
        F.count_if("alerted").alias("alerted"),
        F.count_if(F.col("alerted") & ~F.col("_sent")).alias("pending_alerts"),
    ).withColumns({
        "alert_threshold": F.lit(count), "window_seconds": F.lit(window_s), "min_severity2_rate": F.lit(min_rate),
    })


def alert_history(automatic: DataFrame, manual: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """Automatic and manual alerts; the latter carry the trigger "manual", set no
    latch, and are refused for unknown hosts."""
    if hosts is not None:
        manual = manual.join(hosts, "hostname", "left_semi")
    cols = ["ts_us", *USER_KEY, "trigger"]
    return automatic.select(*cols).unionByName(manual.withColumn("trigger", F.lit("manual")).select(*cols))


def newest_first(history: DataFrame) -> DataFrame:
    return history.orderBy(F.desc("ts_us"), *USER_KEY)
