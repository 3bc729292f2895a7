"""Trailing time windows that stay exact when one key holds most of the rows.

A window function sorts each of its partitions in one task. Partitioning by the
key alone would therefore put a busy process or user into a single task, so all
windows here run per (key, time bucket). Each bucket also receives copies of the
rows that its trailing frames reach back to ("halo" rows); these take part in
the frames and are dropped afterwards.

Counts over the frame [t - w, t] that ignore later rows of the same time are
differences of two running sums: all rows up to the current one, less those
older than t - w. Both are computed incrementally by Spark's window operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hostgauge.fixed_values import FEATURE_WINDOW_S, SERVING_GAP_S
from hostgauge.schemas import PROCESS_KEY, present

# Bucket length, in lengths of what frames reach back to: the copies are about
# 1/BUCKET_WINDOWS of the rows. A bucket of the short feature window is longer,
# as each bucket also costs a row for the event before it.
BUCKET_WINDOWS = 12
FEATURE_BUCKET_WINDOWS = 60


def with_halo(df: DataFrame, reach_us: int, bucket_us: int, ts: str = "ts_us") -> DataFrame:
    """One row per (event, time bucket whose frames can see it): ``_bucket``, ``_own``."""
    # a row without time is alone in a bucket that no time falls into
    alone = F.coalesce("seq", F.lit(0)).bitwiseOR(F.lit(-(1 << 63)))
    own = F.coalesce(F.floor(F.col(ts) / bucket_us), alone)
    last = F.coalesce(F.floor((F.col(ts) + reach_us) / bucket_us), alone)
    return (
        df.withColumn("_first", own)
        .withColumn("_bucket", F.explode(F.sequence(own, last)))
        .withColumn("_own", F.col("_bucket") == F.col("_first"))
        .drop("_first")
    )


def _last_before(df: DataFrame, keys: list[str], reach_us: int, bucket_us: int) -> DataFrame:
    """For each bucket without halo rows, the time of the key's row before it.

    Works on one row per (key, bucket), so the window over the key is small.
    """
    per_bucket = (
        df.where("ts_us is not null").groupBy(*keys, F.floor(F.col("ts_us") / bucket_us).alias("_bucket"))
        .agg(F.max("ts_us").alias("ts_us"))
    )
    following = F.lead("_bucket").over(Window.partitionBy(*keys).orderBy("_bucket"))
    return (
        per_bucket.withColumn("_bucket", following)
        .where(F.col("_bucket") > F.floor((F.col("ts_us") + reach_us) / bucket_us))
        .withColumn("_own", F.lit(False))
    )


def _frames(group: list[str], window_us: int):
    so_far = Window.partitionBy(*group).orderBy("ts_us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    expired = Window.partitionBy(*group).orderBy("ts_us").rangeBetween(Window.unboundedPreceding, -(window_us + 1))
    return so_far, expired


def _in_frame(opened: Column, closed: Column, so_far, expired) -> Column:
    gone = F.coalesce(F.sum(closed).over(expired), F.lit(0))
    return F.sum(opened).over(so_far) - F.when(F.col("ts_us").isNull(), 0).otherwise(gone)


def with_rolling_features(
    df: DataFrame,
    window_s: float = FEATURE_WINDOW_S,
    max_gap_s: float | None = None,
    keys: list[str] = PROCESS_KEY,
    bucket_windows: int | None = None,
) -> DataFrame:
    """``syscall_rate_5s``, ``unique_syscalls_5s``, ``failed_call_ratio_5s`` and
    ``inter_arrival_ms`` for each event, over the trailing ``window_s`` seconds.

    Needs ``ts_us`` (microseconds) and ``seq`` (arrival order). With
    ``max_gap_s`` (serving) a longer gap counts as the first event. Tables
    without the needed columns get the defaults 1, 1, 0, 0.
    """
    if not present(df, "ts_us", "seq", "eventId", "returnValue", *keys):
        return df.withColumns({
            "syscall_rate_5s": F.lit(1.0),
            "unique_syscalls_5s": F.lit(1.0),
            "failed_call_ratio_5s": F.lit(0.0),
            "inter_arrival_ms": F.lit(0.0),
        })

    w = int(window_s * 1_000_000)
    gap = None if max_gap_s is None else int(max_gap_s * 1_000_000)
    reach = max(w, gap or 0)
    bucket_us = reach * (bucket_windows or (FEATURE_BUCKET_WINDOWS if gap is None else BUCKET_WINDOWS))

    rows = with_halo(df, reach, bucket_us)
    if gap is None:
        rows = rows.unionByName(_last_before(df, keys, reach, bucket_us), allowMissingColumns=True)

    group = [*keys, "_bucket"]
    # One exchange for every window below, including those that add eventId.
    rows = rows.repartition(*group)

    same_event = Window.partitionBy(*group, "eventId").orderBy("ts_us", "seq")
    ts = F.col("ts_us")
    before, after = F.lag(ts).over(same_event), F.lead(ts).over(same_event)
    # The number of distinct ids equals the ids that (re)appeared, less those
    # that left: a row opens its id unless the id occurred within w before it,
    # and closes it unless the id occurs again within w.
    rows = rows.withColumns({
        "_opens": F.when(before.isNull() | (ts - before > w), 1).otherwise(0),
        "_closes": F.when(after.isNull() | (after - ts > w), 1).otherwise(0),
        "_failed": F.when(F.col("returnValue") < 0, 1).otherwise(0),
    })

    so_far, expired = _frames(group, w)
    one = F.lit(1)
    rows = rows.withColumns({
        "_n": _in_frame(one, one, so_far, expired),
        "_ids": _in_frame(F.col("_opens"), F.col("_closes"), so_far, expired),
        "_bad": _in_frame(F.col("_failed"), F.col("_failed"), so_far, expired),
        "_prev": F.lag(ts).over(Window.partitionBy(*group).orderBy("ts_us", "seq")),
    })
    delay = ts - F.col("_prev")
    if gap is not None:
        delay = F.when(delay <= gap, delay)
    return (
        rows.where("_own")
        .withColumns({
            "syscall_rate_5s": F.col("_n").cast("double"),
            "unique_syscalls_5s": F.col("_ids").cast("double"),
            "failed_call_ratio_5s": F.col("_bad") / F.col("_n"),
            "inter_arrival_ms": F.coalesce(delay / 1000.0, F.lit(0.0)),
        })
        .drop("_bucket", "_own", "_opens", "_closes", "_failed", "_n", "_ids", "_bad", "_prev")
    )


def with_serving_features(df: DataFrame, window_s: float = FEATURE_WINDOW_S, gap_s: float = SERVING_GAP_S) -> DataFrame:
    return with_rolling_features(df, window_s, max_gap_s=gap_s)


def with_trailing_counts(
    df: DataFrame,
    keys: list[str],
    matches: Column,
    window_s: float,
    bucket_windows: int = BUCKET_WINDOWS,
) -> DataFrame:
    """``total_count`` and ``match_count`` over [t - window_s, t] for each row."""
    w = int(window_s * 1_000_000)
    group = [*keys, "_bucket"]
    so_far, expired = _frames(group, w)
    hit = F.when(matches, 1).otherwise(0)
    return (
        with_halo(df, w, w * bucket_windows)
        .withColumn("_hit", hit)
        .withColumns({
            "total_count": _in_frame(F.lit(1), F.lit(1), so_far, expired),
            "match_count": _in_frame(F.col("_hit"), F.col("_hit"), so_far, expired),
        })
        .where("_own")
        .drop("_bucket", "_own", "_hit")
    )
