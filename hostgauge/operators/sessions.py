"""Events joined with dated snapshots of the sessions on their host."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from hostgauge.operators.monitor import HOUR_US
from hostgauge.session import lookup_side, materialize


def with_snapshot_time(
    events: DataFrame, snapshots: DataFrame, bucket_us: int = HOUR_US, store: Callable[[DataFrame], DataFrame] = materialize
) -> DataFrame:
    """``taken_us``: when the newest snapshot of the event's host up to the event's time was taken; null before the first.

    ``snapshots`` has hostName and taken_us. A snapshot holds until the next one. Per
    (host, bucket of time) the snapshots of that bucket and the last one before it are
    gathered, so an event meets a bucket's snapshots and never a host's whole history. Give it stored events.
    """
    bucket = F.floor(F.col("ts_us") / bucket_us)
    taken = snapshots.select("hostName", "taken_us").where("taken_us is not null").distinct()
    taken = taken.withColumn("_bucket", F.floor(F.col("taken_us") / bucket_us))
    asked = events.select("hostName", bucket.alias("_bucket")).where("_bucket is not null").distinct()
    # one row per (host, bucket) on either side: the last snapshot in the bucket, carried on to the buckets after it
    last = taken.groupBy("hostName", "_bucket").agg(F.max("taken_us").alias("_last"))
    both = asked.withColumn("_asked", F.lit(True)).join(last, ["hostName", "_bucket"], "full")
    earlier = Window.partitionBy("hostName").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.withColumn("_carried", F.last("_last", True).over(earlier)).where("_asked")
    within = taken.groupBy("hostName", "_bucket").agg(F.array_sort(F.collect_set("taken_us")).alias("_within"))
    known = carried.select("hostName", "_bucket", "_carried").join(within, ["hostName", "_bucket"], "left")
    known = lookup_side(store(known))
    up_to = F.array_max(F.filter("_within", lambda t: t <= F.col("ts_us")))
    found = events.withColumn("_bucket", bucket).join(known, ["hostName", "_bucket"], "left")
    return found.withColumn("taken_us", F.coalesce(up_to, "_carried")).drop("_bucket", "_carried", "_within")


def events_in_sessions(
    events: DataFrame, log: DataFrame, store: Callable[[DataFrame], DataFrame] = materialize, strict: bool = False,
    bucket_us: int = HOUR_US,
) -> DataFrame:
    """Events of users who had a session on their host at the time.

    ``log`` has hostName, taken_us and userId, a row per session of a snapshot; a
    snapshot without sessions is one row without userId. Where no session is known at the
    time (no snapshot yet, or an empty one) everything passes, unless ``strict``.
    """
    columns = events.columns
    dated = with_snapshot_time(events, log, bucket_us, store)
    users = log.where("userId is not null").select("hostName", "taken_us", "userId").distinct().withColumn("_user", F.lit(True))
    dated = dated.join(lookup_side(store(users)), ["hostName", "taken_us", "userId"], "left")
    if strict:
        return dated.where("_user").select(*columns)
    filled = users.select("hostName", "taken_us").distinct().withColumn("_filled", F.lit(True))
    dated = dated.join(lookup_side(store(filled)), ["hostName", "taken_us"], "left")
    return dated.where(F.col("_user").isNotNull() | F.col("_filled").isNull()).select(*columns)
