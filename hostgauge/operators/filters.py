"""Row filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from hostgauge.fixed_values import EXCLUDED_SYSCALLS, UNTRACKED_USER_RANGES
from hostgauge.operators.ordered import hash_bin, row_hash
from hostgauge.schemas import require
from hostgauge.session import lookup_side


def benign(df: DataFrame) -> DataFrame:
    require(df, "sus", "evil")
    return df.where((F.col("sus") == 0) & (F.col("evil") == 0))


def complete(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drops rows that lack a needed id; columns a table does not have are skipped."""
    wanted = ["eventId", "mountNamespace"] if columns is None else columns
    return df.dropna(subset=[c for c in wanted if c in df.columns])


def require_labels(df: DataFrame) -> DataFrame:
    """Scoring works without labels, evaluation does not."""
    require(df, "evil")
    return df


def without_collectors(df: DataFrame, collectors: DataFrame) -> DataFrame:
    """Drops what the collectors (hostName, pid, ppid) or their parents did."""
    ids = collectors.select("hostName", F.explode(F.array("pid", F.nullif("ppid", F.lit(0)))).alias("id")).where("id is not null")
    ids = lookup_side(ids.distinct())
    for column in ("processId", "parentProcessId"):
        side = ids.withColumnRenamed("id", column)
        df = df.join(side, ["hostName", column], "left_anti")
    return df


def remote_sessions_only(df: DataFrame, sessions: DataFrame, strict: bool = False) -> DataFrame:
    """Keeps users with a session (hostName, userId) on their host.

    A host without any session passes everything, unless ``strict``.
    """
    users = sessions.select("hostName", "userId").distinct()
    if strict:
        return df.join(lookup_side(users), ["hostName", "userId"], "left_semi")
    hosts = users.select("hostName").distinct().withColumn("_host", F.lit(True))
    return (
        df.join(lookup_side(users.withColumn("_user", F.lit(True))), ["hostName", "userId"], "left")
        .join(lookup_side(hosts), "hostName", "left")
        .where(F.col("_user").isNotNull() | F.col("_host").isNull())
        .drop("_user", "_host")
    )


def parse_extra_users(text: str) -> list[int]:
    """Comma-separated user ids; parts that are not digits are skipped."""
    return [int(p) for p in text.split(",") if p.strip().isdigit()]


def is_untracked(user: str = "userId", extra: list[int] | None = None) -> Column:
    u = F.col(user)
    hits = [u.between(first, last) for first, last in UNTRACKED_USER_RANGES]
    if extra:
        hits.append(u.isin(list(extra)))
    return reduce(lambda a, b: a | b, hits)


def tracked_users(df: DataFrame, user: str = "userId", extra: list[int] | None = None) -> DataFrame:
    return df.where(~F.coalesce(is_untracked(user, extra), F.lit(False)))


def declared_filters(
    df: DataFrame,
    include_syscalls: list[str] = (),
    exclude_syscalls: list[str] = EXCLUDED_SYSCALLS,
    include_users: list[int] = (),
    exclude_users: list[int] = (),
    min_event_id: int = 0,
    sampling_rate: float = 1.0,
    max_events_per_second: int = 0,
    seed: int = 0,
) -> DataFrame:
    """The collector's configurable filters; empty lists and zeros switch one off."""
    if include_syscalls:
        df = df.where(F.col("eventName").isin(list(include_syscalls)))
    if exclude_syscalls:
        df = df.where(~F.coalesce(F.col("eventName").isin(list(exclude_syscalls)), F.lit(False)))
    if include_users:
        df = df.where(F.col("userId").isin(list(include_users)))
    if exclude_users:
        df = df.where(~F.coalesce(F.col("userId").isin(list(exclude_users)), F.lit(False)))
    if min_event_id:
        df = df.where(F.col("eventId") >= min_event_id)
    if sampling_rate < 1.0:
        # by hash of the row, so a repeated task picks the same rows
        share = hash_bin(row_hash(["hostName", "processId", "ts_us", "seq"], seed), 32)
        df = df.where(share < int(sampling_rate * (1 << 32)))
    if max_events_per_second:
        second = F.floor(F.col("ts_us") / 1_000_000)
        w = Window.partitionBy("hostName", second).orderBy("ts_us", "seq")
        df = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max_events_per_second).drop("_rn")
    return df


def feed(df: DataFrame, severity: int | None = None, host: str | None = None) -> DataFrame:
    if severity is not None:
        df = df.where(F.col("severity") == severity)
    if host is not None:
        df = df.where(F.col("hostname") == host)
    return df


def feed_hosts(df: DataFrame) -> DataFrame:
    return df.select("hostname").distinct()
