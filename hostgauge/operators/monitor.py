"""Read queries over score, event and host tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hostgauge.fixed_values import DRIFT_MIN_SAMPLE, DRIFT_SAMPLE, FEATURES, HIGH_PERCENTILE, LOW_PERCENTILE
from hostgauge.operators.ordered import first_rows, side_by_side
from hostgauge.session import lookup_side

HOUR_US = 3_600_000_000


def latest_rows(df: DataFrame, n: int, groups: list[str] | None = None, bin_us: int = HOUR_US) -> DataFrame:
    """The newest ``n`` rows (per group). Whole hours, then seconds, then milliseconds
    are taken or dropped by counts; only the rows of one millisecond are sorted."""
    newest = [F.desc("ts_us"), F.desc("seq")]
    bins = [-F.floor(F.col("ts_us") / us) for us in (bin_us, 1_000_000, 1000)]
    return first_rows(df, n, newest, bins, groups)


def retain_last(df: DataFrame, n: int, by: str = "hostname") -> DataFrame:
    """What a stream per host keeps after trimming: its newest ``n`` rows."""
    return latest_rows(df, n, [by])


def recent_scores(scores: DataFrame, host: str, n: int = 50) -> DataFrame:
    decoded = scores.where((F.col("hostname") == host) & F.col("raw_score").isNotNull())
    return decoded.orderBy(F.desc("ts_us"), F.desc("seq")).limit(n)


def live_tail(events: DataFrame, n: int = 500) -> DataFrame:
    return events.orderBy(F.desc("ts_us"), F.desc("seq")).limit(n)


def drift(
    scores: DataFrame,
    low: float | Column,
    high: float | Column,
    expected_low_pct: float | None = LOW_PERCENTILE,
    sample: int = DRIFT_SAMPLE,
    score: str = "raw_score",
    expected_high_pct: float | None = HIGH_PERCENTILE,
    n_features: int = len(FEATURES),
) -> DataFrame:
    """One row comparing the newest scores with what the thresholds promise: the thresholds and what is expected of
    them, and, once there are enough scores, what is observed."""
    low, high = F.lit(low), F.lit(high)
    newest = latest_rows(scores.where(F.col(score).isNotNull()).select("ts_us", "seq", score), sample)
    s = F.col(score)
    found = newest.agg(
        F.count(F.lit(1)).alias("samples"),
        (F.avg((s < low).cast("double")) * 100).alias("observed_low_pct"),
        (F.avg((s < high).cast("double")) * 100).alias("observed_high_pct"),
        F.avg(s).alias("score_mean"),
        F.stddev_pop(s).alias("score_std"),
        F.min(s).alias("score_min"),
        F.max(s).alias("score_max"),
    )
    few = F.col("samples") < DRIFT_MIN_SAMPLE
    expected = float(expected_low_pct or 0.0)
    status = (
        F.when(few, "warming-up")
        .when((F.lit(expected) > 0) & (F.col("observed_low_pct") > expected * 3), "drift-suspected")
        .otherwise("ok")
    )
    measured = [c for c in found.columns if c != "samples"]
    settings = {
        "global_low_threshold": low.cast("double"), "global_high_threshold": high.cast("double"),
        "expected_low_pct": F.lit(expected_low_pct).cast("double"), "expected_high_pct": F.lit(expected_high_pct).cast("double"),
        "n_features": F.lit(n_features),
    }
    return found.select(
        "samples", status.alias("status"), *[c.alias(k) for k, c in settings.items()],
        *[F.when(~few, F.col(c)).alias(c) for c in measured],
    )


def drift_part(scores: DataFrame, low: float, high: float, score: str = "raw_score") -> DataFrame:
    """One row of sums over scores, such that rows of several parts can be merged: count, mean, squared distance
    from it, extremes, and hits per threshold."""
    s = F.col(score)
    return scores.where(s.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg(s).alias("mean"),
        F.coalesce(F.var_pop(s) * F.count(F.lit(1)), F.lit(0.0)).alias("m2"), F.min(s).alias("least"), F.max(s).alias("most"),
        F.count_if(s < F.lit(low)).alias("below_low"), F.count_if(s < F.lit(high)).alias("below_high"),
    )


def drift_of_parts(
    parts: list[dict], low: float, high: float, expected_low_pct: float | None, expected_high_pct: float | None, n_features: int
) -> tuple:
    """What ``drift`` says, from the parts of a sample."""
    n, mean, m2 = 0, 0.0, 0.0
    held = [p for p in parts if p["n"]]
    for p in held:
        both, away = n + p["n"], p["mean"] - mean
        m2 += p["m2"] + away * away * n * p["n"] / both
        mean += away * p["n"] / both
        n = both
    settings = (low, high, expected_low_pct, expected_high_pct, n_features)
    if n < DRIFT_MIN_SAMPLE:
        return (n, "warming-up", *settings, *[None] * 6)
    below_low = sum(p["below_low"] for p in held) * 100.0 / n
    below_high = sum(p["below_high"] for p in held) * 100.0 / n
    expected = float(expected_low_pct or 0.0)
    status = "drift-suspected" if expected > 0 and below_low > expected * 3 else "ok"
    extremes = min(p["least"] for p in held), max(p["most"] for p in held)
    return (n, status, *settings, below_low, below_high, mean, (m2 / n) ** 0.5, *extremes)


def host_activity(batches: DataFrame, hosts: DataFrame, as_of_us: Column, window_us: int = 60_000_000) -> DataFrame:
    """Per known host: batches and events of the last minute and the last time seen.

    ``batches`` has hostname, ts_us and n_events, one row per received message.
    Hosts without traffic are listed with 0 and null.
    """
    recent = F.col("ts_us") >= as_of_us - window_us
    per_host = batches.where(F.col("ts_us") <= as_of_us).groupBy("hostname").agg(
        F.count_if(recent).alias("batches_per_min"),
        F.coalesce(F.sum(F.when(recent, F.col("n_events"))), F.lit(0)).cast("bigint").alias("events_per_min"),
        F.max("ts_us").alias("last_seen_us"),
    )
    return hosts.join(per_host, "hostname", "left").fillna(0, ["batches_per_min", "events_per_min"])


def known_hosts(registrations: DataFrame, events: DataFrame) -> DataFrame:
    """Hosts that registered or sent anything."""
    r = registrations.where("hostname <> ''").select("hostname")
    return r.union(events.select("hostname")).distinct()


def run_counters(scores: DataFrame, forwarded: DataFrame) -> DataFrame:
    """One row: events processed, events forwarded, hosts seen."""
    s = scores.groupBy("hostname").agg(F.count(F.lit(1)).alias("n"))
    total = s.agg(F.sum("n").alias("events_processed"), F.count(F.lit(1)).alias("hosts"))
    sent = forwarded.agg(F.count(F.lit(1)).alias("events_forwarded"))
    return side_by_side(total, sent)


def with_username(df: DataFrame, accounts: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """``username`` from the host's own accounts, else from the central hints
    (user_id, username); null if neither knows the user."""
    own = lookup_side(accounts.select("hostname", "user_id", F.col("username").alias("_own")).dropDuplicates(["hostname", "user_id"]))
    out = df.join(own, ["hostname", "user_id"], "left")
    if hints is None:
        return out.withColumnRenamed("_own", "username")
    hint = lookup_side(hints.select("user_id", F.col("username").alias("_hint")).dropDuplicates(["user_id"]))
    return out.join(hint, "user_id", "left").withColumn("username", F.coalesce("_own", "_hint")).drop("_own", "_hint")
