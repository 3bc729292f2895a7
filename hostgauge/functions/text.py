"""Time parsing and display text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hostgauge.fixed_values import ALERT_COUNT, ALERT_MIN_RATE


def iso_to_micros(text: Column) -> Column:
    """ISO-8601 text to epoch microseconds; without an offset it is read as UTC."""
    zoned = F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.unix_micros(zoned.try_cast("timestamp"))


def ntz_to_micros(column: str) -> Column:
    """Epoch microseconds of a timestamp without zone, whatever the session zone."""
    since = f"cast(`{column}` - timestamp_ntz'1970-01-01 00:00:00' as interval second)"
    return F.expr(f"cast(cast({since} as decimal(20,6)) * 1000000 as bigint)")


def epoch_seconds(text: Column, ingest_s: Column, unit: float = 1.0) -> Column:
    """Number or ISO text to epoch seconds; what cannot be read gets the ingest time."""
    number = text.try_cast("double") * unit
    return F.coalesce(number, iso_to_micros(text) / 1_000_000, ingest_s)


def trigger_text(high: Column, total: Column) -> Column:
    # bround, because the percentage rounds half to even
    pct = F.bround(high / total * 100, 0).cast("bigint")
    return F.format_string("rate+threshold (sev2=%d/%d=%d%%)", high, total, pct)


def gauge_class(pct: Column) -> Column:
    return F.when(pct >= 100, "full").when(pct >= 70, "warn").otherwise("ok")


def count_gauge(count: Column, threshold: Column | None = None) -> Column:
    t = F.lit(ALERT_COUNT) if threshold is None else threshold
    return F.least(count / t * 100, F.lit(100.0))


def rate_gauge(rate: Column, min_rate: Column | None = None) -> Column:
    m = F.lit(ALERT_MIN_RATE) if min_rate is None else min_rate
    return F.least(rate * 100 / F.greatest(m * 100, F.lit(0.01)) * 100, F.lit(100.0))


def time_since(ts_s: Column, now_s: Column) -> Column:
    s = F.floor(now_s - ts_s)
    return (
        F.when(ts_s.isNull() | (ts_s == 0), "never")
        .when(s < 60, F.concat(s.cast("string"), F.lit("s ago")))
        .otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit("m ago")))
    )
