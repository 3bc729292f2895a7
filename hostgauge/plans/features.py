"""The 22 features of every event."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hostgauge.fixed_values import FEATURE_WINDOW_S, FEATURES
from hostgauge.functions.event_features import with_scalar_features, zero_if_null
from hostgauge.operators.model_stats import with_frequencies
from hostgauge.operators.rolling import with_rolling_features


def feature_rows(
    events: DataFrame,
    freq_tables: DataFrame,
    keep: list[str] = ("hostName", "userId", "processId", "ts_us", "seq"),
    window_s: float = FEATURE_WINDOW_S,
    max_gap_s: float | None = None,
    missing_is_thread: bool = False,
) -> DataFrame:
    """``keep`` and the features in canonical order.

    The scalar features are computed before the windows, so that only numbers
    and not the argument text are shuffled.
    """
    scalar = with_scalar_features(events, missing_is_thread)
    scalar = with_frequencies(scalar, freq_tables)
    needed = {"hostName", "userId", "processId", "ts_us", "seq", "eventId", "argsNum", "returnValue", *keep, *FEATURES}
    rolled = with_rolling_features(scalar.select(*[c for c in scalar.columns if c in needed]), window_s, max_gap_s)
    numeric = {c: zero_if_null(c) if c in rolled.columns else F.lit(0.0) for c in ("argsNum", "returnValue")}
    kept = [c for c in keep if c not in FEATURES]
    return rolled.withColumns(numeric).select(*kept, *FEATURES)
