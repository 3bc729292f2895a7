"""Severity tiers, caps and predictions derived from a normality score."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hostgauge.fixed_values import CAP_TO_ONE, CAP_TO_ZERO
from hostgauge.functions.event_features import folded_name


def severity(score: Column, low: Column, high: Column) -> Column:
    """2 below ``high``, 1 below ``low``, else 0; 0 without usable thresholds.

    NaN sorts above every number in Spark, so it is tested explicitly.
    """
    unusable = low.isNull() | high.isNull() | F.isnan(low) | F.isnan(high)
    return F.when(unusable, 0).when(score < high, 2).when(score < low, 1).otherwise(0)


def _names(names: list[str], fold_case: bool) -> list[str]:
    return [n.lower() for n in names] if fold_case else names


def capped_at(sev: Column, process_name: str = "processName", fold_case: bool = False) -> Column:
    """0 or 1 for capped processes, else null.

    Event names are lower-cased but the list is not, so its mixed-case entries
    match only with ``fold_case``.
    """
    name = folded_name(process_name)
    return (
        F.when(name.isin(_names(CAP_TO_ZERO, fold_case)), F.lit(0))
        .when(name.isin(_names(CAP_TO_ONE, fold_case)) & (sev > 1), F.lit(1))
    )


def apply_cap(sev: Column, cap: Column) -> Column:
    return F.coalesce(cap, sev)


def malicious_pred(sev: Column) -> Column:
    return (sev >= 1).cast("int")


def is_anomaly(sev: Column) -> Column:
    return sev > 0
