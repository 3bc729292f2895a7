"""Per-event scalar features: argument text, process name, thread, entity key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hostgauge.fixed_values import ARGS_PATTERNS, LEGACY_FEATURES, NAME_LEXICONS
from hostgauge.functions.columns import whole_json
from hostgauge.schemas import present


def args_blob(args: Column | str = "args") -> Column:
    """The ``value`` of every object of a JSON array, joined with a blank.

    Text that is no JSON array gives "". An object without ``value`` adds an
    empty part, one whose value is null adds none, other elements are skipped.
    """
    c = F.col(args) if isinstance(args, str) else args
    elements = F.try_variant_get(whole_json(c), "$", "array<variant>")
    objects = F.filter(elements, lambda x: F.try_variant_get(x, "$", "map<string,variant>").isNotNull())
    values = F.transform(objects, lambda x: F.try_variant_get(x, "$.value", "variant"))
    shown = F.filter(values, lambda v: ~F.coalesce(F.is_variant_null(v), F.lit(False)))
    return F.coalesce(F.array_join(F.transform(shown, _variant_text), " "), F.lit(""))


def _variant_text(v: Column) -> Column:
    text = F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))
    # JSON true/false print with a capital
    return F.when(
        text.isin("true", "false") & (F.schema_of_variant(v) == "BOOLEAN"), F.initcap(text)
    ).otherwise(text)


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def blob_features(blob: Column) -> dict[str, Column]:
    out = {"args_total_length": F.length(blob).cast("double")}
    for name, pattern in ARGS_PATTERNS.items():
        out[name] = flag(blob.rlike(pattern))
    return out


def folded_name(column: str = "processName") -> Column:
    return F.lower(F.coalesce(F.col(column), F.lit("")))


def name_features(column: str = "processName") -> dict[str, Column]:
    return {k: flag(folded_name(column).isin(words)) for k, words in NAME_LEXICONS.items()}


def is_thread_event(missing_is_thread: bool = False) -> Column:
    """threadId differs from processId. A missing thread id means "the process
    itself" when serving; in training (``missing_is_thread``) it reads as 0."""
    pid = F.coalesce(F.col("processId"), F.lit(0))
    if missing_is_thread:
        tid = F.coalesce(F.col("threadId"), F.lit(0))
    else:
        tid = F.coalesce(F.nullif(F.col("threadId"), F.lit(0)), pid)
    return flag(tid != pid)


def zero_if_null(column: str) -> Column:
    return F.coalesce(F.col(column).cast("double"), F.lit(0.0))


def with_scalar_features(df: DataFrame, missing_is_thread: bool = False) -> DataFrame:
    """All features that need only the event's own row; 0 for absent inputs."""
    has_args = present(df, "args")
    if has_args:
        # a column of its own, so that the JSON is parsed once and not per flag
        df = df.withColumn("args_blob", args_blob())
        cols = blob_features(F.col("args_blob"))
    else:
        cols = {k: F.lit(0.0) for k in ["args_total_length", *ARGS_PATTERNS]}
    if present(df, "processName"):
        cols |= name_features()
    else:
        cols |= {k: F.lit(0.0) for k in NAME_LEXICONS}
    if present(df, "threadId", "processId"):
        cols["is_thread_event"] = is_thread_event(missing_is_thread)
    else:
        cols["is_thread_event"] = F.lit(0.0)
    out = df.withColumns(cols)
    return out.drop("args_blob") if has_args else out


def entity_key(mode: str = "host_user", user: str = "userId", host: str = "hostName") -> Column:
    """Text key of the threshold group: ``user``, ``host_user`` or ``host``."""
    u = F.coalesce(F.col(user).cast("string"), F.lit("UNKNOWN_USER"))
    if mode == "user":
        return u
    if mode == "host_user":
        return F.concat_ws(":", F.coalesce(F.col(host).cast("string"), F.lit("UNKNOWN_HOST")), u)
    if mode == "host":
        return F.coalesce(F.col(host).cast("string"), F.lit("UNKNOWN"))
    raise ValueError(f"unknown group mode {mode!r}")


def legacy_vector(df: DataFrame, *keep: str) -> DataFrame:
    """Seven raw columns as doubles; rows with a gap in any of them are dropped."""
    cols = [F.expr(f"try_cast(`{c}` as double)").alias(c) for c in LEGACY_FEATURES]
    return df.select(*keep, *cols).dropna(subset=LEGACY_FEATURES)
