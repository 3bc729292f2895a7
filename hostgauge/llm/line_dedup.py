"""Deduplication of lines through overlapping windows of three lines.

Every three consecutive lines are hashed; windows met more than once anywhere are
kept at their first place (by id, then position) and their later places are
merged into covered positions, whose lines go. A removed line always stands at an
earlier place as well, so no line vanishes from the corpus. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hostgauge.session import lookup_side, materialize

WINDOW = 3


def without_repeated_windows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_lines``, ``n_removed``, ``text`` (what stays, joined by line feeds).

    Lines end at line feeds; null counts as empty text (one empty line). Texts of
    fewer than ``window`` lines have no window and stay. Places go by id (null
    first), then a hash of the text, then position. Rows repeated with equal id and
    text are one place and have equal results. No rows in, no rows out.

    Windows are compared by 128 bits of hash. Only hashes and positions are
    shuffled, with counts and first places combined before; texts move once, to
    meet their positions.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(whole).alias("own"), F.split(whole, "\n", -1).alias("lines"))
    n = F.size("lines")
    starts = F.when(n >= window, F.sequence(F.lit(0), n - window)).otherwise(F.array().cast("array<int>"))

    def at(i):
        lines = [F.get("lines", i + k) for k in range(window)]
        return F.struct(i.alias("pos"), F.xxhash64(*lines).alias("w1"), F.xxhash64(F.lit(1), *lines).alias("w2"))

    windows = rows.select("doc", "own", F.inline(F.transform(starts, at)))
    place = F.struct("doc", "own", "pos")
    repeated = (
        windows.groupBy("w1", "w2")
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .drop("n")
    )
    repeated = lookup_side(materialize(repeated))  # stored, so that the places of a frequent window can be split among tasks
    later = windows.join(repeated, ["w1", "w2"]).where(~place.eqNullSafe(F.col("first")))
    covered = later.groupBy("doc", "own").agg(F.collect_set("pos").alias("at"))
    covered = covered.select(
        F.col("doc").alias("c_doc"), F.col("own").alias("c_own"),
        F.array_distinct(F.flatten(F.transform("at", lambda p: F.array(*[p + k for k in range(window)])))).alias("covered"),
    )
    joined = rows.join(covered, F.col("doc").eqNullSafe(F.col("c_doc")) & (F.col("own") == F.col("c_own")), "left")
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce("covered", F.array().cast("array<int>")))
    return joined.select(
        F.col("doc").alias(doc_id),
        n.cast("bigint").alias("n_lines"),
        F.coalesce(F.size("covered"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.when(F.col("covered").isNull(), F.array_join("lines", "\n"))
        .otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
        .alias("text"),
    )
