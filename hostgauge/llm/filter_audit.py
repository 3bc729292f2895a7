"""How filters interact: what each removes at each step of every order they can be applied in.

A document is described by the set of filters it fails. Each such set stands for
one big integer with a 64-bit field per (order, step), 120 x 5 of them for five
filters, that is 1 where a document with this set is removed. The integers of a
part's documents are added up, and one sum holds the counts of all steps of all
orders. A field counts documents of one part, so it cannot run over into the next.
"""

from __future__ import annotations

from functools import cache
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from hostgauge.llm.common import SPACE
from hostgauge.session import lookup_side, materialize

FILTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_CAPITAL_PERCENT = 5
MARKS = "[#$%&*|]"
_FIELD = np.dtype("<u8")

AUDIT_SCHEMA = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
    "good_lost bigint, toxic_lost bigint, shapley bigint"
)


def failed_filters(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and ``failed`` per row: bit i is set if the row fails filter i of ``FILTERS``.

    Null text is empty text. A row fails E if a row with a smaller id has the same
    text; a null id is neither smaller nor larger than any. Rows that repeat with
    their id do not fail E by each other.
    """
    keep = keep or [doc_id]
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, SPACE), "")
    rows = docs.select(
        F.struct(*keep).alias("kept"),
        F.col(doc_id).alias("id"),
        F.size(words).alias("words"),
        F.size(F.array_distinct(words)).alias("distinct"),
        F.length(F.regexp_replace(t, "[^A-Z]+", "")).alias("capitals"),
        F.length(t).alias("chars"),
        t.rlike(MARKS).alias("marked"),
        F.unhex(F.sha2(t, 256)).alias("digest"),
    )
    own = [
        F.col("words") < MIN_WORDS,
        F.col("distinct") * F.lit(100).cast("bigint") < F.col("words") * F.lit(MIN_DISTINCT_PERCENT).cast("bigint"),
        F.col("capitals") * F.lit(100).cast("bigint") > F.col("chars") * F.lit(MAX_CAPITAL_PERCENT).cast("bigint"),
        F.col("marked"),
    ]
    bits = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(own)), F.lit(0))
    rows = materialize(rows.select("kept", "id", "digest", bits.alias("failed")))
    firsts = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 1")
    firsts = lookup_side(materialize(firsts.select("digest", "first")))  # stored: the rows of a frequent text can be split
    repeats = F.when(F.col("id") > F.col("first"), 1 << len(own)).otherwise(0)
    return rows.join(firsts, "digest", "left").select("kept.*", (F.col("failed") + repeats).alias("failed"))


@cache
def orders(n: int) -> list[tuple[int, ...]]:
    return list(permutations(range(n)))


@cache
def packed(failed: int, n: int) -> int:
    """The big integer of a set of failed filters: a field is 1 where its step removes the document."""
    fields = np.zeros((len(orders(n)), n), _FIELD)
    for at, order in enumerate(orders(n)):
        step = next((s for s, f in enumerate(order) if failed >> f & 1), None)
        if step is not None:
            fields[at, step] = 1
    return int.from_bytes(fields.tobytes(), "little")


def unpacked(total: int, n: int) -> np.ndarray:
    """Counts by order and step."""
    return np.frombuffer(total.to_bytes(len(orders(n)) * n * _FIELD.itemsize, "little"), _FIELD).reshape(-1, n).astype(np.int64)


def _audit(part: str, failed: np.ndarray, n: np.ndarray, good: np.ndarray, toxic: np.ndarray, filters: str) -> pd.DataFrame:
    k = len(filters)
    integers = [packed(int(f), k) for f in failed]

    def summed(counts: np.ndarray) -> np.ndarray:
        return unpacked(sum(int(c) * i for c, i in zip(counts, integers)), k)

    removed, good_lost, toxic_lost = summed(n), summed(good), summed(toxic)
    order = np.array(orders(k))
    share = np.zeros(k, np.int64)
    np.add.at(share, order, removed)
    fails = np.zeros(k, np.int64)
    fails[order[:, 0]] = removed[:, 0]  # first in an order, a filter removes all that fail it
    alone = np.zeros(k, np.int64)
    alone[order[:, -1]] = removed[:, -1]  # last, only what no other filter takes
    return pd.DataFrame({
        "part": part,
        "filter_order": np.repeat(["".join(filters[f] for f in o) for o in order], k),
        "step": np.tile(np.arange(1, k + 1, dtype=np.int32), len(order)),
        "kept": (n.sum() - removed.cumsum(axis=1)).ravel(),
        "removed": removed.ravel(),
        "redundant": (fails[order] - removed).ravel(),
        "unique_fails": alone[order].ravel(),
        "good_lost": good_lost.ravel(),
        "toxic_lost": toxic_lost.ravel(),
        "shapley": share[order].ravel(),
    })


def interactions(flagged: DataFrame, filters: str = FILTERS) -> DataFrame:
    """All steps of all orders of ``filters`` per part.

    ``flagged`` has part, failed (bits), good and toxic (boolean). Rows are first
    counted per part and set, so a part of any size ends in at most 4 * 2^k rows,
    and each count times its integer is the sum of that many integers. At most
    eight filters (40,320 orders). Null parts count as the empty string. No rows in, no rows out.
    """
    if not 0 < len(filters) <= 8:
        raise ValueError("one to eight filters")
    counted = flagged.groupBy(F.coalesce("part", F.lit("")).alias("part"), "failed").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")
    )

    def audit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        columns = [rows[c].to_numpy() for c in ("failed", "n", "good", "toxic")]
        return _audit(key[0], *columns, filters)

    return counted.groupBy("part").applyInPandas(audit, AUDIT_SCHEMA)


def audit_documents(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source"
) -> DataFrame:
    """The interactions of the five filters over ``docs``, by ``part``.

    ``labels`` has ``doc_id``, quality and toxic; a document is good or toxic if any
    label row of its id says 1. Rows with a null id have no labels. Other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(part).cast("string").alias("part"), F.col(text).alias("text"))
    flagged = failed_filters(rows, "text", "id", ["id", "part"])
    marks = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(
        F.bool_or(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.bool_or(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    marks = lookup_side(materialize(marks.where("good or toxic")))
    return interactions(flagged.join(marks, "id", "left").fillna(False, ["good", "toxic"]))
