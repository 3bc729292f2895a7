"""Mixing sources to target weights, by fitting a sum of document lengths to a budget.

Documents are counted per source and exact length. A source whose target exceeds
its size is taken whole first; the rest of its budget is met by choosing how many
documents of each length to take once more, with a bounded-knapsack table for the
last part, so that the sum is the target itself wherever some choice of documents
reaches it. Which documents of a length are taken is a seeded draw.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from hostgauge.session import materialize

SEED = 20
WEIGHTS = (3.0, 1.0, 2.0)  # by rank of the source, repeating
SHARE = 1.5  # of the words of all sources
MOST = 2.0  # times its own size that a source, or a document, is taken
TABLE = 1 << 16  # words of a budget that the knapsack table fits
DRAW = 1000  # rows of one length that are ranked together
MAX_SOURCES = 1_000_000  # a mix is a list of sources with weights; more is refused


def word_count(text: Column) -> Column:
    """Runs of characters other than space and 0x09-0x0D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(
    sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> dict[str | None, float]:
    """Words to take of each source: ``share`` of all words by weight, none above ``most`` times its size.

    Sources go by code point, null last. What is above a source's bound goes to
    the others by weight, until none is above.
    """
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out: dict[str | None, float] = {}
    budget, free = share * sum(sizes.values()), list(names)
    while free:
        total = sum(weight[s] for s in free)
        above = [s for s in free if budget * weight[s] / total > most * sizes[s]]
        if not above:
            out |= {s: budget * weight[s] / total for s in free}
            break
        for s in above:
            out[s] = most * sizes[s]
        budget -= sum(out[s] for s in above)
        free = [s for s in free if s not in above]
    return out


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED) -> np.ndarray:
    """How many documents of each size to take (at most ``counts``) for a sum near ``budget`` and not above.

    First the same share of every length, then single documents in a seeded order
    of lengths until the rest fits the table, then a bounded knapsack for the rest.
    """
    sizes, counts = sizes.astype(np.int64), counts.astype(np.int64)
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    taken = (counts * (budget / total)).astype(np.int64)
    rest = budget - int((sizes * taken).sum())
    order = np.random.default_rng(seed).permutation(len(sizes))
    more = True
    while rest > TABLE and more:
        more = False
        for i in order.tolist():
            s = int(sizes[i])
            if 0 < s <= rest and taken[i] < counts[i] and rest > TABLE:
                taken[i] += 1
                rest -= s
                more = True
    left = counts - taken
    reached = np.zeros(rest + 1, bool)
    reached[0] = True
    by = np.full(rest + 1, -1, np.int64)  # the step that first reached a sum
    steps: list[tuple[int, int]] = []
    for i in order.tolist():
        s, n, part = int(sizes[i]), int(left[i]), 1
        while s and n > 0 and s <= rest and not reached[rest]:
            k = min(part, n, rest // s)
            new = np.flatnonzero(reached[: rest + 1 - k * s] & ~reached[k * s :]) + k * s
            reached[new] = True
            by[new] = len(steps)
            steps.append((i, k))
            n, part = n - min(part, n), part * 2
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, k = steps[by[at]]
        taken[i] += k
        at -= k * int(sizes[i])
    return taken


def mix(
    docs: DataFrame, text: str = "text", source: str = "source", keep: list[str] | None = None, doc_id: str = "doc_id",
    weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED,
) -> DataFrame:
    """One row per input row: ``keep``, ``size``, ``source_size``, ``target``, ``copies``, ``taken`` (= size * copies).

    Null sources are one source, null and wordless texts have size 0. Equal rows
    are drawn like any others; which of them is taken does not show in the result.
    The draw depends on ids and texts only, so reruns agree. Without rows, or
    without words, nothing is taken.
    """
    keep = keep or [doc_id]
    spark = docs.sparkSession
    drawn = F.xxhash64(F.col(doc_id), F.col(text), F.lit(seed))  # the text spreads rows without an id
    rows = materialize(
        docs.select(*[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)], F.col(source).alias("source"),
                    word_count(F.col(text)).alias("size"), drawn.alias("draw"))
    )
    by_size = materialize(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    per_source = by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    found = per_source.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    wanted = targets({r["source"]: r["source_size"] for r in found}, weights, share, most)
    plan = spark.createDataFrame(
        [(r["source"], r["source_size"], wanted[r["source"]]) for r in found], "source string, source_size bigint, target double"
    )

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ignore_index=True)
        whole, target = int(pdf.source_size[0]), float(pdf.target[0])
        base = int(target // whole) if whole else 0
        pdf["base"] = base
        pdf["more"] = fit(pdf["size"].to_numpy(), pdf["n"].to_numpy(), round(target) - base * whole, seed) if whole else 0
        return pdf[["source", "size", "n", "source_size", "target", "base", "more"]]

    same = lambda x, y, *names: [x[n].eqNullSafe(y[n]) for n in names]
    sized = by_size.join(plan, same(by_size, plan, "source")).select(by_size["*"], "source_size", "target")
    chosen = materialize(
        sized.groupBy("source").applyInPandas(
            choose, "source string, size bigint, n bigint, source_size bigint, target double, base bigint, more bigint"
        )
    )
    # A length that very many documents share is drawn in bins of their draws, of about DRAW rows each.
    bins = F.ceil(F.col("n") / DRAW)
    of = F.pmod(F.shiftrightunsigned("draw", 1), bins).alias("bin")
    joined = rows.join(F.broadcast(chosen) if _small(chosen) else chosen, same(rows, chosen, "source", "size"))
    binned = joined.select(
        *[f"k_{i}" for i in range(len(keep))], rows["source"], rows["size"], "draw", "source_size", "target", "base", "more", of
    )
    counted = binned.groupBy("source", "size", "bin").agg(F.count(F.lit(1)).alias("m"), F.first("more").alias("want"))
    before = F.sum("m").over(Window.partitionBy("source", "size").orderBy("bin")) - F.col("m")
    cut = counted.select(
        F.col("source").alias("s"), F.col("size").alias("z"), F.col("bin").alias("b"),
        F.least(F.greatest(F.col("want") - before, F.lit(0)), "m").alias("quota"), "m",
    )
    # Whole bins need no ranking; ranks are taken inside the others only.
    marked = binned.join(
        cut, [F.col("source").eqNullSafe(F.col("s")), F.col("size") == F.col("z"), F.col("bin") == F.col("b")]
    )
    rank = F.row_number().over(Window.partitionBy("source", "size", "bin").orderBy("draw"))
    partly = (F.col("quota") > 0) & (F.col("quota") < F.col("m"))
    result = ["size", "source_size", "target", "copies"]
    names = [f"k_{i}" for i in range(len(keep))]
    whole = marked.where(~partly).select(*names, *result[:3], (F.col("base") + (F.col("quota") > 0).cast("bigint")).alias("copies"))
    ranked = marked.where(partly).withColumn("rank", rank).select(
        *names, *result[:3], (F.col("base") + (F.col("rank") <= F.col("quota")).cast("bigint")).alias("copies")
    )
    out = whole.unionAll(ranked)
    return out.select(
        *[F.col(n).alias(c) for n, c in zip(names, keep)], *result, (F.col("size") * F.col("copies")).alias("taken")
    )


def _small(stored: DataFrame, rows: int = 200_000) -> bool:
    """Lengths per source are numbers only: 200,000 rows are under 15 MB."""
    return stored.limit(rows + 1).count() <= rows
