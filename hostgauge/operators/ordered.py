"""Order statistics without sorting a whole group in one task.

Rows are first counted per coarse value bin (a small, map-side combined
aggregate). Running totals over the few bins tell where every bin starts in the
order, so only the rows of one bin at a time have to be sorted together. All
results are exact; bins only decide which task sorts which rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from hostgauge.functions.columns import once
from hostgauge.session import lookup_side, materialize

BINS_PER_OCTAVE = 1024
_OCTAVES = 1100  # more than the exponents of a double
SORTED_AT_ONCE = 1_000_000  # distinct values of a bin that one task sorts; larger bins are cut again
_PARTS = 1024


def value_bin(value: Column) -> Column:
    """Bin number that never falls when ``value`` rises."""
    # infinity lies above every finite value
    octave = F.least(F.log2(F.abs(value)), F.lit(float(_OCTAVES)))
    level = F.floor(octave * BINS_PER_OCTAVE) + _OCTAVES * BINS_PER_OCTAVE
    return F.when(value > 0, level).when(value < 0, -level).otherwise(F.lit(0).cast("bigint"))


def hash_bin(key_hash: Column, bits: int = 12) -> Column:
    return F.shiftrightunsigned(key_hash, 64 - bits)


def row_hash(columns: list[str], seed: int) -> Column:
    """64-bit hash that orders rows at random; read as unsigned by ``hash_bin``."""
    return F.xxhash64(*[F.col(c) for c in columns], F.lit(seed))


def exact_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], groups: list[str] | None = None, n: str = "n_scores"
) -> DataFrame:
    """Linearly interpolated quantiles: one column per entry of ``probs``, and ``n``."""
    found = quantile_array(df, value, list(probs.values()), groups, n)
    named = [F.col("quantiles")[i].alias(name) for i, name in enumerate(probs)]
    return found.select(*(groups or []), *named, n)


def quantile_array(
    df: DataFrame, value: str, probs: list[float], groups: list[str] | None = None, n: str = "n_scores",
    sorted_at_once: int = SORTED_AT_ONCE,
) -> DataFrame:
    """``quantiles``, the linearly interpolated quantiles in the order of ``probs``, and ``n``.

    ``groups`` must not be null. A first pass counts rows per bin, a second one
    takes only the rows of the few bins that hold a wanted rank; give it a stored
    table, as it is read twice. Without groups there is always one row, of nulls
    and 0 if there are no values.
    """
    groups = groups or []
    v = F.col(value)
    # 0.0 and -0.0 are one value
    values = df.where(v.isNotNull() & ~F.isnan(v)).select(*groups, (v + F.lit(0.0)).alias("_v"))
    values = values.withColumn("_bin", value_bin(F.col("_v")))

    per_bin = values.groupBy(*groups, "_bin").agg(F.count(F.lit(1)).alias("_c"))
    up_to = Window.partitionBy(*groups).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*groups)
    per_bin = per_bin.withColumns({"_end": F.sum("_c").over(up_to), "_n": F.sum("_c").over(whole)})
    wishes = F.array(*[F.lit(float(p)) for p in probs])

    def around(p: Column) -> Column:
        position = p * (F.col("_n") - 1)
        return F.array(F.floor(position), F.ceil(position))

    ranks = F.flatten(F.transform(wishes, around))
    start = F.col("_end") - F.col("_c")
    wanted = per_bin.select(
        *groups,
        "_bin",
        "_n",
        start.alias("_start"),
        once(F.array_distinct(F.filter(ranks, lambda r: (r >= start) & (r < F.col("_end"))))).alias("_ranks"),
    ).where(F.size("_ranks") > 0)
    # At most two rows per wanted quantile and group. Stored and counted, it is
    # broadcast unless there are very many groups, and the other rows go no further.
    wanted = lookup_side(materialize(wanted))

    # equal values count as one row, so a value that most rows share costs nothing
    counted = values.join(wanted, [*groups, "_bin"]).groupBy(*groups, "_bin", "_v").agg(
        F.count(F.lit(1)).alias("_c"), *[F.first(c).alias(c) for c in ("_n", "_start", "_ranks")]
    )
    counted = _split_crowded(counted, groups, sorted_at_once)
    inside = Window.partitionBy(*groups, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    picks = (
        counted
        .withColumn("_end", F.col("_start") + F.sum("_c").over(inside))
        .withColumn("_r", F.explode(F.filter("_ranks", lambda r: (r >= F.col("_end") - F.col("_c")) & (r < F.col("_end")))))
    )
    at_rank = picks.groupBy(*groups).agg(
        F.coalesce(F.first("_n"), F.lit(0)).alias(n),
        F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_at"),
    )

    def between(p: Column) -> Column:
        position = p * (F.col(n) - 1)
        low, high = F.element_at("_at", F.floor(position)), F.element_at("_at", F.ceil(position))
        return low + (high - low) * (position - F.floor(position))

    return at_rank.select(*groups, F.transform(wishes, between).alias("quantiles"), n)


def _split_crowded(counted: DataFrame, groups: list[str], most: int) -> DataFrame:
    """Rows (value, count) of bins that hold wanted ranks, without bins of more than ``most`` distinct values.

    A crowded bin is cut into ``_PARTS`` equal ranges of its values, and only the ranges
    that hold a wanted rank go on; each round narrows a range by that factor, so a few
    rounds tell even neighbouring doubles apart. Bins that are small enough wait aside.
    """
    keys = [*groups, "_bin"]
    counted = materialize(counted)
    done = None
    while True:
        sizes = counted.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_distinct"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
        )
        crowded = materialize(sizes.where((F.col("_distinct") > most) & (F.col("_low") < F.col("_high"))).drop("_distinct"))
        if crowded.isEmpty():
            return counted if done is None else done.unionByName(counted)
        crowded = lookup_side(crowded)
        small = counted.join(crowded.select(*keys), keys, "left_anti")
        done = small if done is None else done.unionByName(small)
        # the distance of two very large doubles may be infinite, that of their halves is not
        scale = F.when(F.greatest(F.abs("_low"), F.abs("_high")) > 1e300, 0.5).otherwise(1.0)
        low = F.col("_low") * scale
        place = (F.col("_v") * scale - low) / (F.col("_high") * scale - low)
        part = F.least(F.floor(place * _PARTS), F.lit(_PARTS - 1)).cast("bigint")
        rows = counted.join(crowded, keys).withColumn("_part", part).drop("_low", "_high")
        per_part = rows.groupBy(*keys, "_part").agg(
            F.sum("_c").alias("_in"), *[F.first(c).alias(c) for c in ("_start", "_ranks")]
        )
        before = F.sum("_in").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
        at = F.col("_start") + F.coalesce(before, F.lit(0))
        wanted = F.filter("_ranks", lambda r: (r >= F.col("_at")) & (r < F.col("_at") + F.col("_in")))
        kept = per_part.withColumn("_at", at).withColumn("_of", wanted).where(F.size("_of") > 0)
        # ranges are numbered apart from all bins and from those of other rounds
        number = F.xxhash64("_bin", "_part", F.col("_at"))
        kept = materialize(kept.select(*keys, "_part", "_at", "_of", number.alias("_next")))
        rows = rows.drop("_start", "_ranks").join(lookup_side(kept), [*keys, "_part"])
        counted = materialize(rows.select(
            *groups, F.col("_next").alias("_bin"), "_v", "_c", "_n", F.col("_at").alias("_start"), F.col("_of").alias("_ranks")
        ))


def running_total(
    df: DataFrame, weight: str, order: list[Column], bins: list[Column], groups: list[str] | None = None, out: str = "start",
    store: Callable[[DataFrame], DataFrame] = materialize,
) -> DataFrame:
    """``out``: the sum of ``weight`` over the rows before a row, per group or overall.

    ``bins``, coarse to fine, must not fall along ``order`` and must not be null. Each
    level adds up whole bins inside those of the level above, so no task sees more than
    the finer bins of one bin, and in the end the rows of one finest bin. Give it stored rows.
    """
    groups = list(groups or [])
    rows = df.withColumns({f"__bin{i}": b for i, b in enumerate(bins)})
    names: list[str] = []
    starts = None
    for i in range(len(bins)):
        above, name = [*groups, *names], f"__bin{i}"
        per_bin = rows.groupBy(*above, name).agg(F.sum(weight).alias("__w"))
        up_to = Window.partitionBy(*above).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
        level = per_bin.withColumn("__before", F.coalesce(F.sum("__w").over(up_to), F.lit(0))).drop("__w")
        if starts is not None:
            level = level.join(starts.withColumnRenamed("__before", "__above"), above).withColumn("__before", F.col("__before") + F.col("__above")).drop("__above")
        starts = store(level)
        names.append(name)
    inside = Window.partitionBy(*groups, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.join(lookup_side(starts), [*groups, *names])
    before = F.coalesce(F.sum(weight).over(inside), F.lit(0))
    return found.withColumn(out, (F.col("__before") + before).cast("bigint")).drop("__before", *names)


def rank_curve(df: DataFrame, value: str, sums: dict[str, Column]) -> DataFrame:
    """Distinct values in rising order with, per entry of ``sums``, the sum at the
    value (``name``), below it (``name_below``) and overall (``name_all``)."""
    v = F.col(value)
    at = (
        df.where(v.isNotNull())
        .groupBy((v + F.lit(0.0)).alias(value))
        .agg(*[F.sum(c).alias(k) for k, c in sums.items()])
        .withColumn("_bin", value_bin(F.col(value)))
    )
    bins = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    per_bin = at.groupBy("_bin").agg(*[F.sum(k).alias(f"_{k}") for k in sums])
    per_bin = per_bin.select(
        "_bin",
        *[(F.sum(f"_{k}").over(bins) - F.col(f"_{k}")).alias(f"_{k}_start") for k in sums],
        *[F.sum(f"_{k}").over(everything).alias(f"{k}_all") for k in sums],
    )
    inside = Window.partitionBy("_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    joined = at.join(per_bin, "_bin")
    return joined.select(
        value,
        *sums,
        *[(F.col(f"_{k}_start") + F.sum(k).over(inside) - F.col(k)).alias(f"{k}_below") for k in sums],
        *[f"{k}_all" for k in sums],
    )


def first_rows(
    df: DataFrame, k: int, order: list[Column], bins: list[Column], groups: list[str] | None = None
) -> DataFrame:
    """The first ``k`` rows of each group (or overall) in the given total order.

    ``bins``, coarse to fine, must not fall along ``order``. Bins that lie before
    the cut are taken whole and those past it dropped, by counts alone; only the bin
    that holds the cut is looked into, by the next finer bins and in the end by a
    sort of its rows. ``groups`` must not be null.
    """
    groups = list(groups or [])
    rows, names, taken = df, [], []
    quota: Column = F.lit(k)
    for i, each in enumerate(bins):
        within, name = [*groups, *names], f"_bin{i}"
        rows = rows.withColumn(name, each)
        per_bin = rows.groupBy(*within, name).agg(F.count(F.lit(1)).alias("_c"), F.first(quota).alias("_k"))
        up_to = Window.partitionBy(*within).orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
        kept = per_bin.withColumn("_rest", F.col("_k") - F.sum("_c").over(up_to) + F.col("_c")).where(F.col("_rest") > 0)
        kept = kept.select(*within, name, "_rest", (F.col("_c") <= F.col("_rest")).alias("_all"))
        rows = rows.drop("_rest").join(lookup_side(materialize(kept)), [*within, name])
        taken.append(rows.where("_all").select(*df.columns))
        rows = rows.where("not _all").drop("_all")
        names.append(name)
        quota = F.col("_rest")
    rank = F.row_number().over(Window.partitionBy(*groups, *names).orderBy(*order))
    out = rows.withColumn("_rank", rank).where(F.col("_rank") <= F.col("_rest")).select(*df.columns)
    for whole in taken:
        out = out.unionAll(whole)
    return out


def rank_bits(n: int) -> int:
    """Bits of the hash that leave some 65,536 of ``n`` rows to a bin at most, 12 at least."""
    return max(12, (n >> 16).bit_length())


def with_random_rank(df: DataFrame, key: list[str], seed: int, rank: str = "rank", limit: int | None = None) -> DataFrame:
    """A dense 0-based rank in an order that the hash of ``key`` makes random.

    ``key`` must identify a row. Equal runs give equal ranks, on any cluster.
    With ``limit`` only the rows ranked below it are kept.
    """
    bits = rank_bits(df.count())
    rows = df.withColumn("_h", row_hash(key, seed)).withColumn("_bin", hash_bin(F.col("_h"), bits))
    per_bin = rows.groupBy("_bin").agg(F.count(F.lit(1)).alias("_c"))
    up_to = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    starts = per_bin.withColumn("_start", F.sum("_c").over(up_to) - F.col("_c")).drop("_c")
    if limit is not None:
        starts = starts.where(F.col("_start") < limit)
    starts = lookup_side(materialize(starts))
    within = Window.partitionBy("_bin").orderBy("_h", *key)
    out = rows.join(starts, "_bin").withColumn(rank, F.col("_start") + F.row_number().over(within) - 1)
    if limit is not None:
        out = out.where(F.col(rank) < limit)
    return out.drop("_h", "_bin", "_start")


def side_by_side(*one_row: DataFrame) -> DataFrame:
    """Several one-row results as one row."""
    stacked = one_row[0]
    for other in one_row[1:]:
        stacked = stacked.unionByName(other, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def bin_by(value: Column, cuts: list[float]) -> Column:
    """How many of the rising ``cuts`` are <= value, as nested comparisons."""

    def between(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < cuts[mid], between(lo, mid)).otherwise(between(mid + 1, hi))

    if any(math.isnan(c) for c in cuts) or list(cuts) != sorted(cuts):
        raise ValueError("cuts must rise")
    return between(0, len(cuts))
