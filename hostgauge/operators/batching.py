"""What a collector sends at a time: so many events, or what came within some seconds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from hostgauge.operators.ordered import running_total
from hostgauge.session import materialize

BATCH_EVENTS = 100
BATCH_SECONDS = 5.0


def with_flushes(
    events: DataFrame, size: int = BATCH_EVENTS, seconds: float = BATCH_SECONDS, started_us: Column | None = None,
    store: Callable[[DataFrame], DataFrame] = materialize,
) -> DataFrame:
    """``batch`` of each event and whether it ``flushed``: "count", "time" or null.

    A host's events go out with every ``size``-th event, and with an event that comes
    ``seconds`` or more after the last time something went out; the first wait begins
    at ``started_us`` (default: the host's first event). Where both hold it is by count. ``batch`` rises with
    time and has gaps. Order: ts_us, seq; rows without time come first.

    As something always goes out at the ``size``-th event, the events from one such
    event to the next can be looked at alone, however many a host has: a group is
    ``size`` rows. Give it stored events.
    """
    at = F.coalesce("ts_us", F.lit(-(1 << 62)))
    rows = events.select("hostName", "seq", at.alias("_at"), F.lit(1).alias("_one"))
    order = [F.col("_at"), F.col("seq")]
    bins = [F.floor(F.col("_at") / us) for us in (3_600_000_000, 1_000_000)]
    placed = running_total(rows, "_one", order, bins, ["hostName"], "_place", store)
    placed = placed.withColumn("_chunk", F.floor(F.col("_place") / size))
    chunks = store(
        placed.groupBy("hostName", "_chunk").agg(F.array_sort(F.collect_list(F.struct("_at", "seq"))).alias("_rows"))
    )
    last = chunks.select("hostName", (F.col("_chunk") + 1).alias("_chunk"), F.element_at("_rows", -1)["_at"].alias("_before"))
    begun = F.col("_rows")[0]["_at"] if started_us is None else started_us
    since = F.coalesce("_before", begun)
    wait = int(seconds * 1_000_000)

    def step(acc: Column, row: Column) -> Column:
        due = F.when(acc["n"] + 1 == size, "count").when(row["_at"] - acc["last"] >= wait, "time")
        out = F.struct(acc["batch"].alias("batch"), due.alias("flushed"))
        return F.struct(
            F.when(due.isNotNull(), row["_at"]).otherwise(acc["last"]).alias("last"), (acc["n"] + 1).alias("n"),
            (acc["batch"] + due.isNotNull().cast("int")).alias("batch"), F.concat(acc["out"], F.array(out)).alias("out"),
        )

    start = F.struct(
        since.alias("last"), F.lit(0).alias("n"), F.lit(0).alias("batch"),
        F.array().cast("array<struct<batch:int,flushed:string>>").alias("out"),
    )
    found = chunks.join(last, ["hostName", "_chunk"], "left").withColumn("_out", F.aggregate("_rows", start, step)["out"])
    each = found.select("hostName", "_chunk", F.inline(F.arrays_zip("_rows", "_out")))
    number = (F.col("_chunk") * (size + 1) + F.col("_out.batch")).cast("bigint")
    return each.select("hostName", F.col("_rows.seq").alias("seq"), number.alias("batch"), F.col("_out.flushed").alias("flushed"))
