"""Threshold-scaled sketches (FracMinHash) of texts, and their likeness.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so it
grows with the text, two sketches can be merged into that of both texts, and the
share of a short text's shingles that lie in a very long one can be estimated. A
text so short that none of its hashes is below keeps its smallest one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hostgauge.llm.common import map_texts, window_hashes

SHINGLE = 16  # code points
FRACTION = 16  # one hash in 16 is kept
_LIMIT = np.uint32(2**32 // FRACTION)


def sketch(text: str) -> np.ndarray:
    """Sorted distinct 32-bit hashes."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return _keep(np.unique((window_hashes(points, SHINGLE) >> np.uint64(32)).astype(np.uint32)))


def _keep(hashes: np.ndarray) -> np.ndarray:
    below = hashes[: np.searchsorted(hashes, _LIMIT)]
    return below if len(below) else hashes[:1]


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of two texts' shingles together, from their sketches."""
    return _keep(np.union1d(a, b))


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of all shingles of both (Jaccard)."""
    union = merge(a, b)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(both, union).sum() / len(union)) if len(union) else 1.0


def containment(a: np.ndarray, b: np.ndarray) -> float | None:
    """Part of ``a``'s shingles that are in ``b``; None if ``a`` only has the hash that stands in for none below.

    A longer text's sketch never holds that one, so it says nothing of the text.
    """
    if len(a) and a[0] >= _LIMIT:
        return None
    return float(np.isin(a, b).sum() / len(a)) if len(a) else 1.0


def dump(hashes: np.ndarray) -> str:
    return base64.b64encode(hashes.astype("<u4").tobytes()).decode()


def load(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def sketches(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and ``fingerprint`` per row; null text counts as empty (the sketch of no shingle)."""
    return map_texts(docs, keep or ["doc_id"], [text], "fingerprint string", lambda t: (dump(sketch(t or "")),))


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_KINDS = ["bigint", "bigint", "string", "string", "string", "double", "double"]


def edited_likeness(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """Per row: its sketch, that of its edited text, and the likeness to the edited and to the next text.

    The edited text has the last quarter (rounded down) of the code points replaced
    by as many from the start of the next row's text (all if that is shorter). Rows
    go by id, null first, rows of one id by text (null as empty); after the last
    comes the first, so a single row is its own next. No rows in, no rows out.

    Rows are cut into ranges of ids by quantiles; a range's last row needs the first
    row of the next one, so that row is sent to both. A task sorts and walks through
    one range at a time.
    """
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    cuts = np.unique(ids.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.2 / buckets) if buckets > 1 else [])

    @F.pandas_udf("int")
    def bucket_of(values: pd.Series) -> pd.Series:
        found = np.searchsorted(cuts, values.to_numpy(dtype="float64", na_value=-np.inf), side="right")
        return pd.Series(found.astype("int32"))

    # one row per range: its first id, and the range before it (before the first: the last)
    firsts = sorted(
        (r["bucket"], r["first"])
        for r in ids.withColumn("bucket", bucket_of("doc_id"))
        .groupBy("bucket")
        .agg(F.coalesce(F.min("doc_id"), F.lit(None)).alias("first"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
        .select("bucket", F.when(F.col("nulls") == 0, F.col("first")).alias("first"))
        .collect()
    ) if not ids.isEmpty() else []
    order = [b for b, _ in firsts]
    halo = spark.createDataFrame(
        [(first, order[i - 1]) for i, (_, first) in enumerate(firsts)], "first bigint, bucket int"
    )
    again = rows.join(F.broadcast(halo), F.col("doc_id").eqNullSafe(F.col("first"))).select(
        "doc_id", "text", "bucket", F.lit(1).alias("halo")
    )
    placed = rows.select("doc_id", "text", bucket_of("doc_id").alias("bucket"), F.lit(0).alias("halo")).unionAll(again)
    walked = placed.repartition("bucket").sortWithinPartitions("bucket", "halo", "doc_id", "text")
    return walked.mapInArrow(_walk, ", ".join(map(" ".join, zip(_NAMES, _KINDS))))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, bucket, halo) in order: each own row with the row that follows in its bucket."""
    held = None  # own row that waits for its next one: doc_id, text, bucket, sketch
    types = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]

    def row(doc_id, text, own, following, its):
        n = len(text)
        edited = text[: n - n // 4] + following[: n // 4]
        changed = sketch(edited)
        return (
            doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), dump(own), dump(changed),
            resemblance(own, changed), resemblance(own, its),
        )

    def out(done):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=_NAMES)

    done = []
    for batch in batches:
        for r in range(batch.num_rows):
            doc_id, text, bucket, halo = (batch.column(i)[r].as_py() for i in range(4))
            if held is None and halo:
                continue  # further rows of the same first id
            own = sketch(text)
            if held is not None:
                done.append(row(held[0], held[1], held[3], text, own))
            held = None if halo else (doc_id, text, bucket, own)
            if len(done) >= 500:
                yield out(done)
                done = []
    if done:
        yield out(done)
