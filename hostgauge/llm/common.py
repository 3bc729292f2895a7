"""What several operators share: words, rolling hashes, Arrow rows, stored tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

SLICE = 256  # rows turned into Python objects at a time
SPACE = r"[\x20\x09-\x0D]+"  # what separates words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """Runs of bytes other than space and 0x09-0x0D, with A-Z in lower case."""
    return (text or "").encode().lower().split()


def crc_mod(column: str, by: int) -> Column:
    """crc32 of a column as text, modulo ``by``; null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % by


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, all else as it is; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def map_texts(
    df: DataFrame, keep: list[str], texts: list[str], added: str, fn: Callable[..., tuple], setup: Callable | None = None
) -> DataFrame:
    """``keep`` columns next to what ``fn(*texts)`` gives for each row.

    ``added`` is the DDL of the new columns, in the order of ``fn``'s tuple.
    ``setup()``, if given, runs once per task and its result is ``fn``'s first argument.
    """
    source = df.select(*keep, *texts)
    new = T.StructType.fromDDL(added)
    schema = T.StructType([*df.select(*keep).schema.fields, *new.fields])
    n_keep = len(keep)
    types = [_arrow_type(f.dataType) for f in new.fields]
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = (setup(),) if setup else ()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                args = [batch.column(n_keep + i).to_pylist() for i in range(len(texts))]
                rows = [fn(*first, *row) for row in zip(*args)]
                columns = [pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], *columns], names=names)

    return source.mapInArrow(run, schema)


def _arrow_type(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(_arrow_type(t.elementType))
    return {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(),
        "binary": pa.binary(), "boolean": pa.bool_(),
    }[t.simpleString()]


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def scramble(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit moves about half of the output bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` (a power of two) values; fewer values: one hash of them all."""
    h = scramble(values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    if len(values) < width:
        out = len(values)
        for v in h.tolist():
            out = (out * int(_M2) + v) % 2**64
        return scramble(np.array([out], dtype=np.uint64))
    factor, have = 0x9E3779B97F4A7C15, 1
    while have < width:
        h = h[:-have] * np.uint64(factor) + h[have:]
        factor, have = factor * factor % 2**64, have * 2
    return scramble(h)
