"""SimHash fingerprints and near-duplicate classes found through chains of segments on a ring.

The 64 bits are cut into five segments placed on a ring. If two fingerprints
differ in at most four bits, then some start segment exists from which every
chain of l segments differs in at most 4 l / 5 bits: the first segment not at
all, the first two in at most one bit, three in two, four in three. The first two
steps make the join key (so a key has about 26 bits and a bucket stays small at
billions of fingerprints); the longer chains prune inside a bucket, before the
whole fingerprints are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from hostgauge.llm.common import map_texts, words
from hostgauge.llm.components import connected_components
from hostgauge.session import lookup_side, materialize

SHINGLE = 4
SEED = 42
DISTANCE = 4
WIDTHS = [13, 13, 13, 13, 12]  # one more segment than differing bits
BLOCK = 1024  # fingerprints of a bucket that one task compares with as many others
_VOTES = 1 << 15  # shingles whose bits are spread out at a time


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit fingerprint; bit set where over half the shingles' hashes have it; no words: 0."""
    found = words(text)
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    n = max(1, len(found) - shingle + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[len(found) - n :].tolist()
    votes = np.zeros(64, np.int64)
    for at in range(0, n, _VOTES):
        spans = zip(starts[at : at + _VOTES], stops[at : at + _VOTES])
        hashes = np.array([xxhash.xxh64_intdigest(joined[i:j], seed) for i, j in spans], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and ``fp`` (bigint) per row; null text counts as empty."""
    return map_texts(docs, keep or ["doc_id"], [text], "fp bigint", lambda t: (simhash(t),))


def _ring() -> list[tuple[int, int, int, list[int]]]:
    """Per start: offset and width of its second segment, offset of its first, masks of chains of 1..m."""
    m = len(WIDTHS)
    offsets = [sum(WIDTHS[:i]) for i in range(m)]
    segment = [((1 << w) - 1) << o for w, o in zip(WIDTHS, offsets)]
    out = []
    for i in range(m):
        masks, mask = [], 0
        for step in range(m):
            mask |= segment[(i + step) % m]
            masks.append(mask)
        out.append((offsets[i], offsets[(i + 1) % m], WIDTHS[(i + 1) % m], masks))
    return out


def ring_keys(fp: Column) -> Column:
    """Array of bucket keys such that any two fingerprints with a viable chain share one.

    Key: start, its segment, and the next segment as it is; where that has an odd
    number of ones, also each value one bit away. Of two segments that differ in
    one bit exactly one is odd, so the two meet at the even one's value.
    """
    m = len(WIDTHS)
    arrays = []
    for i, (o1, o2, w2, _) in enumerate(_ring()):
        first = F.shiftrightunsigned(fp, o1).bitwiseAND(F.lit((1 << WIDTHS[i]) - 1))
        second = F.shiftrightunsigned(fp, o2).bitwiseAND(F.lit((1 << w2) - 1))
        base = F.lit(i).cast("bigint") * F.lit(1 << 32) + first * F.lit(1 << 16) + second
        near = [base, *[base.bitwiseXOR(F.lit(1 << t).cast("bigint")) for t in range(w2)]]
        arrays.append(F.when(F.bit_count(second) % 2 == 1, F.array(*near)).otherwise(F.array(base)))
    assert m == DISTANCE + 1
    return F.concat(*arrays)


def _viable(x: np.ndarray, start: int) -> np.ndarray:
    """Which differences ``x`` (XOR of two fingerprints) keep every chain from ``start`` in budget."""
    m = len(WIDTHS)
    ok = np.ones(x.shape, bool)
    for step, mask in enumerate(_ring()[start][3], 1):  # the last chain is the whole ring: the full distance
        at = np.flatnonzero(ok)
        ok.flat[at] = np.bitwise_count(x.flat[at] & np.uint64(mask)) <= step * DISTANCE // m
    return ok


def _forest(fps: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint of a bucket with the smallest one it hangs together with, where that is another."""
    k = len(fps)
    linked = np.zeros((k, k), bool)
    for at in range(0, k, 256):
        linked[at : at + 256] = _viable(fps[at : at + 256, None] ^ fps[None, :], start)
    label = np.arange(k)
    while True:
        new = np.where(linked, label[None, :], k).min(1)
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(k))
    return fps[at], fps[label[at]]


def _link_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, fp) sorted by key and part: links inside each run of equal (key, part)."""
    carry = None
    names = ["a", "b"]

    def links(key: np.ndarray, part: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
        starts = np.concatenate(([0], new))
        sizes = np.diff(np.concatenate((starts, [len(key)])))
        a, b = [], []
        two = starts[sizes == 2]
        for s in range(len(WIDTHS)):
            at = two[(key[two] >> 32) == s]
            at = at[_viable(fp[at] ^ fp[at + 1], s)]
            a.append(fp[at])
            b.append(fp[at + 1])
        for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            x, y = _forest(fp[at : at + n], int(key[at] >> 32))
            a.append(x)
            b.append(y)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], names=names)

    for batch in batches:
        key, part, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        fp = fp.view(np.uint64)
        if carry is not None:
            key, part, fp = (np.concatenate(v) for v in zip(carry, (key, part, fp)))
        if not len(key):
            continue
        same = (key == key[-1]) & (part == part[-1])
        last = len(key) - int(same[::-1].argmin()) if not same.all() else 0  # the run at the end may go on
        carry = (key[last:], part[last:], fp[last:])
        if last:
            yield links(key[:last], part[:last], fp[:last])
    if carry is not None:
        yield links(*carry)


def near_links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links ``a``, ``b`` that join up all distinct fingerprints (``fp``) within DISTANCE bits.

    Not every pair is returned: inside a bucket only as many links as keep the
    linked ones together (fewer than rows). A bucket of over ``block`` rows is cut
    into blocks, and each pair of blocks is a part of its own, so that no task gets
    an unbounded bucket; every pair of rows still meets.
    """
    keys = distinct.select("fp", F.explode(ring_keys(F.col("fp"))).alias("key"))
    crowded = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    crowded = lookup_side(materialize(crowded.select("key", F.ceil(F.col("n") / block).alias("blocks"))))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = (
        keys.join(crowded, "key", "left")
        .select("key", "fp", "blocks", other.alias("other"))
        .select(
            "key",
            F.when(F.col("blocks").isNull(), F.lit(0).cast("bigint"))
            .otherwise(F.least(own, "other") * F.col("blocks") + F.greatest(own, "other"))
            .alias("part"),
            "fp",
        )
    )
    runs = dealt.repartition("key", "part").sortWithinPartitions("key", "part")
    return runs.mapInArrow(_link_runs, "a bigint, b bigint")


def near_classes(
    docs: DataFrame, text: str = "text", keep: list[str] | None = None, doc_id: str = "doc_id", class_col: str | None = None
) -> DataFrame:
    """One row per input row: ``keep`` columns, ``fingerprint`` (16 hex digits), ``component_id``, and on request
    ``class_col``, a number of the class that ids which repeat or lack do not blur.

    component_id is the smallest ``doc_id`` reachable over links of at most four
    differing bits (null only if every id of the class is null). Null and wordless
    texts have fingerprint zero and are linked like any other. Repeated rows stay.
    Equal fingerprints are one node, so copies cost nothing in the search. No rows
    in, no rows out; columns other than ``keep`` and ``text`` are not read.
    """
    keep = keep or [doc_id]
    found = materialize(fingerprints(docs, text, keep))
    classes = materialize(found.groupBy("fp").agg(F.min(doc_id).alias("first")))
    roots = connected_components(near_links(classes.select("fp")))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    smallest = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id")))  # a large class's rows can be split
    more = [F.col("root").alias(class_col)] if class_col else []
    named = rooted.join(smallest, "root").select("fp", "component_id", *more)
    out = found.join(named, "fp")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return out.select(*keep, shown, "component_id", *([class_col] if class_col else []))
