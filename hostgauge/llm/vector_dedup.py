"""Near-duplicate vectors through an inverted multi-index.

A unit vector is cut into two halves, each with a codebook of its own; the pair of
its nearest entries is its cell in the product grid, and every vector is stored in
exactly one cell. A query goes through the cells from the nearest on, by the sum of
the distances of its halves, which a walk over the two sorted lists of distances
gives without looking at the whole grid. It stops at a distance budget beyond its own
cell. The budget is the one at which, in a simulation on the sample, the wanted share
of neighbours at the threshold itself is found; closer neighbours are found more
surely. Two vectors meet if either visits the other's cell; the cosine of all that
meet is computed in double precision.

Equal vectors are one node, and links are counted where they are found, so no list of
pairs is ever made: a group of near copies costs comparisons, not rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from hostgauge.llm.components import connected_components
from hostgauge.session import lookup_side, materialize

THRESHOLD = 0.9
TARGET = 0.98  # share of the neighbours at the threshold that the visits are to find
SAMPLE = 16_384  # vectors that the codebooks and the budget are fitted on, by hash order
SEED = 13
PER_CELL = 64  # vectors a cell holds on average, as long as the codebooks are below their bound
MAX_CODES = 512
ROUNDS = 8
BLOCK = 1024  # vectors of a cell in one part
CHUNK = 8192  # visitors of a cell in one part


# -- vectors ---------------------------------------------------------------------------


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows in double precision, at length 1; scaled first, so that no square leaves the range."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All elements (null: NaN) and where each list ends."""
    lengths = np.asarray(column.value_lengths().fill_null(0))
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])


def _read(vectors: DataFrame, embedding: str, id_col: str) -> DataFrame:
    """vec_id, the vector as bytes, their hash and the number of components; null where the vector links with nothing."""
    kind = vectors.schema[embedding].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    values = F.col(embedding) if single else F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), values.alias("v"))
    dtype = np.dtype("<f4" if single else "<f8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = _lists(batch.column(1))
            flat = flat.astype(dtype) + dtype.type(0)  # no negative zeros
            raw = []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                v = flat[a:b]
                raw.append(v.tobytes() if b > a and np.isfinite(v).all() and v.any() else None)
            digest = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            dims = [None if r is None else len(r) // dtype.itemsize for r in raw]
            columns = [batch.column(0), pa.array(raw, pa.binary()), pa.array(digest, pa.binary()), pa.array(dims, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "raw", "digest", "dims"])

    return rows.mapInArrow(run, "vec_id bigint, raw binary, digest binary, dims int"), dtype


def _matrix(column: pa.Array, dims: int, dtype: np.dtype) -> np.ndarray:
    return unit(np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, dims))


# -- the index -------------------------------------------------------------------------


def _distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(axis=1)


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    codes = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        nearest = _distances(x, codes).argmin(axis=1)
        order = np.argsort(nearest, kind="stable")
        filled, starts = np.unique(nearest[order], return_index=True)
        codes[filled] = np.add.reduceat(x[order], starts, axis=0) / np.diff([*starts, len(x)])[:, None]
    return codes


class MultiIndex:
    """Two codebooks and the distance budget of a visit."""

    def __init__(self, first: np.ndarray, second: np.ndarray, budget: float):
        self.first, self.second, self.budget = first, second, budget
        self.half = first.shape[1]

    def excess(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per half and code, how much farther it is than the nearest one."""
        a, b = _distances(x[:, : self.half], self.first), _distances(x[:, self.half :], self.second)
        return a - a.min(axis=1, keepdims=True), b - b.min(axis=1, keepdims=True)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.excess(x)
        return a.argmin(axis=1) * len(self.second) + b.argmin(axis=1)

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Home cell and visited cells (home excluded, rising) of each row.

        Both lists of distances are sorted; going down the first, each entry leaves
        a smaller rest of the budget for a shorter run of the second.
        """
        a, b = self.excess(x)
        codes_a, codes_b = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
        a, b = np.take_along_axis(a, codes_a, 1), np.take_along_axis(b, codes_b, 1)
        home = codes_a[:, 0] * len(self.second) + codes_b[:, 0]
        out = []
        for i in range(len(x)):
            rest = self.budget - a[i, : np.searchsorted(a[i], self.budget, "right")]
            runs = np.searchsorted(b[i], rest, "right")
            found = np.repeat(codes_a[i, : len(runs)], runs) * len(self.second)
            found = found + np.concatenate([codes_b[i, :r] for r in runs.tolist()])
            out.append(np.sort(found[found != home[i]]))
        return home, out


def fit(sample: np.ndarray, n: int, threshold: float = THRESHOLD, target: float = TARGET, seed: int = SEED) -> MultiIndex:
    """Codebooks for ``n`` vectors, and the budget, from unit vectors in a random order.

    Of vectors that link with one another the first alone counts, so that a large
    group of near copies does not draw codes into itself.
    """
    rng = np.random.default_rng(seed)
    kept = np.ones(len(sample), bool)
    for at in range(0, len(sample), 512):
        near = sample[at : at + 512] @ sample[: at + 512].T >= threshold
        kept[at : at + 512] = ~np.tril(near, at - 1).any(axis=1)
    x = sample[kept]
    half = (x.shape[1] + 1) // 2
    k = min(max(1, round((n / PER_CELL) ** 0.5)), MAX_CODES, max(1, len(x) // 8))
    index = MultiIndex(_codebook(x[:, :half], k, rng), _codebook(x[:, half:], k, rng), 0.0)
    # neighbours at the threshold, in random directions
    q = x[rng.integers(len(x), size=4096)]
    off = rng.normal(size=q.shape)
    off -= (off * q).sum(axis=1, keepdims=True) * q
    length = np.sqrt((off * off).sum(axis=1, keepdims=True))
    y = threshold * q + (1 - threshold**2) ** 0.5 * off / np.where(length > 0, length, 1)
    needed = np.full(len(q), np.inf)
    for here, there in ((q, y), (y, q)):
        (a, b), cell, rows = index.excess(here), index.cells(there), np.arange(len(q))
        needed = np.minimum(needed, a[rows, cell // k] + b[rows, cell % k])
    index.budget = float(np.quantile(needed, target))
    return index


def _fitted(classes: DataFrame, dims: int, dtype: np.dtype, n: int, threshold: float, target: float) -> MultiIndex:
    """Fits in one task of an executor, from at most SAMPLE vectors."""
    sample = materialize(classes.orderBy("digest").limit(SAMPLE).select("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.concatenate([np.zeros((0, dims)), *[_matrix(b.column(0), dims, dtype) for b in batches if b.num_rows]])
        if len(x):
            index = fit(x, n, threshold, target)
            books = [index.first.astype("<f8").tobytes(), index.second.astype("<f8").tobytes()]
            columns = [pa.array([len(index.first)], pa.int32()), *[pa.array([c], pa.binary()) for c in books]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([index.budget])], names=["k", "first", "second", "budget"])

    found = sample.coalesce(1).mapInArrow(run, "k int, first binary, second binary, budget double").first()
    books = [np.frombuffer(bytes(found[c]), "<f8").reshape(found["k"], -1) for c in ("first", "second")]
    return MultiIndex(*books, found["budget"])


def _placed(classes: DataFrame, index, dims: int, dtype: np.dtype) -> DataFrame:
    """Nodes with their home cell and the cells that they visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multi = index.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                home, visits = multi.visits(_matrix(batch.column(2), dims, dtype))
                ends = np.concatenate([[0], np.cumsum([len(v) for v in visits])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(visits), pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(home, pa.int32()), lists], names=["node", "n", "raw", "home", "visits"]
                )

    return classes.select("node", "n", "raw").mapInArrow(run, "node bigint, n bigint, raw binary, home int, visits array<int>")


# -- meeting ---------------------------------------------------------------------------

# what a row is in its part
_WITHIN, _HELD, _OTHER, _VISITOR = range(4)


def _dealt(placed: DataFrame, block: int, chunk: int) -> DataFrame:
    """One row per vector and part (cell, part) in which it is compared.

    A cell of m vectors has ceil(m / block) blocks. Each pair of blocks is a part; so is
    each block with each chunk of the cell's visitors, but the first chunk joins the
    block's own part. So no part holds more than about two blocks and a chunk.
    """
    members = placed.groupBy(F.col("home").alias("cell")).agg(F.count(F.lit(1)).alias("m"))
    visitors = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("v"))
    sizes = members.join(visitors, "cell", "left").select(
        "cell",
        F.ceil(F.col("m") / block).cast("int").alias("blocks"),
        F.greatest(F.lit(1), F.ceil(F.coalesce("v", F.lit(0)) / chunk)).cast("int").alias("chunks"),
    )
    sizes = lookup_side(materialize(sizes))  # at most MAX_CODES squared rows
    blocks, chunks = F.col("blocks"), F.col("chunks")
    hashed = F.xxhash64("node")
    own, mine = F.pmod(hashed, blocks).cast("int"), F.pmod(F.shiftright(hashed, 20), chunks).cast("int")

    def entry(part: Column, role: Column) -> Column:
        return F.struct(part.cast("bigint").alias("part"), role.cast("int").alias("role"))

    def pair(t: Column) -> Column:
        role = F.when(t == own, _WITHIN).when(own < t, _HELD).otherwise(_OTHER)
        return entry(F.least(own, t) * blocks + F.greatest(own, t), role)

    def after_pairs(t: Column, k: Column) -> Column:
        return blocks * blocks + t * chunks + k

    each_block = F.sequence(F.lit(0), blocks - 1)
    later_chunks = F.when(chunks > 1, F.sequence(F.lit(1), chunks - 1)).otherwise(F.array().cast("array<int>"))
    of_members = F.concat(
        F.transform(each_block, pair), F.transform(later_chunks, lambda k: entry(after_pairs(own, k), F.lit(_HELD)))
    )
    of_visitors = F.transform(
        each_block, lambda t: entry(F.when(mine == 0, t * blocks + t).otherwise(after_pairs(t, mine)), F.lit(_VISITOR))
    )
    at_home = placed.withColumn("cell", F.col("home")).join(sizes, "cell").withColumn("at", F.explode(of_members))
    away = placed.withColumn("cell", F.explode("visits")).join(sizes, "cell").withColumn("at", F.explode(of_visitors))
    columns = ["cell", F.col("at.part").alias("part"), F.col("at.role").alias("role"), "node", "n", "raw", "home", "visits"]
    return at_home.select(*columns).unionAll(away.select(*columns))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each run of equal first two columns."""
    carry: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = (np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1])) + 1).tolist()
        if carry and (carry[-1].column(0)[0].as_py(), carry[-1].column(1)[0].as_py()) != (cell[0], part[0]):
            yield pa.Table.from_batches(carry)
            carry = []
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            carry.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(carry)
                carry = []
    if carry:
        yield pa.Table.from_batches(carry)


def _forest(linked: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """Label of each of ``size`` rows; rows 0.. meet the rows ``right`` where ``linked``. Linked rows have one label, the smallest."""
    label = np.arange(size)
    left = np.arange(len(linked))
    while True:
        before = label
        label = label.copy()
        label[left] = np.minimum(label[left], np.where(linked, label[right][None, :], size).min(axis=1, initial=size))
        np.minimum.at(label, right, np.where(linked, label[left][:, None], size).min(axis=0, initial=size))
        label = label[label]
        if (label == before).all():
            return label


def _compare(rows: pa.Table, dims: int, dtype: np.dtype, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Links of a part: nodes with the rows they link with, and edges that join the linked ones up."""
    role = rows.column("role").to_numpy()
    held = np.flatnonzero(role <= _HELD)
    other = np.flatnonzero(role > _HELD)
    within = len(held) > 0 and role[held[0]] == _WITHIN
    if not len(held) or (not within and not len(other)):
        return None
    x = _matrix(rows.column("raw").combine_chunks(), dims, dtype)
    right = np.concatenate([held, other]) if within else other
    linked = x[held] @ x[right].T >= threshold
    if within:
        linked[np.arange(len(held)), np.arange(len(held))] = False
    if not linked.any():
        return None
    counted = linked
    visitor = role[right] == _VISITOR
    if visitor.any():
        # where each visits the other's cell the two meet twice, and count in the smaller cell only
        cell, homes = rows.column("cell")[0].as_py(), rows.column("home").to_numpy()[right]
        earlier = np.unique(homes[visitor & (homes < cell) & linked.any(axis=0)])
        if len(earlier):
            flat, ends = _lists(rows.column("visits").combine_chunks())
            visited = np.zeros((len(held), len(earlier)), bool)
            for i, h in enumerate(held.tolist()):
                visited[i] = np.isin(earlier, flat[ends[h] : ends[h + 1]])
            which = np.searchsorted(earlier, homes).clip(max=len(earlier) - 1)
            counted = linked & ~(visited[:, which] & (earlier[which] == homes) & visitor)
    n = rows.column("n").to_numpy()
    links = np.zeros(len(role), np.int64)
    links[held] = counted @ n[right]
    # within a block both directions are in the matrix
    from_right = n[held] @ counted
    links[right] += np.where(role[right] == _WITHIN, 0, from_right)
    node = rows.column("node").to_numpy()
    order = np.concatenate([held, other])
    place = np.empty(len(role), np.int64)
    place[order] = np.arange(len(order))
    label = _forest(linked, place[right], len(order))
    hung = np.flatnonzero(label != np.arange(len(order)))
    some = links > 0
    return node[some], links[some], node[order[hung]], node[order[label[hung]]]


def _met(parts: DataFrame, dims: int, dtype: np.dtype, threshold: float) -> DataFrame:
    """(node, null, links) and (node, node, null) of all parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            found = _compare(rows, dims, dtype, threshold)
            if found is None:
                continue
            node, links, a, b = found
            first = np.concatenate([node, a])
            count = np.arange(len(first)) < len(node)
            second = pa.array(np.concatenate([np.zeros(len(node), np.int64), b]), mask=count)
            total = pa.array(np.concatenate([links, np.zeros(len(a), np.int64)]), mask=~count)
            yield pa.RecordBatch.from_arrays([pa.array(first), second, total], names=["a", "b", "links"])

    return parts.repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(run, "a bigint, b bigint, links bigint")


def near_vectors(
    vectors: DataFrame, embedding: str = "embedding", id_col: str = "vec_id", threshold: float = THRESHOLD,
    target: float = TARGET, block: int = BLOCK, chunk: int = CHUNK,
) -> DataFrame:
    """One row per input row: vec_id, n_links (other rows linked directly), component_id, kept.

    Rows link where the cosine of their vectors is ``threshold`` or more, whatever
    their ids: rows that repeat link with each other. component_id is the smallest
    id reachable over links. Vectors that are null, empty, zero or hold a null or a
    non-finite component link with nothing; nor do vectors of different lengths (each
    length takes a round of its own). A null id counts in n_links; its component is
    the smallest id of the others, null if there is none, and it is kept only in that
    case. No rows in, no rows out. Every row is indexed; the codebooks are fitted on
    ``SAMPLE`` distinct vectors of each length.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie in (0, 1]")
    read, dtype = _read(vectors, embedding, id_col)
    classes = read.where("digest is not null").groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"), F.first("raw").alias("raw"), F.first("dims").alias("dims")
    )
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()))  # stored with its numbers
    found = None
    for dims, n in classes.groupBy("dims").count().collect():  # one row per length of vectors
        mine = classes.where(F.col("dims") == dims)
        index = vectors.sparkSession.sparkContext.broadcast(_fitted(mine, dims, dtype, n, threshold, target))
        placed = materialize(_placed(mine, index, dims, dtype))
        met = materialize(_met(_dealt(placed, block, chunk), dims, dtype, threshold))
        found = met if found is None else found.unionAll(met)
    if found is None:
        alone = [F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")]
        return read.select("vec_id", *alone)
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("b is not null").select("a", "b"))
    rooted = classes.select("digest", "node", "n", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")))  # a large component can be split
    named = rooted.join(links, "node", "left").join(smallest, "root").select(
        "digest", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
    )
    named = lookup_side(materialize(named))
    out = read.select("vec_id", "digest").join(named, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
