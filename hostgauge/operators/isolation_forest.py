"""Isolation Forest: trees grown in parallel groups, rows scored in Arrow batches.

Tree growth follows the published algorithm (Liu, Ting, Zhou 2008): at most
ceil(log2(psi)) levels, a random feature that is not constant, a uniform split
point, and c(n) added at a leaf that still holds n rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hostgauge.fixed_values import CONTAMINATION, FEATURES, N_TREES, SEED
from hostgauge.operators.ordered import exact_quantiles, with_random_rank
from hostgauge.session import materialize

NODE_SCHEMA = "tree_id int, node_id int, feature int, threshold double, path_len double"
AUTO_SAMPLES = 256
EULER_GAMMA = 0.5772156649
_NODE_BYTES, MAX_FOREST_BYTES = 12, 1 << 30
_ROWS = 2048  # go down a tree together, so that their values stay in cache
_BATCH = 65_536  # rows that are judged node by node: calls cost little, and a byte a row and level stays in cache
_TREES = 256  # ... by so many trees that a feature's cuts are numbered in 16 bits
_LEAVES = 256  # ... whose leaves are numbered in 8
_FEW = 48  # values of a feature in a batch for which its comparisons are kept for all trees


def average_path(n: float) -> float:
    """c(n), the mean path length of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER_GAMMA) - 2.0 * (n - 1) / n


def subsample_size(n: int, max_samples: int | float | str = "auto") -> int:
    if max_samples == "auto":
        return min(AUTO_SAMPLES, n)
    if isinstance(max_samples, str):
        max_samples = float(max_samples) if "." in max_samples else int(max_samples)
    if isinstance(max_samples, float):
        return max(1, int(max_samples * n))
    return min(max_samples, n)


def grow_tree(x: np.ndarray, rng: np.random.Generator, levels: int) -> list[tuple]:
    """Nodes of one tree; node i has the children 2i+1 (below) and 2i+2."""
    nodes = []
    todo = [(0, 0, x)]
    while todo:
        node, depth, rows = todo.pop()
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) > 1 and depth < levels else (None, None)
        splittable = np.flatnonzero(high > low) if low is not None else ()
        if len(splittable) == 0:
            nodes.append((node, -1, 0.0, depth + average_path(len(rows))))
            continue
        f = int(rng.choice(splittable))
        # a cut in (low, high], so that neither side is empty
        cut = high[f] - rng.random() * (high[f] - low[f])
        cut = high[f] if cut <= low[f] else cut
        below = rows[:, f] < cut
        nodes.append((node, f, float(cut), 0.0))
        todo += [(2 * node + 1, depth + 1, rows[below]), (2 * node + 2, depth + 1, rows[~below])]
    return nodes


def assign_subsamples(ranked: DataFrame, n: int, psi: int, n_trees: int, seed: int) -> DataFrame:
    """(tree_id, rank, features...) with min(psi, n) distinct rows for every tree.

    ``ranked`` holds ranks 0..n-1 in random order. Each tree draws its ranks without
    replacement from a generator of its own; a join brings the rows.
    """
    size = min(psi, n)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for trees in batches:
            for tree_id in trees["id"]:
                ranks = np.random.default_rng([seed, int(tree_id), 1]).choice(n, size, replace=False, shuffle=False)
                yield pd.DataFrame({"tree_id": np.int32(tree_id), "rank": ranks.astype("int64")})

    return ranked.sparkSession.range(n_trees).mapInPandas(draw, "tree_id int, rank bigint").join(ranked, "rank")


def fit_trees(ranked: DataFrame, n: int, n_trees: int, max_samples, seed: int, features: list[str]) -> DataFrame:
    psi = subsample_size(n, max_samples)
    levels = max(1, math.ceil(math.log2(max(psi, 2))))
    if n_trees * 2 ** (levels + 1) * _NODE_BYTES > MAX_FOREST_BYTES:
        raise ValueError(f"{n_trees} trees of {psi} rows would not fit the {MAX_FOREST_BYTES} bytes that are sent to executors")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree_id = int(pdf["tree_id"].iloc[0])
        x = pdf.sort_values("rank")[features].to_numpy(dtype=np.float64)
        nodes = grow_tree(x, np.random.default_rng([seed, tree_id]), levels)
        out = pd.DataFrame(nodes, columns=["node_id", "feature", "threshold", "path_len"])
        out.insert(0, "tree_id", tree_id)
        return out

    rows = assign_subsamples(ranked.select("rank", *features), n, psi, n_trees, seed)
    # one group is one subsample: psi rows
    return rows.groupBy("tree_id").applyInPandas(grow, NODE_SCHEMA)


@dataclass
class Forest:
    """Trees as arrays over full heaps; its size depends on the parameters only."""

    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray
    path_len: np.ndarray  # (trees, 2 ** levels)
    psi: int
    offset: float = 0.0

    @classmethod
    def from_nodes(cls, nodes: pd.DataFrame, psi: int, offset: float = 0.0) -> Forest:
        levels = max(1, int(nodes["node_id"].max() + 1).bit_length() - 1)
        inner = 2**levels - 1
        trees = {t: i for i, t in enumerate(sorted(nodes["tree_id"].unique()))}
        feature = np.zeros((len(trees), inner), dtype=np.int64)
        threshold = np.full((len(trees), inner), np.inf)
        path = np.zeros((len(trees), 2 * inner + 1))
        row = nodes["tree_id"].map(trees).to_numpy()
        node = nodes["node_id"].to_numpy()
        f = nodes["feature"].to_numpy()
        split = f >= 0
        feature[row[split], node[split]] = f[split]
        threshold[row[split], node[split]] = nodes["threshold"].to_numpy()[split]
        path[row[~split], node[~split]] = nodes["path_len"].to_numpy()[~split]
        # a leaf above the last level hands its path length down
        for i in range(inner):
            leaf = path[:, i] > 0
            path[leaf, 2 * i + 1] = path[leaf, 2 * i + 2] = path[leaf, i]
        return cls(feature, threshold, path[:, inner:], psi, offset)

    @property
    def nbytes(self) -> int:
        return self.feature.nbytes + self.threshold.nbytes + self.path_len.nbytes

    def raw_scores(self, x: np.ndarray) -> np.ndarray:
        return raw_scores(x, self.feature, self.threshold, self.path_len, self.psi)


def raw_scores(x: np.ndarray, features: np.ndarray, thresholds: np.ndarray, paths: np.ndarray, psi: int) -> np.ndarray:
    """-2 ** (-E[h] / c(psi)) for each row of ``x``: all rows go down one tree at a time."""
    levels = paths.shape[1].bit_length() - 1
    total = np.zeros(len(x))
    for at in range(0, len(x), _ROWS):
        part = np.ascontiguousarray(x[at : at + _ROWS])
        n, width = part.shape
        flat, base = part.ravel(), np.arange(n) * width
        for feature, threshold, path in zip(features, thresholds, paths):
            node = np.zeros(n, dtype=np.int64)
            for _ in range(levels):
                value = flat.take(base + feature.take(node))
                node += node + 1 + ~(value < threshold.take(node))
            total[at : at + n] += path.take(node - (2**levels - 1))
    return -np.exp2(-(total / len(features)) / max(average_path(psi), 1e-12))


def pruned(features: np.ndarray, thresholds: np.ndarray, paths: np.ndarray) -> list[tuple[dict, list[tuple]]]:
    """Blocks of trees without the nodes whose leaves all have one path length: (cuts, trees).

    ``cuts`` are the sorted thresholds per feature. A tree is its root and the path lengths
    of its leaves from left to right; a node is (feature, number of its threshold, leaves on
    its left, left, right), a leaf None.
    """
    trees, inner = features.shape
    least = np.concatenate([np.zeros((trees, inner)), paths], axis=1)
    most = least.copy()
    for i in range(inner - 1, -1, -1):
        least[:, i] = np.minimum(least[:, 2 * i + 1], least[:, 2 * i + 2])
        most[:, i] = np.maximum(most[:, 2 * i + 1], most[:, 2 * i + 2])
    splits = (least != most)[:, :inner]
    blocks = []
    for at in range(0, trees, _TREES):
        part = slice(at, at + _TREES)
        cuts, number = {}, np.zeros(features[part].shape, dtype=np.int64)
        for c in np.unique(features[part][splits[part]]).tolist():
            here = splits[part] & (features[part] == c)
            cuts[c], number[here] = np.unique(thresholds[part][here], return_inverse=True)
        blocks.append((cuts, [_tree(*t) for t in zip(features[part], number, splits[part], least[part])]))
    return blocks


def _tree(feature: np.ndarray, number: np.ndarray, split: np.ndarray, path: np.ndarray) -> tuple:
    feature, number, split, path, leaves = feature.tolist(), number.tolist(), split.tolist(), path.tolist(), []

    def node(i: int) -> tuple | None:
        if i >= len(split) or not split[i]:
            leaves.append(path[i])
            return None
        first = len(leaves)
        left = node(2 * i + 1)
        return feature[i], number[i], len(leaves) - first, left, node(2 * i + 2)

    return node(0), np.array(leaves)


class _Above:
    """For each row and cut of a feature: 1 where the value is not below the cut, as ``value < cut`` says it."""

    def __init__(self, values: np.ndarray, cuts: np.ndarray):
        self.rank = np.searchsorted(cuts, values, side="right").astype(np.uint16)  # cuts that are not above; NaN: all
        found = np.flatnonzero(np.bincount(self.rank, minlength=len(cuts) + 1))
        self.few = len(found) <= _FEW
        if self.few:  # one comparison for all cuts between two values that follow each other
            self.which = np.searchsorted(found, np.arange(len(cuts)), side="right").tolist()
            self.bits = [np.ones(1, np.uint8), *[(self.rank > v).view(np.uint8) for v in found[:-1]]]

    def at(self, cut: int, scratch: np.ndarray) -> np.ndarray:
        """The column, or one value where all rows are alike."""
        if self.few:
            which = self.which[cut]
            return self.bits[which] if which < len(self.bits) else _NOWHERE
        np.greater(self.rank, cut, out=scratch.view(bool))
        return scratch


_NOWHERE = np.zeros(1, np.uint8)


def judged(x: np.ndarray, blocks: list[tuple[dict, list[tuple]]], psi: int) -> np.ndarray:
    """What ``raw_scores`` gives, of ``pruned`` trees: whole columns are compared node by node, from the leaves up.

    A node's column holds the number of the leaf that a row comes to, from its leftmost leaf: below the cut
    the left one, else the right one after the leaves on the left. The latter is the greater one.
    """
    total, trees = np.zeros(len(x)), sum(len(t) for _, t in blocks)
    for at in range(0, len(x), _BATCH):
        columns = np.ascontiguousarray(x[at : at + _BATCH].T)
        n = columns.shape[1]
        levels = [np.empty(n, np.uint8) for _ in range(_LEAVES.bit_length() + 1)]
        bit, path = np.empty(n, np.uint8), np.empty(n)
        for cuts, roots in blocks:
            above = {c: _Above(columns[c], known) for c, known in cuts.items()}

            def leaf(node: tuple | None, level: int) -> np.ndarray:
                if node is None:
                    return _NOWHERE
                feature, cut, on_left, left, right = node
                out = levels[level]
                far = leaf(right, level)
                right_of = above[feature].at(cut, bit)
                if len(right_of) == 1:  # all rows go one way
                    if not right_of[0]:
                        return leaf(left, level)
                    return np.add(far, on_left, out=out) if len(far) > 1 else far + np.uint8(on_left)
                if len(far) == 1:
                    number = int(far[0]) + on_left
                    if number > 1:
                        found = np.multiply(right_of, number, out=out)
                    elif right_of is bit:
                        np.copyto(out, bit)
                        found = out
                    else:
                        found = right_of
                else:
                    found = np.multiply(np.add(far, on_left, out=out), right_of, out=out)
                near = leaf(left, level + 1)
                if len(near) == 1 and not near[0]:
                    return found
                return np.maximum(found, near if len(near) > 1 else np.full(n, near[0]), out=out)

            for root, lengths in roots:
                found = leaf(root, 0)
                total[at : at + n] += lengths[found[0]] if len(found) == 1 else np.take(lengths, found, out=path, mode="clip")
    return -np.exp2(-(total / trees) / max(average_path(psi), 1e-12))


def normality_score(spark: SparkSession, forest: Forest, features: list[str] = FEATURES) -> Column:
    """Score column, higher is more normal. Ships the trees once per executor."""
    # plain arrays, as executors may not have this package
    if forest.path_len.shape[1] <= _LEAVES:
        score_rows, trees = judged, (pruned(forest.feature, forest.threshold, forest.path_len), forest.psi)
    else:  # work per node would grow with the leaves, work per level does not
        score_rows, trees = raw_scores, (forest.feature, forest.threshold, forest.path_len, forest.psi)
    shared = spark.sparkContext.broadcast(trees)
    offset = forest.offset

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        trees, held, n = shared.value, [], 0
        for columns in batches:
            held.append(np.column_stack([c.to_numpy(dtype=np.float64) for c in columns]))
            n += len(held[-1])
            if n >= _BATCH:
                yield pd.Series(score_rows(np.concatenate(held), *trees) - offset)
                held, n = [], 0
        if held:
            yield pd.Series(score_rows(np.concatenate(held), *trees) - offset)

    return score(*[F.col(f) for f in features])


@dataclass
class FitResult:
    nodes: DataFrame
    forest: Forest
    sample_size: int


def fit(
    scaled_benign: DataFrame,
    key: list[str],
    n_trees: int = N_TREES,
    contamination: float = CONTAMINATION,
    max_samples: int | float | str = "auto",
    train_sample: int | None = None,
    seed: int = SEED,
    features: list[str] = FEATURES,
) -> FitResult:
    """Fits on all rows, or on a uniform sample of ``train_sample`` of them; ``key`` identifies a row.

    Every tree draws its own rows from them. The offset is the ``contamination`` quantile
    of the raw scores of all of them. It shifts the score and does not decide any alert.
    """
    spark = scaled_benign.sparkSession
    ranked = materialize(
        with_random_rank(scaled_benign.select(*key, *features), key, seed, limit=train_sample).drop(*key)
    )
    n = ranked.count()
    if n == 0:
        raise ValueError("no benign rows to train on")
    nodes = materialize(fit_trees(ranked, n, n_trees, max_samples, seed, features))
    # at most trees x (2 psi - 1) nodes, whatever the data
    forest = Forest.from_nodes(nodes.toPandas(), subsample_size(n, max_samples))
    raw = materialize(ranked.select(normality_score(spark, forest, features).alias("raw")))  # read twice
    forest.offset = contamination_offset(raw, contamination)
    return FitResult(nodes, forest, n)


def contamination_offset(raw: DataFrame, contamination: float = CONTAMINATION, column: str = "raw") -> float:
    return float(exact_quantiles(raw, column, {"offset": contamination}).first()["offset"])
