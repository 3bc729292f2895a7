"""A small causal self-attention model over subword ids, in numpy.

One layer, one head, with a learnt bias per distance. A stream of ids is cut into
blocks of BLOCK; the queries of a block see their own block up to themselves and
the whole block before, so windows overlap by half and every id is scored once,
with BLOCK to 2 * BLOCK - 1 ids of context. The output is a softmax in two steps
(group, then id inside the group), so scoring looks at one group only. The first
groups hold the ids that begin a word, so the group step also says how likely a
word ends here. Ids too rare for a place of their own share one and are told apart
by their frequency.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK = 16
WIDTH, HIDDEN = 16, 32
GROUPS, PLACES = 32, 32
FIRST = 12  # groups of ids that begin a word (or end the text); the others hold what goes on a word
HALVES = ((0, FIRST * PLACES), (FIRST * PLACES, GROUPS * PLACES))  # the last place of each is that of its rare ids
PAD = GROUPS * PLACES  # nothing: before a document, after its end
_FAR, _MOST, _LEAST = np.float32(-1e9), np.float32(60), np.float32(1e-30)
_ONES = np.ones((2 * BLOCK, 1), np.float32)
_BATCH = 96  # windows
_ROWS = 1024  # targets


@dataclass
class Vocabulary:
    """Places of ids by falling frequency, and log10 of the share of an id among those of its place."""

    place: np.ndarray  # int32 by id
    share: np.ndarray  # float32 by id

    @staticmethod
    def of(counts: np.ndarray, begins: np.ndarray) -> "Vocabulary":
        place, share = np.empty(len(counts), np.int32), np.zeros(len(counts), np.float32)
        for (low, high), half in zip(HALVES, (begins, ~begins)):
            ids = np.flatnonzero(half)
            ids = ids[np.argsort(-counts[ids], kind="stable")]
            own, rare = ids[: high - low - 1], ids[high - low - 1 :]
            place[own] = low + np.arange(len(own))
            place[rare] = high - 1
            if len(rare):
                share[rare] = np.log10((counts[rare] + 0.1) / (counts[rare] + 0.1).sum())
        return Vocabulary(place, share)


def _windows(inputs: np.ndarray) -> np.ndarray:
    """(blocks, 2 * BLOCK) views of a padded stream whose first block is the first window's past."""
    step = inputs.strides[0]
    return np.lib.stride_tricks.as_strided(inputs, (len(inputs) // BLOCK - 1, 2 * BLOCK), (BLOCK * step, step), writeable=False)


def lay_out(runs: list[np.ndarray], starts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of places as one padded stream: windows of inputs, targets (blocks, BLOCK) and which are real.

    Each run stands after a block of padding; its first input is its start.
    Windows between runs score nothing and are left out.
    """
    sizes = [-(-len(d) // BLOCK) * BLOCK for d in runs]
    total = sum(sizes) + BLOCK * len(runs)
    inputs, targets = np.full(total, PAD, np.int32), np.full(total, PAD, np.int32)
    at = 0
    for d, start, size in zip(runs, starts, sizes):
        at += BLOCK
        n = len(d)
        inputs[at] = start
        inputs[at + 1 : at + n] = d[:-1]
        targets[at : at + n] = d
        at += size
    windows = _windows(inputs)
    wanted = targets[BLOCK:].reshape(-1, BLOCK)
    real = wanted != PAD
    used = real.any(1)
    return windows[used], wanted[used], real[used]


class Attention:
    """Parameters by name, all float32."""

    SHAPES = {
        "embed": (PAD + 1, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "distance": (2 * BLOCK,),
        "mixed": (WIDTH, HIDDEN), "own": (WIDTH, HIDDEN), "hidden": (HIDDEN,), "group": (HIDDEN, GROUPS),
        "group_bias": (GROUPS,), "inside": (GROUPS, HIDDEN, PLACES), "inside_bias": (GROUPS, PLACES),
    }

    _ENDS = np.cumsum([int(np.prod(s)) for s in SHAPES.values()]).tolist()
    _PARTS = [(name, slice(a, b), shape) for (name, shape), a, b in zip(SHAPES.items(), [0, *_ENDS], _ENDS)]

    def __init__(self, flat: np.ndarray | None = None, seed: int = 7):
        self.size = self._ENDS[-1]
        if flat is None:
            rng, parts = np.random.default_rng(seed), []
            for name, shape in self.SHAPES.items():
                bias = name.endswith("bias") or name in ("hidden", "distance")
                scale = 0.0 if bias else 0.5 if name == "embed" else 1 / np.sqrt(shape[-2])
                parts.append(rng.normal(0, 1, int(np.prod(shape))) * scale)
            flat = np.concatenate(parts)
        self.flat = np.array(flat, np.float32)
        self._name()

    def _name(self) -> None:
        self.p = {name: self.flat[at].reshape(shape) for name, at, shape in self._PARTS}

    # Distance of key j from query i of a window is i + BLOCK - j; keys after the query are out of sight.
    _FROM = np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None, :]

    def _bias(self) -> np.ndarray:
        return np.where(self._FROM >= 0, self.p["distance"][np.maximum(self._FROM, 0)], _FAR).astype(np.float32)

    def tables(self) -> dict[str, np.ndarray]:
        """What depends on a place alone, worked out once for all ids to be scored."""
        e, p = self.p["embed"], self.p
        return {
            "q": e @ (p["q"] / np.float32(np.sqrt(WIDTH))), "kv": e @ np.hstack([p["k"], p["v"]]), "own": e @ p["own"] + p["hidden"],
            "bias": self._bias().T.copy(),
        }

    def scoring(self) -> dict[str, np.ndarray]:
        """The tables as ``log10`` takes them. Values are already those of the hidden units, with a last
        column that counts what is seen; ``out`` holds both steps' weights per group, biases last."""
        t, p = self.tables(), self.p
        keys, values = t["kv"][:, :WIDTH], t["kv"][:, WIDTH:] @ p["mixed"]
        counted = np.hstack([values, np.ones((PAD + 1, 1), np.float32)])
        counted[PAD] = 0  # padding is not seen
        weights = np.concatenate([np.broadcast_to(p["group"], (GROUPS, HIDDEN, GROUPS)), p["inside"]], 2)
        biases = np.hstack([np.broadcast_to(p["group_bias"], (GROUPS, GROUPS)), p["inside_bias"]])
        return t | {
            "kv": np.hstack([keys, counted]), "own": np.hstack([t["own"], np.ones((PAD + 1, 1), np.float32)]),
            "out": np.concatenate([weights, biases[:, None, :]], 1),
        }

    def _sight(self, current: np.ndarray, keys: np.ndarray, t: dict[str, np.ndarray]) -> np.ndarray:
        """How much each key (rows) is looked at by each query (columns), before it is divided by the query's sum.
        Queries stand in columns as small products of this form need no operand turned but the queries."""
        queries = np.take(t["q"], current, 0).transpose(0, 2, 1).copy()
        sight = np.matmul(keys, queries)
        sight += t["bias"]
        _clipped(sight)
        return np.exp(sight, out=sight)

    def _attend(self, windows: np.ndarray, t: dict[str, np.ndarray]):
        current = windows[:, BLOCK:]
        both = np.take(t["kv"], windows, 0)
        keys, values = both[..., :WIDTH], both[..., WIDTH:]
        sight = self._sight(current, keys, t)
        padded = windows == PAD
        edge = np.flatnonzero(padded.any(1))
        sight[edge] *= ~padded[edge][:, :, None]
        total = np.matmul(_ONES.T, sight).transpose(0, 2, 1)
        total += _LEAST  # a query of padding sees nothing
        seen = np.matmul(sight.transpose(0, 2, 1), values)
        seen /= total
        return current, keys, values, sight, total, seen

    def log10(self, windows: np.ndarray, targets: np.ndarray, real: np.ndarray, t: dict[str, np.ndarray]) -> np.ndarray:
        """Per real target in stream order: log10 probability of its place, and that a word begins there.
        ``t`` is what ``scoring`` gives."""
        hidden = np.empty((len(windows), BLOCK, HIDDEN + 1), np.float32)
        for at in range(0, len(windows), _BATCH):  # as much as fits a core's cache
            w = windows[at : at + _BATCH]
            current, both = w[:, BLOCK:], np.take(t["kv"], w, 0)
            seen = np.matmul(self._sight(current, both[..., :WIDTH], t).transpose(0, 2, 1), both[..., WIDTH:])
            seen /= seen[..., HIDDEN:] + _LEAST
            seen[..., HIDDEN] = 0
            seen += np.take(t["own"], current, 0)
            np.maximum(seen, 0, out=hidden[at : at + _BATCH])
        wanted = targets[real]
        group, place = np.divmod(wanted, PLACES)
        order = np.argsort(group.astype(np.int8), kind="stable")
        cuts = np.searchsorted(group[order], np.arange(GROUPS + 1))
        hidden, place = np.take(hidden.reshape(-1, HIDDEN + 1), np.flatnonzero(real)[order], 0), place[order] + GROUPS
        found, rows = np.empty((len(wanted), 2), np.float32), np.arange(len(wanted))
        for g in range(GROUPS):  # rows of one group at a time, so the weights of both steps are one matrix
            for a in range(cuts[g], cuts[g + 1], _ROWS):
                at = slice(a, min(a + _ROWS, cuts[g + 1]))
                logits = _clipped(hidden[at] @ t["out"][g])
                chosen = logits[:, g] + logits[rows[: len(logits)], place[at]]
                found[at, 0], found[at, 1] = _shares(logits, chosen)
        out = np.empty_like(found)
        out[order] = found
        out *= np.float32(1 / np.log(10))
        return out

    def gradient(self, windows: np.ndarray, targets: np.ndarray, real: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean loss (nats) of the real targets and its gradient, flat."""
        p, e = self.p, self.p["embed"]
        g = Attention(np.zeros(self.size, np.float32))
        d = g.p
        t = self.tables()
        current, keys, values, sight, total, seen = self._attend(windows, t)
        group, place = np.divmod(targets[real], PLACES)
        order = np.argsort(group.astype(np.int8), kind="stable")  # one group after the other, as in ``log10``
        group, place, rows = group[order], place[order], np.flatnonzero(real)[order]
        cuts = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
        spans = [(x, slice(a, b)) for x, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
        flat_seen, own = np.take(seen.reshape(-1, WIDTH), rows, 0), np.take(current.ravel(), rows)
        hidden = flat_seen @ p["mixed"]
        hidden += np.take(t["own"], own, 0)
        np.maximum(hidden, 0, out=hidden)
        n = max(1, len(rows))
        first, second = hidden @ p["group"], np.empty((len(rows), PLACES), np.float32)
        first += p["group_bias"]
        for x, at in spans:  # the second step's weights are those of the group
            np.matmul(hidden[at], p["inside"][x], out=second[at])
            second[at] += p["inside_bias"][x]
        loss = _loss(first, group) + _loss(second, place)
        d_hidden, more = first @ p["group"].T.copy(), np.empty_like(hidden)
        d["group"][:], d["group_bias"][:] = hidden.T @ first, _sum(first)
        turned = p["inside"].transpose(0, 2, 1).copy()
        for x, at in spans:
            np.matmul(hidden[at].T, second[at], out=d["inside"][x])
            d["inside_bias"][x] = _sum(second[at])
            np.matmul(second[at], turned[x], out=more[at])
        d_hidden += more
        d_hidden *= hidden > 0
        d["hidden"][:] = _sum(d_hidden)
        d["mixed"][:] = flat_seen.T @ d_hidden
        d["own"][:] = np.take(e, own, 0).T @ d_hidden
        d_seen = np.zeros((real.size, WIDTH), np.float32)
        d_past = d_hidden @ np.hstack([p["mixed"].T, p["own"].T])
        d_seen[rows] = d_past[:, :WIDTH]
        d_seen = d_seen.reshape(seen.shape)
        d_seen /= total
        of_total = np.einsum("bqw,bqw->bq", d_seen, seen)
        d_both = np.empty((*windows.shape, 2 * WIDTH), np.float32)
        np.matmul(sight, d_seen, out=d_both[..., WIDTH:])
        d_sight = np.matmul(values, d_seen.transpose(0, 2, 1).copy())
        d_sight -= of_total[:, None, :]
        d_sight *= sight
        by_distance = d_sight.sum(0).T
        seen_pairs = self._FROM >= 0
        d["distance"][:] = np.bincount(self._FROM[seen_pairs], by_distance[seen_pairs], 2 * BLOCK)
        queries = np.take(t["q"], current, 0)
        np.matmul(d_sight, queries, out=d_both[..., :WIDTH])
        d_query = np.matmul(d_sight.transpose(0, 2, 1), keys).reshape(-1, WIDTH)
        d_query *= np.float32(1 / np.sqrt(WIDTH))
        at_query, at_key, d_both = current.ravel(), windows.ravel(), d_both.reshape(-1, 2 * WIDTH)
        d["q"][:] = np.take(e, at_query, 0).T @ d_query
        d_kv = np.take(e, at_key, 0).T @ d_both
        d["k"][:], d["v"][:] = d_kv[:, :WIDTH], d_kv[:, WIDTH:]
        d_query = d_query @ p["q"].T.copy()
        d_query[rows] += d_past[:, WIDTH:]
        d_window = (d_both @ np.vstack([p["k"].T, p["v"].T])).reshape(*windows.shape, WIDTH)
        d_window[:, BLOCK:] += d_query.reshape(*current.shape, WIDTH)  # a query's place is among those of its window
        d["embed"][:] = _add_up(at_key, d_window.reshape(-1, WIDTH))
        g.flat /= n
        return loss / n, g.flat


def _add_up(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of the rows of each place."""
    order = np.argsort(ids.astype(np.int16), kind="stable")
    ids = ids[order]
    firsts = np.flatnonzero(np.diff(ids, prepend=-1))
    out = np.zeros((PAD + 1, WIDTH), np.float32)
    if len(firsts):
        out[ids[firsts]] = np.add.reduceat(np.take(rows, order, 0), firsts, 0)
    return out


def keep_memory() -> None:
    """From now on the process keeps the memory of freed arrays: malloc raises its limits to the size of the first
    large array that is freed. Otherwise every step gets its memory anew, page by page."""
    np.empty(31 << 20, np.int8)


def _sum(rows: np.ndarray) -> np.ndarray:
    return np.ones(len(rows), np.float32) @ rows


def _clipped(x: np.ndarray) -> np.ndarray:
    """``x`` itself, changed in place, so that its exponentials are finite."""
    return x if x.max() <= _MOST else np.minimum(x, _MOST, out=x)


def _shares(logits: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log shares in both steps together of what was chosen, and in the first step of the groups that begin a word."""
    np.exp(logits, out=logits)
    total = np.log(logits[:, :GROUPS] @ _ONES[:GROUPS, 0])
    begins = np.log(logits[:, :FIRST] @ _ONES[:FIRST, 0]) - total
    return chosen - total - np.log(logits[:, GROUPS:] @ _ONES[:PLACES, 0]), begins


def _loss(logits: np.ndarray, chosen: np.ndarray) -> float:
    """Loss of one step for what was chosen; the logits become its gradient by them."""
    np.exp(_clipped(logits), out=logits)
    logits *= np.reciprocal(logits @ _ONES[: logits.shape[1], 0] + _LEAST)[:, None]
    at = np.arange(len(logits)) * logits.shape[1] + chosen
    flat = logits.reshape(-1)
    share = np.take(flat, at)
    flat[at] = share - 1
    return -float(np.log(share + 1e-12).sum())


class Trainer:
    """Adam over batches of windows."""

    def __init__(self, model: Attention, rate: float):
        self.model, self.rate, self.step = model, rate, 0
        self.m, self.s = np.zeros(model.size, np.float32), np.zeros(model.size, np.float32)

    def learn(self, windows: np.ndarray, targets: np.ndarray, real: np.ndarray) -> float:
        loss, g = self.model.gradient(windows, targets, real)
        self.step += 1
        self.m += 0.1 * (g - self.m)
        g *= g
        g -= self.s
        g *= 0.01
        self.s += g
        root = np.sqrt(self.s / (1 - 0.99**self.step), out=g)
        root += 1e-6
        change = np.divide(self.m, root, out=root)
        change *= self.rate / (1 - 0.9**self.step)
        self.model.flat -= change
        return loss
