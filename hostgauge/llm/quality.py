"""Quality scores learnt from pairs (Bradley-Terry), cut at a quantile of the scores.

Of a good and a bad document the good one should win: the chance is the logistic
function of the difference of their scores, and a score is linear in the
document's features. Only differences of features are learnt from, so the share
of bad documents does not matter until the threshold: the quantile of the
training scores at which as many lie below as there are bad ones.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from hostgauge.llm.common import crc_mod, map_texts
from hostgauge.operators.ordered import exact_quantiles
from hostgauge.session import lookup_side, materialize

GROUP_ROWS = 20_000  # labelled rows that one task learns from, about; all labelled rows are in some group
_RARER = 50  # rows of the rarer label in a group, about, at least
_UNIT = 1 << 20  # sums of whole numbers of this part do not depend on their order
PAIRS, STEPS, RATE, RIDGE = 4096, 400, 0.3, 1e-3
FEATURES = [
    "log_words", "word_length", "upper", "digits", "marks", "symbols", "marked_words", "repeated_neighbour", "distinct_pairs",
    "commonest_word", "repeated_lines", "line_words", "short_words", "capital_words",
]

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGITS = bytes(range(48, 58))
_MARKS = b".,;:!?'\"()-"
_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = bytes(b for b in range(33, 127) if b not in _LETTERS + _DIGITS + _MARKS)


def features(text: str | None) -> list[float]:
    """Shape of a whole text, each number in a range of a few units; empty text: all zero."""
    data = (text or "").encode()
    found = data.split()
    if not found:
        return [0.0] * len(FEATURES)
    n = len(found)
    size = len(data)
    count = lambda among: size - len(data.translate(None, among))
    letters = max(1, count(_LETTERS))
    visible = max(1, size - count(_SPACE))
    pairs = set(zip(found, found[1:]))
    lines = [x for x in data.split(b"\n") if x.strip()]
    symbols = count(_SYMBOLS)
    return [
        math.log1p(n) / 5,
        min(3.0, visible / n / 8),
        count(_UPPER) / letters,
        count(_DIGITS) / visible * 5,
        count(_MARKS) / visible * 5,
        min(3.0, symbols / visible * 10),
        sum(not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:" for w in found) / n,
        sum(map(bytes.__eq__, found, found[1:])) / n,
        len(pairs) / max(1, n - 1),
        Counter(found).most_common(1)[0][1] / n if n > 20 else 0.0,
        1 - len(set(lines)) / len(lines),
        min(3.0, math.log1p(n / len(lines)) / 3),
        sum(len(w) <= 3 for w in found) / n,
        sum(w.isupper() and len(w) > 1 for w in found) / n,
    ]


@dataclass
class Ranking:
    """score = logistic(slope * (weights . (x - mean) / spread - threshold))"""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.spread) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.raw(x) - self.threshold), -30, 30)))


def learn(x: np.ndarray, good: np.ndarray, seed: int = 5) -> Ranking:
    """From features and labels (1 good, 0 bad). With one class only, everything scores one half."""
    k = x.shape[1] if x.ndim == 2 else len(FEATURES)
    if not len(good) or good.min() == good.max():
        return Ranking(np.zeros(k), np.ones(k), np.zeros(k), 0.0, 1.0)
    mean, spread = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / spread
    winners, losers = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    w = weights(z, good, seed)
    raw = np.sort(z @ w)
    bad = len(losers)
    threshold = float(raw[bad - 1] + raw[bad]) / 2  # the quantile at the share of bad ones
    gap = float((z[winners] @ w).mean() - (z[losers] @ w).mean())
    return Ranking(mean, spread, w, threshold, 6 / max(gap, 1e-6))


def weights(z: np.ndarray, good: np.ndarray, seed: int = 5) -> np.ndarray:
    winners, losers = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    rng, w, speed = np.random.default_rng(seed), np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for _ in range(STEPS):
        d = z[rng.choice(winners, PAIRS)] - z[rng.choice(losers, PAIRS)]
        lost = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # chance that the worse one wins
        speed = 0.9 * speed + (lost @ d / PAIRS - RIDGE * w)
        w = w + RATE * speed
    return w


def learn_all(rows: DataFrame, group_rows: int = GROUP_ROWS) -> Ranking:
    """``learn`` from all stored rows (``doc``, ``label``, ``x``): a task learns weights from each group of rows, by hash of
    the id, and the mean of these counts. Means, spreads and the threshold are those of all rows. A label so rare that
    groups would lack it makes fewer and larger groups.
    """
    rows, k = rows.where("label in (0, 1)"), range(len(FEATURES))
    x = [F.col("x")[i] for i in k]
    sums = [F.sum(F.round(v * _UNIT).cast("bigint")) for v in x] + [F.sum(F.round(v * v * _UNIT).cast("bigint")) for v in x]
    found = {r[0]: r for r in rows.groupBy("label").agg(F.count(F.lit(1)), *sums).collect()}  # two rows
    if set(found) != {0, 1}:
        return learn(np.zeros((0, len(FEATURES))), np.zeros(0))
    counts = {label: r[1] for label, r in found.items()}
    first, second = ({label: np.array(r[2 + at : 2 + at + len(k)]) / _UNIT for label, r in found.items()} for at in (0, len(k)))
    n = counts[0] + counts[1]
    mean = (first[0] + first[1]) / n
    spread = np.sqrt(np.maximum((second[0] + second[1]) / n - mean**2, 0)) + 1e-6
    groups = max(1, min(-(-n // group_rows), min(counts.values()) // _RARER))

    def of_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(x=pdf["x"].map(tuple)).sort_values(["doc", "label", "x"])  # the order of arrival must not matter
        good = pdf["label"].to_numpy()
        if good.min() == good.max():
            return pd.DataFrame({"part": [], "n": [], "w": []})
        w = weights((np.array(pdf["x"].tolist()) - mean) / spread, good)
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "n": [len(pdf)], "w": [w]})

    parts = rows.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(groups)))
    learnt = sorted(parts.groupBy("part").applyInPandas(of_group, "part bigint, n bigint, w array<double>").collect())
    if not learnt:
        raise ValueError("no group of rows holds both labels")
    w = sum(r["n"] * np.array(r["w"]) for r in learnt) / sum(r["n"] for r in learnt)

    raw = materialize(rows.select(sum(((v - m) / s * c for v, m, s, c in zip(x, mean.tolist(), spread.tolist(), w.tolist())), F.lit(0.0)).alias("raw")))
    share = (counts[0] - 0.5) / (n - 1)  # half way between the greatest that counts as bad and the next
    threshold = exact_quantiles(raw, "raw", {"cut": share}).first()["cut"]
    gap = float((first[1] / counts[1] - first[0] / counts[0]) / spread @ w)
    return Ranking(mean, spread, w, threshold, 6 / max(gap, 1e-6))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, text: str, doc_id: str, at_most: int | None, fold: int = 1, folds: int = 3) -> DataFrame:
    """``doc``, ``text`` and ``label`` of labelled rows outside the held-out fold: all, or at most ``at_most`` of them.

    The choice goes by a hash of the id. Null ids and labels teach nothing; of
    several texts of one id and label the greatest is taken.
    """
    known = labels.select(F.col("doc_id").alias("doc"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("doc").isNotNull() & F.col("label").isNotNull() & (crc_mod("doc", folds) != fold))
    texts = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    if at_most is None:
        chosen = lookup_side(materialize(known))
    else:
        chosen = F.broadcast(known.orderBy(F.xxhash64("doc"), "doc", "label").limit(at_most))  # top rows per partition, then of those
    return texts.join(chosen, "doc").groupBy("doc", "label").agg(F.max("text").alias("text"))


def score_quality(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """One row per input row: ``keep``, ``held_out``, ``score`` (0 to 1), ``predicted`` (score >= 0.5).

    The model comes from all labelled rows outside the held-out fold;
    scores come from the whole text and nothing else. Null and empty texts are
    scored as the zero features. Repeated rows score alike. Without labels of both
    kinds every score is one half. No rows in, no rows out.
    """
    keep = keep or [doc_id]
    rows = training_rows(docs, labels, "quality", text, doc_id, None)
    model = learn_all(materialize(map_texts(rows, ["doc", "label"], ["text"], "x array<double>", lambda t: (features(t),))), group_rows)

    def judge(t):
        score = float(model.score(np.array(features(t))[None, :])[0])
        return score, int(score >= 0.5)

    kept = docs.select(*keep, F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    scored = map_texts(kept, [*keep, "__id"], ["__text"], "score double, predicted int", judge)
    return scored.select(*keep, (crc_mod("__id", 3) == 1).alias("held_out"), "score", "predicted")
