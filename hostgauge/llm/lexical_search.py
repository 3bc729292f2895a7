"""Ranked lexical search, term at a time with a limit on new accumulators.

Documents lie in shards (the Arrow batches of their postings). A shard answers an
item by going through its terms from the rarest to the most frequent. Each posting
adds to its document's accumulator; new accumulators are made only as long as a
document without one could still get into the item's best ten: once the bounds of
the terms that are left add up to less than the tenth best partial score, only the
documents that have an accumulator go on, and these are scored to the end. So
the scores are exact, and the many postings of frequent words make no accumulators.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from hostgauge.session import materialize

TOP = 10
# (item, term) pairs that are sent to every worker at a time; more items go in further rounds
PAIRS = 200_000
_GAPS = bytes(c for c in range(0x80) if not chr(c).isalnum())
_TERM_BYTES = bytes.maketrans(_GAPS + bytes(range(65, 91)), b" " * len(_GAPS) + bytes(range(97, 123)))


def terms(text: str | None) -> list[bytes]:
    """Runs of letters and digits of ASCII and of all other characters, with A-Z in lower case; null has none."""
    return text.encode().translate(_TERM_BYTES).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, m: np.ndarray, w: np.ndarray) -> np.ndarray:
    """What a term adds to a document's score, in whole numbers."""
    return w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def length_norm(n: int, n_docs: int, total: int) -> int:
    return 10 + (90 * n * n_docs) // total


# -- postings --------------------------------------------------------------------------

POSTINGS = "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>"


def _postings(docs: DataFrame, known) -> DataFrame:
    """Per document with a term: its length and the known terms it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for batch in batches:
            ids, lengths, ends, found, counts = [], [], [0], [], []
            for doc, text in zip(batch.column(0), batch.column(1)):
                all_terms = terms(text.as_py())
                if not all_terms:
                    continue
                held = {number[t]: c for t, c in Counter(all_terms).items() if t in number}
                ids.append(doc.as_py())
                lengths.append(len(all_terms))
                found.extend(held)
                counts.extend(held.values())
                ends.append(len(found))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(found, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64())),
                ],
                names=["doc_id", "n", "terms", "tfs"],
            )

    return docs.mapInArrow(run, POSTINGS)


# -- one shard -------------------------------------------------------------------------


class Shard:
    """Postings of some documents by term, with what each adds to the score."""

    def __init__(self, ids: list, n: np.ndarray, ends: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray, n_docs: int, total: int):
        self.ids = ids
        m = np.array([length_norm(int(x), n_docs, total) for x in n], np.int64)
        doc = np.repeat(np.arange(len(n)), np.diff(ends))
        order = np.argsort(term, kind="stable")
        self.doc, term = doc[order], term[order]
        self.impact = impacts(tf[order], m[self.doc], weights[term])
        self.start = np.searchsorted(term, np.arange(len(weights) + 1))
        filled = self.start[:-1] < self.start[1:]
        self.bound = np.zeros(len(weights), np.int64)
        if len(term):
            self.bound[filled] = np.maximum.reduceat(self.impact, self.start[:-1][filled])

    def best(self, item: np.ndarray, top: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Documents (positions) that may be among the best ``top`` of ``item`` (terms, rarest first), and their scores.

        ``floor`` is a score that ``top`` documents elsewhere reach already.
        """
        item = item[self.start[item] < self.start[item + 1]]
        left = np.concatenate([np.cumsum(self.bound[item][::-1])[::-1][1:], [0]])
        score = np.zeros(len(self.ids), np.int64)
        has = np.zeros(len(self.ids), bool)
        open_ = int(self.bound[item].sum()) >= floor  # equal scores may win by their id
        for t, rest in zip(item.tolist(), left.tolist()):
            at = slice(self.start[t], self.start[t + 1])
            doc, impact = self.doc[at], self.impact[at]
            if not open_:
                own = has[doc]
                doc, impact = doc[own], impact[own]
            else:
                has[doc] = True
            score[doc] += impact
            if open_:
                open_ = rest >= max(floor, self._kth(score, top) if rest < score.max() else 0)
        found = np.flatnonzero(has & (score > 0) & (score >= floor))
        if len(found) > top:
            kth = np.partition(score[found], len(found) - top)[len(found) - top]
            found = found[score[found] >= kth]
        return found, score[found]

    @staticmethod
    def _kth(score: np.ndarray, top: int) -> int:
        """The ``top``-th best of the partial scores (those without accumulator are 0)."""
        return int(np.partition(score, len(score) - top)[len(score) - top]) if len(score) >= top else 0


def _doc_order(doc: int | None) -> tuple:
    return (doc is None, doc or 0)


def _search(postings: DataFrame, queries, weights, n_docs: int, total: int, top: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, w = queries.value, weights.value
        best: list[list[tuple[int, tuple, int | None]]] = [[] for _ in items]
        for batch in batches:
            if not batch.num_rows:
                continue
            term_lists, tf_lists = batch.column(2), batch.column(3)
            ends = term_lists.offsets.to_numpy()
            shard = Shard(
                batch.column(0).to_pylist(), batch.column(1).to_numpy(), ends,
                term_lists.flatten().to_numpy(), tf_lists.flatten().to_numpy(), w, n_docs, total,
            )
            for i, item in enumerate(items):
                floor = -best[i][-1][0] if len(best[i]) == top else 0
                found, scores = shard.best(item, top, floor)
                if len(found):
                    new = [(-s, _doc_order(shard.ids[d]), shard.ids[d]) for d, s in zip(found.tolist(), scores.tolist())]
                    best[i] = sorted(best[i] + new)[:top]
        rows = [(i, doc, -s) for i, each in enumerate(best) for s, _, doc in each]
        columns = list(zip(*rows)) or [(), (), ()]
        kinds = (pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["item", "doc_id", "score"])

    return postings.mapInArrow(run, "item int, doc_id bigint, score bigint")


# -- the operator ----------------------------------------------------------------------


def search(
    docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id",
    item_text: str = "text", top: int = TOP, pairs: int = PAIRS,
) -> DataFrame:
    """Each item's ``top`` documents: item_id, rank, doc_id, score.

    Rows of one item id are one item with the terms of them all; an item without
    terms, or without a document that scores above 0, has no rows. Every row of
    ``docs`` is a document of its own; equal scores go by rising id, null last.
    Empty tables give no rows. Items go in rounds of about ``pairs`` (item, term)
    pairs, which is what the driver and each worker hold; each round reads ``docs`` once.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    asked = _item_terms(items, item_id, item_text)
    kind = asked.schema["item_id"].dataType
    n_rounds = max(1, -(-asked.count() // pairs))
    round_of = F.pmod(F.xxhash64("item_id"), F.lit(n_rounds))
    out = None
    for at in range(n_rounds):
        part = asked.where(round_of == at)
        mine = _round(spark, texts, part, top)
        if mine is not None:
            out = mine if out is None else out.unionAll(mine)
    empty = spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id bigint, score bigint")
    return empty if out is None else out


def _item_terms(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """Distinct (item_id, term)."""
    rows = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    schema = rows.select("item_id").schema.add("term", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(set(terms(t))) for t in batch.column(1).to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(f) for f in found])
            flat = pa.array([t for f in found for t in f], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), flat], names=["item_id", "term"])

    return materialize(rows.mapInArrow(run, schema).distinct())


def _round(spark, texts: DataFrame, asked: DataFrame, top: int) -> DataFrame | None:
    pairs = asked.toArrow()  # at most a round's pairs
    names, of = pairs.column("term").to_pylist(), pairs.column("item_id").to_pylist()
    number = {t: i for i, t in enumerate(sorted(set(names)))}
    known = spark.sparkContext.broadcast(number)
    postings = materialize(_postings(texts, known))
    n_docs, total = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not names or not n_docs:
        return None
    df = [0] * len(number)
    for term, n in postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row per known term
        df[term] = n
    weights = np.array([weight(n_docs, d) for d in df], np.int64)

    of_item: dict = {}
    for item, name in zip(of, names):
        of_item.setdefault(item, []).append(number[name])
    queries = [np.array(sorted(found, key=lambda t: (df[t], t)), np.int64) for found in of_item.values()]  # rarest first
    broadcast = spark.sparkContext.broadcast
    found = _search(postings, broadcast(queries), broadcast(weights), n_docs, total, top)
    # at most ten rows per item and task come in, and each task cuts its own to ten before they meet
    by_score = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= top)
    schema = f"item int, item_id {asked.schema['item_id'].dataType.simpleString()}"
    back = spark.createDataFrame(list(enumerate(of_item)), schema)
    return ranked.join(F.broadcast(back), "item").select("item_id", "rank", "doc_id", "score")
