"""Language-model scores of whole texts: a causal self-attention model on subword ids, next to word counts.

What is learnt from the training fold grows with it: counts of all words, from
them the frequencies of subword ids, and the attention model's weights. These are
warmed up in one task on runs of words of a bounded sample and then trained in one
round over every word of all training documents: every task goes on from the same
weights with the whole texts of its own documents, laid out as they are scored, and
the weights are averaged by the ids seen.

The model's chance of a word is a mix of the attention model's (the product over
the word's ids, times the chance that the word ends there) and the word's share of
the training words. Every task knows the shares of the most frequent words; those of
the others are joined, so how many every task knows changes no result. The attention
model reads every text once more after the training round: what that gives per word
is stored, the weight of the mix is fitted on it and the mix is then worked out from it.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from hostgauge.llm.attention import Attention, Trainer, Vocabulary, keep_memory, lay_out
from hostgauge.llm.common import crc_mod, words
from hostgauge.llm.subwords import Subwords, vocabulary_path
from hostgauge.session import materialize

FOLDS = 10
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
END = b"\n"  # no word holds it
WORDS = 400_000  # words whose counts every task knows, at most; the others' counts are joined
SAMPLE = 2000  # documents of the warm-up
RUN, WARM_EVERY = 40, 160  # the warm-up takes a run of 40 words out of every 160 words (or fewer) of a sample document
FINE, _FAR = 256, 30  # the mix is fitted on ratios of chances per 1/256 of a power of ten, within 10^30
WARM_EPOCHS, BATCH, RATE, ROUND_RATE = 8, 32, 0.012, 0.003
_FLUSH = 600_000  # distinct words that a task counts before it hands them on
_TOKENS = 40_000  # ids laid out together
_WINDOWS = 2048  # windows scored together
_STEP, _LARGEST, _GROW = 256, 1024, 128  # windows of a step of the training round: at first, at most, and steps until they double
_KNOWN = 900_000  # words whose ids a task remembers


class KnownWords:
    """Words by falling count, in two arrays; ``Speller`` finds them in what it is given ready."""

    def __init__(self, found: list[bytes]):
        self._joined = b"".join(found)
        self._ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))

    def __len__(self) -> int:
        return len(self._ends)

    def __iter__(self) -> Iterator[bytes]:
        at = 0
        for end in self._ends.tolist():
            yield self._joined[at:end]
            at = end

    def get(self, word: bytes, default: int) -> int:
        """Only asked for words that are not among these."""
        return default


class Shared:
    """The weights and what is known of words, sent to the workers apart, as the latter is large and never changes."""

    def __init__(self, weights, known):
        self._weights, self._known = weights, known

    @property
    def value(self) -> tuple:
        return (self._weights.value, *self._known.value)


class Speller:
    """Words to places of subword ids, each distinct word looked up once."""

    def __init__(self, path: str, vocabulary: Vocabulary, counts: dict[bytes, int], ready: tuple | None = None):
        self._subwords = Subwords(path)
        self._vocabulary, self._counts, self._ready = vocabulary, counts, ready
        self.end = len(vocabulary.place) - 1
        self._clear()

    def _clear(self) -> None:
        """Back to the words known to all, spelled once by ``ready``."""
        self._at: dict[bytes, int] = dict(zip(self._counts, range(len(self._counts)))) if self._ready else {}
        # places: of all words one after the other; share: of rare ids among those of their place;
        # count: -1 if the word is not among those known to all
        empty = (np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
        self.places, self.begin, self.length, self.share, self.count = self._ready or empty
        self.used = len(self.places)

    def ready(self) -> tuple:
        """What tasks need to start with all known words spelled."""
        fresh = Speller.__new__(Speller)
        fresh.__dict__.update(self.__dict__, _ready=None)
        fresh._clear()
        if self._counts:
            fresh._add(list(self._counts))
        n = len(self._counts)
        return fresh.places[: fresh.used], fresh.begin[:n], fresh.length[:n], fresh.share[:n], fresh.count[:n]

    def _add(self, missing: list[bytes]) -> None:
        ids = self._subwords.of_words(missing)
        if END in missing:
            ids[missing.index(END)] = [self.end]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum()))
        n, m = len(self._at), len(missing)
        for name in ("begin", "length", "share", "count"):
            old = getattr(self, name)
            if n + m > len(old):
                setattr(self, name, np.concatenate([old[:n], np.empty(len(old) + 2 * m + 1024, old.dtype)]))
        if self.used + len(flat) > len(self.places):
            more = np.empty(len(self.places) + 2 * len(flat) + 1024, np.int32)
            self.places = np.concatenate([self.places[: self.used], more])
        self.places[self.used : self.used + len(flat)] = self._vocabulary.place[flat]
        ends = np.cumsum(sizes)
        self.begin[n : n + m] = self.used + ends - sizes
        self.length[n : n + m] = sizes
        self.share[n : n + m] = np.add.reduceat(self._vocabulary.share[flat].astype(np.float64), ends - sizes)
        self.count[n : n + m] = [self._counts.get(w, -1) for w in missing]
        self.used += len(flat)
        self._at.update(zip(missing, range(n, n + m)))

    def look_up(self, found: list[bytes]) -> np.ndarray:
        """Numbers of the words; good until the next call."""
        at = self._at
        numbers = np.fromiter(map(at.get, found, repeat(-1)), np.int64, len(found))
        gaps = np.flatnonzero(numbers < 0)
        if not len(gaps):
            return numbers
        missing = list(dict.fromkeys(map(found.__getitem__, gaps.tolist())))
        if len(at) + len(missing) > _KNOWN and len(at) > len(self._counts):
            self._clear()
            return self.look_up(found)
        self._add(missing)
        numbers[gaps] = [at[found[i]] for i in gaps.tolist()]
        return numbers

    def spell(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words one after the other, and where each word begins among them."""
        sizes = self.length[numbers]
        starts = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(self.begin[numbers] - starts, sizes)
        return self.places[at], starts


def _cut(places: np.ndarray, starts: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """Places of runs of so many words each, from those of all their words together."""
    firsts = np.cumsum([0, *sizes[:-1]])
    return np.split(places, starts[firsts[1:]])


def _whole(speller: Speller, documents: list[list[bytes]]) -> tuple[np.ndarray, ...]:
    """Whole documents (each with the end last) laid out: numbers of their words, where each word begins among
    the places, number of the first word of each document; windows, targets and which are real."""
    sizes = list(map(len, documents))
    numbers = speller.look_up(list(chain.from_iterable(documents)))
    places, starts = speller.spell(numbers)
    start = int(speller._vocabulary.place[speller.end])
    laid = lay_out(_cut(places, starts, sizes), [start] * len(documents))
    return numbers, starts, np.cumsum([0, *sizes[:-1]]), *laid


def lessons(speller: Speller, documents: list[list[bytes]], size: int = _STEP) -> Iterator[tuple]:
    """Every word of the documents once, with the past that it is scored with; ``size`` windows at a time in a drawn order."""
    *_, windows, targets, real = _whole(speller, documents)
    order = np.random.default_rng(len(windows)).permutation(len(windows))
    for a in range(0, len(order), size):
        at = order[a : a + size]
        yield windows[at], targets[at], real[at]


class Scorer:
    """log10 probabilities of words by the attention model, whole documents at a time."""

    def __init__(self, speller: Speller, model: Attention):
        self.speller, self.model, self.tables = speller, model, model.scoring()

    def score(self, documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all words of the documents (each with the end last) in order: log10 chance and
        known count; and the number of the first word of each document."""
        numbers, starts, firsts, windows, targets, real = _whole(self.speller, documents)
        parts = [
            self.model.log10(windows[a : a + _WINDOWS], targets[a : a + _WINDOWS], real[a : a + _WINDOWS], self.tables)
            for a in range(0, len(windows), _WINDOWS)
        ]
        found = np.concatenate(parts).astype(np.float64)
        begins = found[starts, 1]  # chance that the word before ended, which is that one's
        chance = np.add.reduceat(found[:, 0], starts) + self.speller.share[numbers] - begins
        begins[firsts] = 0.0  # nothing stands before a document
        chance[:-1] += begins[1:]
        return chance, self.speller.count[numbers], firsts


def runs(found: list[bytes], every: int = WARM_EVERY) -> list[tuple[bytes | None, list[bytes]]]:
    """Runs of words to warm up on, with the word before (None: the start), at places drawn by the text itself."""
    rng = np.random.default_rng([zlib.crc32(b" ".join(found[:64])), len(found)])
    out = []
    for s in range(0, len(found), every):
        room = max(1, min(every, len(found) - s) - RUN + 1)
        at = s + int(rng.integers(room))
        out.append((found[at - 1] if at else None, found[at : at + RUN]))
    return out


def _batches(speller: Speller, taken: list[tuple[bytes | None, list[bytes]]]) -> Iterator[tuple]:
    """Laid out for the warm-up; the first input of a run is the last id of the word before (or the end)."""
    for a in range(0, len(taken), BATCH):
        part = taken[a : a + BATCH]
        all_words = [w for before, run in part for w in (END if before is None else before, *run)]
        places, starts = speller.spell(speller.look_up(all_words))
        inputs = _cut(places, starts, [1 if i % 2 == 0 else len(part[i // 2][1]) for i in range(2 * len(part))])
        yield lay_out(inputs[1::2], [int(x[-1]) for x in inputs[::2]])


def _counted(train: DataFrame, text: str) -> DataFrame:
    """``word``, ``n`` over all training texts, ends included; tasks add up before they hand on."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            if seen:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"]
                )
                seen.clear()

        for batch in batches:
            for t in batch.column(0):
                seen.update(words(t.as_py()))
                seen[END] += 1
                if len(seen) > _FLUSH:
                    yield from out()
        yield from out()

    parts = train.select(text).mapInArrow(count, "word binary, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent words, at most ``most``, cut at a count: all words above it."""
    level = F.floor(F.log2("n") * 16)
    per_level = sorted(((r["level"], r["words"]) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()), reverse=True)
    total, lowest = 0, None
    for at, n in per_level:  # at most 16 levels per doubling of the count
        if total + n > most:
            break
        total, lowest = total + n, at
    if lowest is None:
        return counts.limit(0)
    return counts.where(level >= lowest)


def _spelled(frequent: DataFrame, path: str, vocabulary: Vocabulary) -> tuple[KnownWords, tuple]:
    """The frequent words and what ``Speller`` takes as ready; spelled by tasks, laid together here as arrays."""
    shared = frequent.sparkSession.sparkContext.broadcast(vocabulary)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            places, begin, length, share, count = Speller(path, shared.value, known).ready()
            lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(places)), pa.int32()), pa.array(places, pa.int32()))
            columns = [pa.array(list(known), pa.binary()), pa.array(count), lists, pa.array(share)]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "places", "share"])

    schema = "word binary, n bigint, places array<int>, share double"
    found = frequent.select("word", "n").mapInArrow(spell, schema).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    places = found.column("places").combine_chunks()
    length = np.asarray(places.value_lengths(), np.int64)
    numbers = [found.column(c).to_numpy() for c in ("share", "n")]
    ready = (places.flatten().to_numpy().astype(np.int32), np.cumsum(length) - length, length, *numbers)
    return KnownWords(found.column("word").to_pylist()), ready


def _id_counts(counts: DataFrame, path: str, size: int) -> np.ndarray:
    """How often each subword id stands in the training texts, by way of the counts of words."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = Subwords(path)
        total = [0] * size
        for batch in batches:
            found, n = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for w, k, ids in zip(found, n, subwords.of_words(found)):
                for i in [size - 1] if w == END else ids:
                    total[i] += k
        at = [i for i, n in enumerate(total) if n]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([total[i] for i in at], pa.int64())], names=["id", "n"])

    found = counts.select("word", "n").mapInArrow(spell, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[found["id"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)  # at most one row per id of the vocabulary
    return out


def _in_parts(texts: Iterable) -> Iterator[list[list[bytes]]]:
    """Words (the end last) of so many texts as are laid out together."""
    found, size_of = [], 0
    for t in texts:
        found.append(words(t.as_py()) + [END])
        size_of += len(found[-1])
        if size_of * 3 > _TOKENS:
            yield found
            found, size_of = [], 0
    if found:
        yield found


def _warmed_up(texts: DataFrame, sample: int, path: str, known) -> Attention:
    """Weights after ``WARM_EPOCHS`` rounds over runs of words of the sample's texts, in one task."""
    schema = "document bigint, words array<binary>, before binary"

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                found = words(t.as_py()) + [END]
                some = runs(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([zlib.crc32(b" ".join(found))] * len(some), pa.int64()),
                     pa.array([w for _, w in some], pa.list_(pa.binary())), pa.array([b for b, _ in some], pa.binary())],
                    names=["document", "words", "before"],
                )

    def warm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = sorted(  # the same runs in the same order whatever the tasks' order
            ((r["document"], r["words"], r["before"]) for batch in batches for r in batch.to_pylist()),
            key=lambda r: (r[0], r[1], r[2] or b""),
        )
        keep_memory()
        speller, model = Speller(path, *known.value), Attention()
        trainer, rng = Trainer(model, RATE), np.random.default_rng(3)
        for epoch in range(WARM_EPOCHS):
            trainer.rate = RATE / (1 + epoch)
            for b in _batches(speller, [taken[i][:0:-1] for i in rng.permutation(len(taken))]):
                trainer.learn(*b)
        yield pa.RecordBatch.from_arrays([pa.array([model.flat.tolist()], pa.list_(pa.float32()))], names=["weights"])

    some = texts.mapInArrow(pick, schema).orderBy(F.xxhash64("document", "words", "before"), "document").limit(16 * sample)
    found = some.repartition(1).mapInArrow(warm, "weights array<float>").first()
    return Attention(np.array(found["weights"], np.float32)) if found else Attention()


def _trained(
    train: DataFrame, text: str, start: Attention, path: str, vocabulary: Vocabulary, table: dict, ready: tuple, known=None
) -> Attention:
    """One round over all words of all training texts: tasks train on from ``start``, weights are averaged by ids seen.
    ``known`` is the broadcast of (vocabulary, table, ready), if there is one already."""
    broadcast = train.sparkSession.sparkContext.broadcast
    shared = Shared(broadcast(start.flat), known or broadcast((vocabulary, table, ready)))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        flat, voc, top, spelled = shared.value
        speller, model = Speller(path, voc, top, spelled), Attention(flat)
        trainer, seen = Trainer(model, ROUND_RATE), 0
        for documents in _in_parts(t for batch in batches for t in batch.column(0)):
            for b in lessons(speller, documents, min(_STEP << trainer.step // _GROW, _LARGEST)):
                trainer.learn(*b)
                seen += int(b[2].sum())
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([model.flat.tolist()], pa.list_(pa.float32())), pa.array([seen], pa.int64())], names=["weights", "seen"]
            )

    parts = train.select(text).mapInArrow(learn, "weights array<float>, seen bigint")
    each = parts.select(F.posexplode("weights").alias("at", "w"), "seen")
    mean = each.groupBy("at").agg((F.sum(F.col("w") * F.col("seen")) / F.sum("seen")).alias("w")).toPandas()
    if mean.empty:
        return start
    out = np.empty(start.size, np.float32)
    out[mean["at"].to_numpy()] = mean["w"].to_numpy()
    return Attention(out)


class Bins:
    """How many ratios (log10) there are per bin, and their sum."""

    def __init__(self):
        self._edge = _FAR * FINE
        self._m, self._total = np.zeros(2 * self._edge + 1, np.int64), np.zeros(2 * self._edge + 1)

    def add(self, ratios: np.ndarray) -> None:
        kept = np.clip(ratios, -_FAR, _FAR)
        at = np.floor(kept * FINE).astype(np.int64) + self._edge
        self._m += np.bincount(at, minlength=len(self._m))
        self._total += np.bincount(at, kept, len(self._total))

    def rows(self) -> list[dict]:
        used = np.flatnonzero(self._m)
        return [{"bin": x, "m": m, "total": t} for x, m, t in zip((used - self._edge).tolist(), self._m[used].tolist(), self._total[used].tolist())]


_JUDGED = (
    "row bigint, n_tokens bigint, known bigint, base double, own double, ratios binary, word array<binary>, "
    "chances array<array<double>>, bins array<struct<bin: bigint, m: bigint, total: double>>"
)


def _judged(docs: DataFrame, keep: list[str], text: str, learnt: Column, n_train: int, n_types: int, path: str, shared) -> DataFrame:
    """``keep`` of every row with what the model's weights and the known words say of its words, stored.

    ``own`` sums the log10 chances of the known words; ``ratios`` holds log10 of share by chance of each of them (float32).
    ``word`` and ``chances`` are those of the other words. The last row of a task has in ``bins`` the ratios of all
    its ``learnt`` rows; there a word itself is taken out of the counts, as it would not be in those of a new document.
    """
    source = docs.select(*keep, learnt.alias("learnt"), text)
    n_keep = len(keep) + 1
    out_schema = T.StructType([*source.schema.fields[:n_keep], *T.StructType.fromDDL(_JUDGED).fields])
    names, bins_type = out_schema.fieldNames(), pa.list_(pa.struct([("bin", pa.int64()), ("m", pa.int64()), ("total", pa.float64())]))
    total, floor = max(1, n_train), n_train + 0.1 * (n_types + 1)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        flat, voc, top, ready = shared.value
        scorer, bins = Scorer(Speller(path, voc, top, ready), Attention(flat)), Bins()
        row = TaskContext.get().partitionId() << 40

        def columns(batch, first, found):
            chance, count, firsts = scorer.score(found)
            there, sizes = count >= 0, list(map(len, found))
            log_share = np.log10(np.maximum(count, 1) / total)  # words known to all stand in training texts
            ratios = (log_share - chance).astype(np.float32)
            kept = batch.slice(first, len(found))
            learnt = there & np.repeat(kept.column(n_keep - 1).to_numpy(zero_copy_only=False).astype(bool), sizes)
            with np.errstate(divide="ignore"):
                bins.add(np.log10((count[learnt] - 1) / total) - chance[learnt])
            base = np.where(there, np.log10((np.maximum(count, 0) + 0.1) / floor), 0.0)
            rare: list[dict[bytes, list[float]]] = [{} for _ in found]
            gaps = np.flatnonzero(~there)
            in_doc = np.searchsorted(firsts, gaps, side="right") - 1
            for i, d, c in zip((gaps - firsts[in_doc]).tolist(), in_doc.tolist(), chance[gaps].tolist()):
                rare[d].setdefault(found[d][i], []).append(c)
            per_doc = zip(np.split(ratios, firsts[1:]), np.split(there, firsts[1:]))
            return [
                *kept.columns[:n_keep],
                pa.array(np.arange(row + first, row + first + len(found))), pa.array(sizes, pa.int64()),
                *[pa.array(np.add.reduceat(v, firsts)) for v in (there.astype(np.int64), base, np.where(there, chance, 0.0))],
                pa.array([r[t].tobytes() for r, t in per_doc], pa.binary()),
                pa.array([list(r) for r in rare], pa.list_(pa.binary())), pa.array([list(r.values()) for r in rare], pa.list_(pa.list_(pa.float64()))),
            ]

        def out(found: list[pa.Array], last: list[dict] | None = None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*found, pa.array([None] * (len(found[0]) - 1) + [last], bins_type)], names=names)

        before = None
        for batch in batches:
            first = 0
            for found in _in_parts(batch.column(n_keep)):
                if before:
                    yield out(before)
                before = columns(batch, first, found)
                first += len(found)
            row += batch.num_rows
        if before:
            yield out(before, bins.rows())

    return materialize(source.mapInArrow(judge, out_schema))


def _fitted(judged: DataFrame, counts: DataFrame, total: int) -> float:
    """Weight of the attention model in the mix, by expectation-maximisation on all words of all training texts.

    The expectation of a word depends only on the ratio of its share to its chance,
    so it is enough to know how many words have which ratio.
    """
    if not total:
        return 1.0
    rare = judged.where("learnt").select(F.inline(F.arrays_zip("word", "chances"))).join(counts, "word").select("n", F.explode("chances").alias("chance"))
    ratio = F.coalesce(F.log10((F.col("n") - 1) / F.lit(total)) - F.col("chance"), F.lit(-float(_FAR)))  # seen once: no share
    ratio = F.greatest(F.lit(-float(_FAR)), F.least(F.lit(float(_FAR)), ratio))
    rare = rare.select(F.floor(ratio * FINE).alias("bin"), F.lit(1).cast("bigint").alias("m"), ratio.alias("total"))
    known = judged.select(F.inline("bins"))
    bins = known.unionAll(rare).groupBy("bin").agg(F.sum("m").alias("m"), F.sum("total").alias("total")).orderBy("bin").toPandas()
    m, w = bins["m"].to_numpy(np.float64), 0.5  # at most 2 * _FAR * FINE + 1 bins
    ratio = 10.0 ** (bins["total"].to_numpy() / m)
    for _ in range(50):
        w = float((m * (w / (w + (1 - w) * ratio))).sum() / m.sum())
    return min(max(w, 0.01), 1.0)


def _share_of_attention(train: DataFrame, text: str, counts: DataFrame, total: int, path: str, shared) -> float:
    """Weight of the attention model in the mix, fitted on texts that have not been judged yet."""
    return _fitted(_judged(train, [], text, F.lit(True), total, 0, path, shared), counts, total)


def _mixed(judged: DataFrame, weight: float) -> DataFrame:
    """``judged`` with ``score``, the log10 probability of the known words by the mix, in place of their ratios."""
    rest = [c for c in judged.columns if c not in ("own", "ratios", "bins", "word", "chances", "learnt")]
    source = judged.select(*rest, "own", "ratios")
    names = [*rest, "score"]

    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(divide="ignore"):
            own, other = np.log(weight), np.log(1 - weight)
        for batch in batches:
            more = [
                float(np.logaddexp(own, other + np.frombuffer(r.as_buffer(), np.float32) * math.log(10)).sum()) / math.log(10)
                for r in batch.column(len(rest) + 1)
            ]
            score = batch.column(len(rest)).to_numpy() + np.array(more)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(score, pa.float64())], names=names)

    return source.mapInArrow(mix, T.StructType([*judged.select(*rest).schema.fields, T.StructField("score", T.DoubleType())]))


def score_texts(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None,
    vocabulary_file: str | None = None, sample: int = SAMPLE, known: int = WORDS,
) -> DataFrame:
    """One row per input row: ``keep``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Learns from rows whose crc32 of the id is not 0 modulo 10 (null ids as empty
    text). Tokens are words, lower-cased A-Z, and one end per text; null and empty
    texts are one end. ``base_score`` sums log10((c + 0.1) / (N + 0.1 (V + 1))) with
    exact counts, and ``score`` mixes with shares by exact counts: those of the ``known``
    most frequent words go to every task, those of other words are joined. Repeated rows score alike and count each. Without
    training rows the weights are the starting ones. No rows in, no rows out.
    """
    keep = keep or [doc_id]
    spark = docs.sparkSession
    path = vocabulary_file or vocabulary_path(VOCABULARY)
    begins = np.append(Subwords(path).begins_word(), True)
    size = len(begins)  # one id more than the vocabulary's stands for the end

    train = docs.where(crc_mod(doc_id, FOLDS) != 0)
    counts = materialize(_counted(train, text))
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train, n_types = totals["n"], totals["v"]
    vocabulary = Vocabulary.of(_id_counts(counts, path, size), begins)

    known_words = spark.sparkContext.broadcast((vocabulary, *_spelled(_frequent(counts, known), path, vocabulary)))

    ids = train.select(F.col(doc_id).alias("chosen")).where(F.col("chosen").isNotNull()).orderBy(F.xxhash64("chosen"), "chosen").limit(sample)
    picked = train.join(F.broadcast(ids.distinct()), F.col(doc_id) == F.col("chosen")).groupBy("chosen").agg(F.max(text).alias(text)).select(text)
    start = _warmed_up(picked, sample, path, known_words)
    model = _trained(train, text, start, path, None, None, None, known_words)
    shared = Shared(spark.sparkContext.broadcast(model.flat), known_words)
    source = docs.select(*keep, F.col(doc_id).alias("__id"), text)
    judged = _judged(source, [*keep, "__id"], text, crc_mod("__id", FOLDS) != 0, n_train, n_types, path, shared)
    mixed = _fitted(judged, counts, n_train)
    floor = n_train + 0.1 * (n_types + 1)
    rare = judged.select("row", F.inline(F.arrays_zip("word", "chances")))
    log10 = F.log10((F.coalesce("n", F.lit(0)) + 0.1) / floor)
    m, log_share = F.size("chances"), F.log10(F.col("n") * F.lit((1 - mixed) / max(1, n_train)))  # null: no share

    def mix(chance: Column) -> Column:
        own = chance + F.lit(math.log10(mixed))
        both = F.greatest(own, log_share) + F.log1p(F.pow(F.lit(10.0), -F.abs(own - log_share))) / math.log(10)
        return F.coalesce(both, own)

    joined = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(m * log10).alias("rare_base"), F.sum(F.when(F.col("n") > 0, m).otherwise(0)).alias("rare_known"),
        F.sum(F.aggregate("chances", F.lit(0.0), lambda total, c: total + mix(c))).alias("rare_score"),
    )
    whole = _mixed(judged, mixed).join(joined, "row", "left")
    return whole.select(
        *keep,
        (crc_mod("__id", FOLDS) == 0).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )
