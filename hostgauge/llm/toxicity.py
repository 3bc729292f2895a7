"""Toxicity scores from a weighted finite-state grammar over clauses.

Words and marks are read as classes: insult, threat, target, possible victim, negation,
reporting word, quotation mark, comma, end of sentence, other. Five small transducers
read them one after the other, each what the one before wrote; their composition is one
machine. Negation weakens an insult that follows closely and marks a threat as denied.
The threat transducer writes a threat only where the verb meets its victim, so that
"kill time" is none. Insults in a row weigh more each. The target one remembers whether
somebody is addressed. The reporting one lowers what stands in reported speech, after
the reporting word (with or without colon and quotation marks, until these close) or
before it. A clause's weights of insults and of threats are the sums along its path.

Which words are insults, and how heavy, is learnt from the labelled rows; so are the
steps from clause weights to probabilities, of insults and of threats apart. Threats are
rare, so that step starts from a fixed one and the rows that hold a threat move it.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hostgauge.llm.common import crc_mod, map_texts
from hostgauge.llm.quality import training_rows

TRAINING_ROWS = 60_000  # labelled rows learnt from, at most
LEXICON = 20_000  # learnt entries, at most (heaviest first)
SEEN, HEAVY = 4, 3.0  # an entry was in this many toxic rows, and has this log-odds, at least
STEMS = (4, 5, 6)  # lengths of word beginnings that are entries too
REACH = 3  # words that a negation reaches
VERB_TO_VICTIM, VICTIM_TO_VERB = 2, 3  # steps from a threat's verb to its victim ("kill all you"), and the other way ("te voy a matar")
SPEAKER = 3  # words from the end of a speech to its reporting word ("..., the man said")
THREAT_WEIGHT = 2.0  # of a threat that nothing weakens
PRIOR = np.array([2.0, -3.0])  # log-odds of a threat: per weight, and constant, before any row is seen
THRESHOLD = 0.7

# Words of the closed classes in the four languages of the tables, and a few threats.
TARGETS = frozenset("you your yours u he she they them him her du dich dir ihr euch sie tu toi vous te tú usted ustedes".split())
VICTIMS = frozenset("you your u them him her dich dir euch toi vous te".split())  # those that can be threatened
NEGATIONS = frozenset("not never isn aren wasn don doesn won nicht kein keine nie jamais aucun nunca jamás".split())
REPORTING = frozenset("said says quoted wrote claimed called reportedly sagte schrieb dit écrit dijo escribió".split())
THREATS = frozenset("kill murder hurt punch destroy shoot stab umbringen töten tuer matar".split())
QUOTES = frozenset('"\u201c\u201d\u201e\u00ab\u00bb')
ENDS = frozenset(".!?;")

SYMBOLS = INSULT, THREAT, TARGET, VICTIM, NEGATION, REPORT, QUOTE, COMMA, END, OTHER = tuple(range(10))  # what is read
DENIED, STRUCK = 10, 11  # what the transducers write besides: a negated threat, a threat that has its victim
ALPHABET = range(12)
WORDS = frozenset({INSULT, THREAT, TARGET, VICTIM, NEGATION, REPORT, OTHER, DENIED, STRUCK})
_WORD = re.compile(r"[^\W_]+")
_TOKEN = re.compile(r'[^\W_]+|[.!?;,"\u201c\u201d\u201e\u00ab\u00bb]')


@dataclass
class Transducer:
    """Reads symbols; ``step(state, symbol)`` gives the next state, the symbol written and a factor of its weight."""

    states: int
    arcs: dict[tuple[int, int], tuple[int, int, float]]  # others: stay, write what was read, factor 1
    final: dict[int, float] = field(default_factory=dict)  # factor for the whole clause; else 1
    inside: frozenset[int] = frozenset()  # states in which the end of a sentence does not end the clause

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        return self.arcs.get((state, symbol), (state, symbol, 1.0))


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Reads as ``a`` does, and ``b`` reads what ``a`` writes; factors multiply."""
    arcs, final, inside = {}, {}, set()
    for i in range(a.states):
        for j in range(b.states):
            s = i * b.states + j
            final[s] = a.final.get(i, 1.0) * b.final.get(j, 1.0)
            if i in a.inside or j in b.inside:
                inside.add(s)
            for symbol in ALPHABET:
                x, written, f = a.step(i, symbol)
                y, out, g = b.step(j, written)
                arcs[s, symbol] = (x * b.states + y, out, f * g)
    return Transducer(a.states * b.states, arcs, final, frozenset(inside))


def negation() -> Transducer:
    """State: words that the last negation still reaches."""
    arcs = {(n, s): (n - 1, s, 1.0) for n in range(1, REACH + 1) for s in WORDS}
    arcs |= {(n, INSULT): (n - 1, INSULT, 0.5) for n in range(1, REACH + 1)}
    arcs |= {(n, THREAT): (n - 1, DENIED, 1.0) for n in range(1, REACH + 1)}
    arcs |= {(n, NEGATION): (REACH, NEGATION, 1.0) for n in range(REACH + 1)}
    arcs |= {(n, END): (0, END, 1.0) for n in range(REACH + 1)}
    return Transducer(REACH + 1, arcs)


def threat() -> Transducer:
    """States: nothing; a verb, or a denied one, looks for its victim; a victim looks for its verb."""
    verb, denied, victim = 0, VERB_TO_VICTIM + 1, 2 * (VERB_TO_VICTIM + 1)  # state of none left, for each

    def waiting(base: int, left: int) -> int:
        return base + left if left else 0

    states = victim + VICTIM_TO_VERB + 1
    arcs: dict[tuple[int, int], tuple[int, int, float]] = {}
    for state in range(states):
        arcs[state, END] = (0, END, 1.0)
        base = victim if state > victim else denied if denied < state < victim else verb
        left = state - base
        for s in WORDS - {THREAT, DENIED, VICTIM}:
            arcs[state, s] = (waiting(base, left - 1) if left else 0, s, 1.0)
        met = base == victim and left > 0
        looks = base != victim and left > 0
        arcs[state, THREAT] = (0, STRUCK, 1.0) if met else (verb + VERB_TO_VICTIM, OTHER, 1.0)
        arcs[state, DENIED] = (0, STRUCK, 0.25) if met else (denied + VERB_TO_VICTIM, OTHER, 1.0)
        arcs[state, VICTIM] = (
            (0, STRUCK, 0.25 if base == denied else 1.0) if looks else (victim + VICTIM_TO_VERB, VICTIM, 1.0)
        )
    return Transducer(states, arcs)


def insult() -> Transducer:
    """State 1: the word before was an insult; another one weighs more."""
    arcs = {(1, s): (0, s, 1.0) for s in WORDS | {END}}
    arcs |= {(0, INSULT): (1, INSULT, 1.0), (1, INSULT): (1, INSULT, 1.25)}
    return Transducer(2, arcs)


def target() -> Transducer:
    """State 1: somebody is addressed."""
    return Transducer(2, {(0, s): (1, s, 1.0) for s in (TARGET, VICTIM, STRUCK)}, {1: 1.25})


def report() -> Transducer:
    """What is said by others: after a reporting word until the sentence or the quotation ends, or before it."""
    direct, reported, reported_quote, quote, late, late_quote, after = range(7)  # ``after`` + 0 ..: words since a speech's end
    arcs = {(s, w): (s, w, 0.5) for s in (reported, reported_quote) for w in (INSULT, STRUCK)}
    arcs |= {
        (direct, REPORT): (reported, REPORT, 1.0), (direct, QUOTE): (quote, QUOTE, 1.0), (direct, COMMA): (after, COMMA, 1.0),
        (reported, QUOTE): (reported_quote, QUOTE, 1.0), (reported_quote, QUOTE): (direct, QUOTE, 1.0),
        (quote, QUOTE): (after, QUOTE, 1.0), (late, QUOTE): (late_quote, QUOTE, 1.0), (late_quote, QUOTE): (late, QUOTE, 1.0),
    }
    for n in range(SPEAKER):
        state = after + n
        following = state + 1 if n + 1 < SPEAKER else direct
        arcs |= {(state, w): (following, w, 1.0) for w in WORDS}
        arcs |= {(state, REPORT): (late, REPORT, 1.0), (state, QUOTE): (quote, QUOTE, 1.0), (state, COMMA): (after, COMMA, 1.0)}
    return Transducer(after + SPEAKER, arcs, {late: 0.5, late_quote: 0.5}, frozenset({reported_quote, quote, late_quote}))


def parts() -> list[Transducer]:
    """In the order in which they read each other."""
    return [negation(), threat(), insult(), target(), report()]


def grammar() -> Transducer:
    return functools.reduce(compose, parts())


_MACHINE = grammar()


@dataclass
class Lexicon:
    words: dict[str, float]
    stems: dict[str, float]

    def weight(self, word: str) -> float:
        found = self.words.get(word)
        if found is not None:
            return found
        return max((self.stems.get(word[:n], 0.0) for n in STEMS if len(word) > n), default=0.0)


_CLOSED = {
    **dict.fromkeys(THREATS, THREAT), **dict.fromkeys(TARGETS, TARGET), **dict.fromkeys(VICTIMS, VICTIM),
    **dict.fromkeys(NEGATIONS, NEGATION), **dict.fromkeys(REPORTING, REPORT), **dict.fromkeys(QUOTES, QUOTE),
    **dict.fromkeys(ENDS, END), ",": COMMA,
}


def clause_parts(text: str | None, lexicon: Lexicon) -> list[tuple[float, float]]:
    """Weights of insults and of threats, of the clauses that hold any. Lines are read apart."""
    low = (text or "").lower()
    words = set(_WORD.findall(low))
    insults = {w: x for w in words - THREATS if (x := lexicon.weight(w)) > 0}
    heavy = insults.keys() | THREATS
    if heavy.isdisjoint(words):
        return []
    out = []
    for line in low.split("\n"):
        tokens = _TOKEN.findall(line)
        if heavy.isdisjoint(tokens):
            continue
        state, insulted, threatened = 0, 0.0, 0.0
        for token in [*tokens, None]:
            if token is not None:
                weight = insults.get(token)
                symbol = INSULT if weight is not None else _CLOSED.get(token, OTHER)
                state, written, factor = _MACHINE.arcs[state, symbol]
                if written == INSULT:
                    insulted += weight * factor
                elif written == STRUCK:
                    threatened += THREAT_WEIGHT * factor
                if symbol != END or state in _MACHINE.inside:
                    continue
            if insulted or threatened:
                last = _MACHINE.final[state]
                out.append((insulted * last, threatened * last))
            state, insulted, threatened = 0, 0.0, 0.0
    return out


def clause_weights(text: str | None, lexicon: Lexicon) -> list[float]:
    """Weights of the clauses that hold an insult or a threat."""
    return [a + b for a, b in clause_parts(text, lexicon)]


N_FEATURES = 4


def clause_features(clauses: list[tuple[float, float]]) -> list[float]:
    """Of insults: the heaviest clause, all of them, whether there is one. Of threats: the heaviest clause."""
    insults = [a for a, _ in clauses if a]
    found = [min(max(insults), 20.0) / 5, min(sum(insults), 100.0) / 20, 1.0] if insults else [0.0] * 3
    return [*found, max((b for _, b in clauses), default=0.0)]


@dataclass
class Scale:
    """From features to a probability: toxic by insults or by threats."""

    insults: np.ndarray  # bias last
    threats: np.ndarray

    def score(self, x: list[float]) -> float:
        clean = 1 / (1 + np.exp(np.clip(np.append(x[:3], 1.0) @ self.insults, -30, 30)))
        if x[3]:
            clean /= 1 + np.exp(np.clip(np.array([x[3], 1.0]) @ self.threats, -30, 30))
        return float(1 - clean)


def learn_scale(x: np.ndarray, toxic: np.ndarray, times: np.ndarray) -> Scale:
    """Insults learn from the rows without threats, threats from the rows without insults."""
    calm, threatening = x[:, 3] == 0, (x[:, 3] > 0) & (x[:, 2] == 0)
    insults = learn_step(x[calm, :3], toxic[calm], times[calm]) if calm.any() else np.zeros(4)
    threats = learn_step(x[threatening, 3:], toxic[threatening], times[threatening], PRIOR, 1.0)
    return Scale(insults, threats)


def learn_step(
    x: np.ndarray, toxic: np.ndarray, times: np.ndarray, start: np.ndarray | None = None, ridge: float = 0.1
) -> np.ndarray:
    """Logistic regression (bias last) of rows that count ``times`` each, by Newton steps; ``ridge`` pulls to ``start`` (0)."""
    z = np.hstack([x, np.ones((len(x), 1))])
    start = np.zeros(z.shape[1]) if start is None else start
    w = start.copy()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (times * (toxic - p)) - ridge * (w - start)
        bend = (z * (times * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(bend, slope), -3, 3)
    return w


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Entries from ``text`` and ``label``: how many toxic and other rows hold a word, or a word that begins so.

    A task adds up its rows before it hands counts on; only the heaviest entries come to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def out():
            for label, c in counts.items():
                if c:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(c)), pa.array([v * label for v in c.values()], pa.int64()),
                         pa.array([v * (1 - label) for v in c.values()], pa.int64())],
                        names=["entry", "toxic", "other"],
                    )
                    c.clear()

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                found = set(_WORD.findall((text.as_py() or "").lower()))
                stems = {w[:n] + "*" for w in found for n in STEMS if len(w) > n}
                c = counts[1 if label == 1 else 0]
                c.update(found)
                c.update(stems)
                if len(c) > 500_000:
                    yield from out()
        yield from out()

    totals = rows.agg(F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") != 1).alias("other")).first()
    counted = rows.select("text", "label").mapInArrow(count, "entry string, toxic bigint, other bigint")
    odds = F.log((F.col("toxic") + 0.5) / (F.col("other") + 0.5) * ((totals["other"] + 1) / (totals["toxic"] + 1)))
    heavy = (
        counted.groupBy("entry")
        .agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        .select("entry", "toxic", "other", odds.alias("weight"))
        .where((F.col("toxic") >= SEEN) & (F.col("weight") >= HEAVY))
        .orderBy(F.desc("weight"), "entry")
        .limit(LEXICON)
        .collect()
    )
    closed = TARGETS | NEGATIONS | REPORTING
    entries = {r["entry"]: r["weight"] for r in heavy if r["entry"] not in closed}
    stems = {e[:-1]: w for e, w in entries.items() if e.endswith("*")}
    return Lexicon({e: w for e, w in entries.items() if not e.endswith("*")}, stems)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None,
    training: int = TRAINING_ROWS,
) -> DataFrame:
    """One row per input row: ``keep``, ``held_out``, ``score`` (0 to 1), ``predicted`` (score >= 0.7).

    Learnt from at most ``training`` labelled rows outside the held-out fold. Texts
    are read whole; null and empty ones have no clause and score like clean ones.
    Repeated rows score alike. Without toxic labels the lexicon is empty and only
    threats tell rows apart; without labels at all a text that holds neither scores 0.5. No rows in, no rows out.
    """
    keep = keep or [doc_id]
    rows = training_rows(docs, labels, "toxic", text, doc_id, training)
    lexicon = learn_lexicon(rows)
    # an entry that a row itself brought in would flatter that row: the entries hold many rows each, so this is small
    seen = map_texts(rows, ["label"], ["text"], "x array<double>", lambda t: (clause_features(clause_parts(t, lexicon)),))
    shapes = seen.groupBy("label", "x").count().collect()  # few distinct shapes: most rows have no clause
    x = np.array([r["x"] for r in shapes]).reshape(-1, N_FEATURES)
    order = np.lexsort([*x.T, [r["label"] for r in shapes]]) if len(x) else []
    n = np.array([r["count"] for r in shapes], float)
    y = np.array([r["label"] for r in shapes], float)
    scale = learn_scale(x[order], y[order], n[order])

    def judge(t):
        score = scale.score(clause_features(clause_parts(t, lexicon)))
        return score, int(score >= THRESHOLD)

    kept = docs.select(*keep, F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    scored = map_texts(kept, [*keep, "__id"], ["__text"], "score double, predicted int", judge)
    return scored.select(*keep, (crc_mod("__id", 3) == 1).alias("held_out"), "score", "predicted")
