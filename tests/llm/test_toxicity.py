"""The grammar of toxic clauses: composition, threats, reported speech, the learnt lexicon and scale."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostgauge.llm import toxicity

LEXICON = toxicity.Lexicon({"idiot": 4.0, "dumb": 4.0}, {"clow": 3.0})


def weight(text):
    return sum(toxicity.clause_weights(text, LEXICON))


def test_machine_reads_as_its_five_parts_side_by_side():
    rng, parts, machine = random.Random(1), toxicity.parts(), toxicity.grammar()
    outcomes = collections.Counter()
    for _ in range(2000):
        states, state = [0] * len(parts), 0
        for _ in range(rng.randrange(1, 15)):
            symbol = read = rng.choice(toxicity.SYMBOLS)
            factor = 1.0
            for i, part in enumerate(parts):
                states[i], read, f = part.step(states[i], read)
                factor *= f
            state, written, together = machine.step(state, symbol)
            assert (written, together) == (read, pytest.approx(factor))
            outcomes[symbol, written, together] += 1
        assert machine.final[state] == math.prod(p.final.get(s, 1.0) for p, s in zip(parts, states))
        assert (state in machine.inside) == any(s in p.inside for p, s in zip(parts, states))
    for i, part in enumerate(parts):  # no part is idle: without it some word weighs differently
        others = [p for k, p in enumerate(parts) if k != i]
        assert any(without_part(others, rng) for _ in range(500)), i
    assert len({k[2] for k in outcomes if k[0] == toxicity.INSULT}) > 3


def without_part(others, rng):
    symbols = [rng.choice(toxicity.SYMBOLS) for _ in range(8)]

    def read(parts):
        states, total = [0] * len(parts), []
        for symbol in symbols:
            factor = 1.0
            for i, part in enumerate(parts):
                states[i], symbol, f = part.step(states[i], symbol)
                factor *= f
            total.append((symbol, factor))
        return total, math.prod(p.final.get(s, 1.0) for p, s in zip(parts, states))

    return read(others) != read(toxicity.parts())


@pytest.mark.parametrize(
    "text, want",
    [
        ("I will kill you", 2.5), ("we will murder you all tonight", 2.5), ("ich werde dich umbringen", 2.5), ("te voy a matar", 2.5),
        ("kill time while you wait", 0), ("to kill. you", 0), ("kill\nyou", 0), ("I will not kill you", 0.625),
        ("he said he will kill you", 1.25), ('"I will kill you", he wrote', 1.25),
    ],
)
def test_a_threat_is_a_verb_that_meets_its_victim(text, want):
    assert weight(text) == want


@pytest.mark.parametrize(
    "text",
    ["he said you idiot", "he said: you idiot", 'he said: "you idiot"', '"you idiot", he said', '"You idiot!" he said.',
     "you idiot, he said", "\u201eyou idiot\u201c, sagte er", "\u00abyou idiot\u00bb, the man wrote"],
)
def test_reported_speech_weighs_half_in_both_directions(text):
    assert weight(text) == weight("you idiot") / 2 == 2.5


def test_reported_speech_ends():
    assert weight("he said so. You idiot") == 5
    assert weight('he said "well", you idiot') == 5
    assert weight('he said: "well. You idiot" and') == 2.5  # a sentence's end inside the quotation
    assert weight('"so. You idiot') == 5 and weight('a stray " said he\nyou idiot') == 5
    assert weight("dumb idiot") == 4 + 4 * 1.25 and weight("dumb, idiot") == 9  # no word between


def test_lexicon_by_recount(spark):
    rng = random.Random(2)
    plain = [f"{a}{b}" for a in "barnelso" for b in ("umple", "anto", "ik")]
    rows = []
    for i in range(120):
        words = rng.choices(plain, k=8)
        if i % 3 == 0:
            words += rng.choices(["grobian", "grobians", "you"], k=2)
        rows.append((" ".join(words).title(), int(i % 3 == 0)))
    rows += [(None, 0), ("", 1), ("you " * 3, 1)]
    seen = {0: collections.Counter(), 1: collections.Counter()}
    for text, label in rows:
        found = set(re.findall(r"[^\W_]+", (text or "").lower()))
        seen[label].update(found | {w[:n] + "*" for w in found for n in (4, 5, 6) if len(w) > n})
    n = collections.Counter(label for _, label in rows)
    want = {}
    for entry, k in seen[1].items():
        odds = math.log((k + 0.5) / (seen[0][entry] + 0.5) * ((n[0] + 1) / (n[1] + 1)))
        if k >= toxicity.SEEN and odds >= toxicity.HEAVY and entry not in toxicity.TARGETS:
            want[entry] = odds
    got = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, label int").repartition(5))
    assert {**got.words, **{k + "*": v for k, v in got.stems.items()}} == pytest.approx(want)
    assert {"grobian", "grob*"} <= want.keys() and "you" not in want


def test_threats_are_toxic_though_no_labelled_row_holds_one(spark):
    texts = ["plain words here", "you idiot", "I will kill you", "we will murder you all tonight", "to kill time", "I will not kill you",
             "he said he will kill you", None, "", "plain words " * 200_000]
    texts = [(i, t) for i, t in enumerate(texts)]
    filling = [(100 + i, "you idiot" if i % 4 == 0 else "plain words") for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in filling], "doc_id bigint, toxic int")
    docs = spark.createDataFrame(texts + filling, "doc_id bigint, text string").withColumn("score", F.lit("clash"))
    rows = toxicity.score_toxicity(docs, labels).where("doc_id < 100").orderBy("doc_id").collect()
    assert [r.predicted for r in rows] == [0, 1, 1, 1, 0, 0, 0, 0, 0, 0]


def test_rows_with_threats_move_their_scale():
    x = np.array([[0, 0, 0, 2.5], [0, 0, 0, 0]])
    assert toxicity.learn_scale(x, np.array([0.0, 0.0]), np.array([50.0, 50.0])).score([0, 0, 0, 2.5]) < 0.3
    assert toxicity.learn_scale(x, np.array([1.0, 0.0]), np.array([50.0, 50.0])).score([0, 0, 0, 2.5]) > 0.9
