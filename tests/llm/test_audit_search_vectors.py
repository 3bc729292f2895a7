"""Filter audit, ranked search and near-duplicate vectors against plain versions."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostgauge.llm import filter_audit, lexical_search, vector_dedup

# -- filter audit ----------------------------------------------------------------------

DOCS = "doc_id bigint, text string, source string, failed string, part string, good string, toxic string, id string"


def audit_docs():
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "beta", "Gamma", "delta"]) + str(rng.randrange(60)) for _ in range(300))
    texts = [
        None, "", " \n\t", long, long, long + " $", "word " * 60, "word " * 60, "ABC DEF", "é" * 30, "x#y", long.upper(),
        " ".join(f"w{i}" for i in range(50)), " ".join(f"w{i}" for i in range(49)), "one\ntwo\x0bthree\x1cfour",
    ]
    rows = [(i, t, [None, "s1", "", "z"][i % 4]) for i, t in enumerate(texts)]
    rows += [(3, long, "s1"), (None, long, "s1"), (None, "", "z"), (99, texts[8], "only here")]
    return [(*r, "c", "c", "c", "c", "c") for r in rows]


def plain_audit(rows, labels):
    smallest = {}
    for i, t, *_ in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    by_part = {}
    for i, t, part, *_ in rows:
        t = t or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and smallest.get(t, i) < i,
        }
        mine = [(q, x) for d, q, x in labels if d == i and i is not None]
        by_part.setdefault(part or "", []).append(
            ({k for k, v in fails.items() if v}, any(q == 1 for q, _ in mine), any(x == 1 for _, x in mine))
        )
    out = []
    for part, docs in by_part.items():
        removed_in_all = Counter()
        mine = []
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                removed_in_all[f] += len(gone)
                mine.append((
                    part, "".join(order), step, len(left), len(gone), sum(f in d[0] for d in docs) - len(gone),
                    sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone), f,
                ))
        out += [(*r[:-1], removed_in_all[r[-1]]) for r in mine]
    return sorted(out)


def test_audit(spark):
    rows = audit_docs()
    labels = [(3, 1, 0), (3, 0, 1), (5, 1, None), (8, None, 1), (None, 1, 1), (77, 1, 1), (1, 1, 0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = filter_audit.audit_documents(docs, marks)
    assert got.schema.simpleString() == "struct<" + ",".join(
        ":".join(c.split()) for c in filter_audit.AUDIT_SCHEMA.split(", ")) + ">"
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, labels)


def test_audit_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    marks = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit_documents(docs, marks).count() == 0
    some = spark.createDataFrame(audit_docs(), DOCS)
    assert sorted(map(tuple, filter_audit.audit_documents(some, marks).collect())) == plain_audit(audit_docs(), [])


def test_packed_fields_do_not_overflow():
    n = 2**40 + 12345
    total = sum(n * filter_audit.packed(f, 5) for f in range(32))
    counts = filter_audit.unpacked(total, 5)
    assert counts.shape == (120, 5)
    assert (counts == n * np.array([16, 8, 4, 2, 1])).all()  # of 32 sets, half fail the first filter, a quarter the second ...


def test_three_filters(spark):
    rows = [("p", f, False, False) for f in range(8)]
    got = filter_audit.interactions(spark.createDataFrame(rows, "part string, failed int, good boolean, toxic boolean"), "XYZ")
    assert got.count() == 18
    assert {tuple(r) for r in got.select("step", "removed", "shapley").collect()} == {(1, 4, 14), (2, 2, 14), (3, 1, 14)}


# -- ranked search ---------------------------------------------------------------------


def plain_terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, top=10):
    bags = [(i, Counter(plain_terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(plain_terms(t))
    out = []
    for item, words in asked.items():
        found = []
        for i, b in bags:
            m = 100 - 90 + (90 * sum(b.values()) * n_docs) // total
            s = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m))
                for t in words if t in b
            )
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r, f[-1], -f[0]) for r, f in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def corpus():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(40)] + ["É", "naïve", "x-ray", "UPPER", "don't", "日本"]
    pick = lambda: words[min(int(rng.expovariate(0.12)), len(words) - 1)]
    docs = [(i, " ".join(pick() for _ in range(rng.randrange(1, 60)))) for i in range(400)]
    docs += [(400, None), (401, ""), (402, "..!?"), (403, docs[7][1]), (2, docs[7][1]), (None, docs[7][1]), (404, "w1 " * 30_000)]
    items = [(i, " ".join(pick() for _ in range(rng.randrange(1, 15)))) for i in range(25)]
    items += [(25, None), (26, "!!"), (27, "absent"), (3, "w39 naïve"), (None, "w5 w6"), (28, docs[7][1]), (29, "w0 w1 w2 w3 w4")]
    return docs, items


@pytest.mark.parametrize("pairs", [200_000, 12])
def test_search(spark, pairs):
    docs, items = corpus()
    d = spark.createDataFrame([(*r, "c", "c") for r in docs], "doc_id bigint, text string, n string, score string").repartition(5)
    q = spark.createDataFrame([(*r, "c") for r in items], "item_id bigint, text string, rank string")
    got = lexical_search.search(d, q, pairs=pairs)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_search(docs, items)


def test_search_empty(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    q = spark.createDataFrame([], "item_id bigint, text string")
    some_d, some_q = spark.createDataFrame([(1, "a b")], d.schema), spark.createDataFrame([(1, "a")], q.schema)
    for x, y in ((d, q), (some_d, q), (d, some_q), (spark.createDataFrame([(1, None)], d.schema), some_q)):
        assert lexical_search.search(x, y).collect() == []


def test_accumulators_are_limited_and_scores_exact(spark):
    """Frequent terms make no accumulators, yet the best documents have their whole scores."""
    rng = np.random.default_rng(4)
    n_docs, n_terms = 3000, 12
    held = rng.random((n_docs, n_terms)) < np.linspace(0.01, 0.9, n_terms)
    tf = np.where(held, rng.integers(1, 9, held.shape), 0)
    term, tfs = [np.flatnonzero(r) for r in held], [r[r > 0] for r in tf]
    n = np.maximum(tf.sum(1), 1)
    df = held.sum(0)
    weights = np.array([lexical_search.weight(n_docs, int(d)) for d in df])
    ends = np.concatenate([[0], np.cumsum([len(t) for t in term])])
    shard = lexical_search.Shard(
        list(range(n_docs)), n, ends, np.concatenate(term), np.concatenate(tfs), weights, n_docs, int(n.sum())
    )
    item = np.argsort(df)
    m = 10 + 90 * n * n_docs // n.sum()
    score = (weights * np.where(tf > 0, 10**9 * tf // (1000 * tf + 8 * m[:, None]), 0)).sum(1)
    found, scores = shard.best(item, 10)
    assert (scores == score[found]).all()
    assert set(np.argsort(-score, kind="stable")[:10]) <= set(found.tolist())
    # with a floor as high as the best score nothing else is even looked at
    assert shard.best(item, 10, int(score.max()) + 1)[0].size == 0


# -- near-duplicate vectors ------------------------------------------------------------


def plain_links(ids, vectors, threshold=0.9):
    def valid(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(ids)
    units = [None if not valid(v) else np.array(v, float) / np.linalg.norm(np.array(v, float) / np.abs(v).max()) / np.abs(v).max() for v in vectors]
    linked = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]):
                linked[i, j] = units[i] @ units[j] >= threshold
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], n).min(1))
        if (new == label).all():
            break
        label = new
    least = {}
    for i, r in zip(ids, label.tolist()):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted(
        ((i, int(k), least.get(r), i == least.get(r)) for i, k, r in zip(ids, linked.sum(1), label.tolist())), key=str
    )


def near(rng, x, cos):
    off = rng.normal(size=x.shape)
    off -= (off @ x) / (x @ x) * x
    return cos * x / np.linalg.norm(x) + (1 - cos**2) ** 0.5 * off / np.linalg.norm(off)


def odd_vectors():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, near(rng, base[i % 5], 0.97).tolist()) for i in range(60)]
    rows += [(200 + i, (base[7] * 3).tolist()) for i in range(10)]
    rows += [
        (300, None), (301, []), (302, [0.0] * 8), (303, [1.0, None] + [0.0] * 6), (304, [math.nan] + [1.0] * 7),
        (305, [math.inf] + [1.0] * 7), (306, [1.0, 2.0]), (307, [2.0, 4.0]), (308, [-0.0, 3.0]), (309, [0.0, 3.0]),
        (310, [5.0]), (311, [7.0]), (312, [-1.0]), (313, [1e38] * 8), (314, [1e-30] * 8),
        (5, base[5].tolist()), (None, base[5].tolist()), (None, [9.0, -1.0, 0.5, 2.0, 2.0, 2.0, 2.0, 2.0]), (None, None),
    ]
    return rows


@pytest.mark.parametrize("kind, block, chunk", [("double", 1024, 8192), ("float", 4, 3)])
def test_near_vectors(spark, kind, block, chunk):
    rows = odd_vectors()
    if kind == "float":
        rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(*r, "c", "c") for r in rows], f"vec_id bigint, embedding array<{kind}>, n string, node string")
    got = vector_dedup.near_vectors(df.repartition(3), block=block, chunk=chunk)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = plain_links([i for i, _ in rows], [v for _, v in rows])
    want = [(i, n, None if i is None and n == 0 else c, k if i is not None or n else True) for i, n, c, k in want]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_recall_at_the_threshold(spark):
    """Links just above the threshold in random directions, and a large group of near copies."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(2500, 64))
    rows = [*base, *[near(rng, b, 0.902) for b in base[:600]], *[near(rng, base[0], 0.96) for _ in range(900)]]
    rows = np.array(rows, np.float32)[rng.permutation(len(rows))]
    x = vector_dedup.unit(rows)
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id bigint, embedding array<float>")
    got = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_vectors(df.repartition(4), block=256, chunk=200).collect()}
    found, there = np.array([got[i] for i in range(len(rows))]), linked.sum(1)
    assert (found <= there).all()
    single = there < 10
    assert found[single].sum() >= 0.9 * there[single].sum()
    assert found.sum() >= 0.95 * there.sum()


def test_visits_are_all_cells_within_the_budget():
    rng = np.random.default_rng(6)
    x = vector_dedup.unit(rng.normal(size=(500, 10)))
    index = vector_dedup.fit(x, 100_000)
    assert len(index.first) > 10
    a, b = index.excess(x)
    home, visits = index.visits(x)
    for i in range(len(x)):
        near_by = np.flatnonzero((a[i][:, None] + b[i][None, :]).ravel() <= index.budget)
        assert set(near_by.tolist()) - {home[i]} == set(visits[i].tolist())


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert vector_dedup.near_vectors(none).count() == 0
    bad = spark.createDataFrame([(1, None), (2, [0.0])], none.schema)
    assert sorted(map(tuple, vector_dedup.near_vectors(bad).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
