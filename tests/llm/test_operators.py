"""Each operator against a plain version of itself, and on nulls, empty and long texts, ties and empty tables."""

import collections
import hashlib
import itertools
import json
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hostgauge.llm.common import window_hashes
from hostgauge.llm import exact_dedup, html_extract, line_dedup, lm, mixing, packing, quality, simhash, sketches, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, size string, score string, row string"
WORDS = [a + b for a in ("the", "an", "re", "tion", "sh", "ó") for b in ("", "ed", "ou", "wh", "ble")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def some_docs():
    rng = random.Random(1)
    base = prose(rng, 120)
    words = base.split()
    near = [" ".join([*words[:i], "changed", *words[i + 1 :]]) for i in (3, 60, 118)]
    texts = [
        None, "", " \n\t", base, base.upper(), *near, base, "one", "one two three", "A\nB\nC\nD", "x\nA\nB\nC\ny", "É é",
        prose(rng, 30_000), prose(rng, 700), "z" * 20_000, "line a\nline b\nline c\nline d\n", "line a\nline b\nline c\nline d\n",
        "q\nq\nq\nq\nq\nq", "tail   of  spaces     and <|endoftext|> 12345 it's 你好 🙂",
    ]
    rows = [(i, t, "en", [None, "s1", "é", "z"][i % 4], 0, "c", "c", "c", "c") for i, t in enumerate(texts)]
    return rows + [rows[9], (None, base, "en", "s1", 0, "c", "c", "c", "c"), (None, "one", None, None, 0, "c", "c", "c", "c")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(some_docs(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(t):
    return (t or "").encode().lower().split()


def test_simhash_by_definition():
    for text in ("a b c d e f g a b c d", "one two", "É x Y z W", prose(random.Random(2), 70_000)):
        w = split(text)
        grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
        votes = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
        assert simhash.simhash(text) % 2**64 == sum((2 * v > len(grams)) << b for b, v in enumerate(votes))
    assert simhash.simhash(None) == simhash.simhash(" \n") == 0


def test_simhash_classes(docs, empty):
    rows = [(r[0], simhash.simhash(r[1]) % 2**64) for r in some_docs()]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(rows):
            for j, (_, b) in enumerate(rows):
                if (a ^ b).bit_count() <= 4 and label[j] > label[i]:
                    label[j], changed = label[i], True
    ids = collections.defaultdict(list)
    for (doc, _), c in zip(rows, label):
        ids[c] += [doc] if doc is not None else []
    want = collections.Counter((d, f"{f:016x}", min(ids[c], default=None)) for (d, f), c in zip(rows, label))
    assert collections.Counter(tuple(r) for r in simhash.near_classes(docs).collect()) == want
    assert simhash.near_classes(empty).count() == 0


@pytest.mark.parametrize("block", [4, 1024])
def test_near_links_join_up_all_pairs(spark, block):
    rng = random.Random(3)
    fps = set()
    for _ in range(40):
        centre = rng.getrandbits(64)
        fps |= {centre}
        for _ in range(12):
            x = rng.choice([centre, *list(fps)[-3:]])
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), block).collect()
    assert all(True for _ in links)

    def classes(pairs):
        parent = {f: f for f in signed}

        def find(f):
            while parent[f] != f:
                parent[f] = parent[parent[f]]
                f = parent[f]
            return f

        for a, b in pairs:
            parent[find(a)] = find(b)
        groups = collections.defaultdict(set)
        for f in signed:
            groups[find(f)].add(f)
        return {frozenset(g) for g in groups.values()}

    near = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) % 2**64).bit_count() <= 4]
    assert classes([(r.a, r.b) for r in links]) == classes(near)


def test_targets():
    assert mixing.targets({}) == {}
    out = mixing.targets({"b": 100, "a": 10, None: 1000})
    assert out["a"] == 20 and out["b"] + out[None] == pytest.approx(1645) and out["b"] == 200
    assert mixing.targets({"a": 5}) == {"a": 7.5}


def test_fit_reaches_what_can_be_reached():
    rng = np.random.default_rng(4)
    for _ in range(60):
        sizes = np.unique(rng.integers(0, 40, 6))
        counts = rng.integers(1, 5, len(sizes))
        budget = int(rng.integers(0, (sizes * counts).sum() + 5))
        taken = mixing.fit(sizes, counts, budget)
        assert (taken >= 0).all() and (taken <= counts).all() and (sizes * taken).sum() <= budget
    sizes, counts = np.arange(1, 2000), np.full(1999, 30)
    for budget in (123_457, 40_000_001):
        assert (mixing.fit(sizes, counts, budget) * sizes).sum() == budget


def test_mix(docs, empty):
    rows = mixing.mix(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.size) for r in rows if r.doc_id is not None) == sorted(
        (False, r[0], len(split(r[1]))) for r in some_docs() if r[0] is not None
    )
    assert all(0 <= r.copies <= 2 and r.taken == r.size * r.copies for r in rows)
    by = collections.Counter()
    for r in rows:
        by[r.target] += r.taken
    assert all(taken <= target + 1 for target, taken in by.items())
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mix(empty).count() == 0


def test_hot_length_is_drawn_exactly(spark):
    many = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    rows = mixing.mix(many).groupBy("copies").count().collect()
    assert {r["copies"]: r["count"] for r in rows} == {1: 2500, 2: 2500}


def test_chunks_make_up_the_text():
    rng = random.Random(5)
    data = prose(rng, 20_000).encode()
    parts = exact_dedup.chunks(data)
    assert b"".join(parts) == data and all(256 <= len(p) <= 8192 for p in parts[:-1])
    moved = exact_dedup.chunks(b"prefix " * 9 + data)
    assert len(set(parts) & set(moved)) > 0.9 * len(parts)
    assert exact_dedup.chunks(b"") == [] and max(map(len, exact_dedup.chunks(b"z" * 50_000))) <= 8192


@pytest.mark.parametrize("id_bytes", [1, 16])
def test_exact_groups(docs, empty, id_bytes):
    groups = collections.defaultdict(list)
    for r in some_docs():
        groups[(r[1] or "").encode().lower()].append(r[0])
    want = collections.Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), i == keep, hashlib.sha256(text).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in exact_dedup.exact_groups(docs, id_bytes=id_bytes).collect()) == want
    assert exact_dedup.exact_groups(empty).count() == 0


PAGES = [
    ("<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a>"
     "</ul></nav><div class='cookie-notice'>We use cookies on this page, please accept them all.</div><main><article><header><h2>Head"
     "line</h2></header><p>First  &amp; long\nparagraph of the text, with some words.<p>Short.</p><div class=ad>Buy now!</div><ul><li>item "
     "one</li><li>item two</li></ul></article><section id=comments><p>Nice post, I agree with all of it.</p></section></main><aside>"
     "<p>Related things to read.</p></aside><form><p>Sign up</p><input></form><script>var a='<p>no</p>'</script><footer>&copy; me</footer>",
     "Headline First & long paragraph of the text, with some words. Short. item one item two"),
    ("<p>Only a paragraph with <b>bold</b>ness &#233;", "Only a paragraph with boldness é"),
    ("plain text, no markup at all", "plain text, no markup at all"),
    ("", ""), (None, ""), ("<nav><a href='#'>a</a></nav>", ""), ("<p>1 < 2 and <unclosed \" quote", "1 < 2 and"),
]


def test_main_text(spark):
    got = [html_extract.main_text(p) for p, _ in PAGES]
    assert got == [want for _, want in PAGES]
    table = spark.createDataFrame([(i, "u", p, "clash") for i, (p, _) in enumerate(PAGES)], "page_id bigint, url string, html string, text string")
    rows = html_extract.extract(table).orderBy("page_id").collect()
    assert [(r.text, r.n_chars) for r in rows] == [(w, len(w)) for _, w in PAGES]
    assert html_extract.extract(table.limit(0)).count() == 0
    long = "<article>" + "<p>words of a paragraph, many of them.</p>" * 5000 + "</article>"
    assert html_extract.main_text(long).count("paragraph") == 5000


def test_minimum_cut_is_minimal():
    rng = random.Random(6)
    for _ in range(40):
        n = rng.randrange(1, 8)
        s, t = [rng.randrange(9) for _ in range(n)], [rng.randrange(9) for _ in range(n)]
        edges = [(i, j, rng.randrange(5)) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(side):
            return sum(t[i] if side[i] else s[i] for i in range(n)) + sum(c for i, j, c in edges if side[i] != side[j])

        best = min(cost([m >> i & 1 for i in range(n)]) for m in range(2**n))
        assert cost(html_extract.minimum_cut(list(map(float, s)), list(map(float, t)), edges)) == pytest.approx(best)


def test_pairs_teach_a_ranking(docs, empty, spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, len(quality.FEATURES)))
    good = (x[:, 0] - x[:, 3] > -1).astype(int)
    model = quality.learn(x, good)
    assert ((model.score(x) >= 0.5) == good).mean() > 0.95
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(12)] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    for rows in (quality.score_quality(docs, labels).collect(), toxicity.score_toxicity(docs, labels).collect()):
        assert len(rows) == len(some_docs()) and all(0 <= r.score <= 1 for r in rows)
        assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1) for r in rows)
    none = quality.score_quality(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and {r.predicted for r in none} == {1}
    assert toxicity.score_toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert quality.score_quality(empty, labels).count() == toxicity.score_toxicity(empty, labels).count() == 0


def read(name, columns):
    import duckdb

    return duckdb.sql(f"SELECT {columns} FROM '/root/testdata/sf0.1/{name}.parquet'").fetchall()


@pytest.mark.parametrize("label, least", [("quality", 0.98), ("toxic", 0.96)])
def test_held_out_accuracy(spark, label, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = (quality.score_quality if label == "quality" else toxicity.score_toxicity)(docs, labels)
    held = scored.where("held_out").join(labels, "doc_id").select((F.col(label) == F.col("predicted")).cast("int").alias("right"))
    assert held.agg(F.avg("right")).first()[0] >= least


def test_line_windows(docs, empty):
    rows = sorted((r for r in some_docs() if r[0] is not None), key=lambda r: r[0])
    distinct = list(dict.fromkeys((r[0], r[1] or "") for r in rows))
    first, gone = {}, collections.defaultdict(set)
    for doc, text in distinct:
        lines = text.split("\n")
        for i in range(len(lines) - 2):
            if first.setdefault(tuple(lines[i : i + 3]), (doc, i)) != (doc, i):
                gone[doc] |= {i, i + 1, i + 2}
    want = collections.Counter()
    for r in rows:
        lines = (r[1] or "").split("\n")
        want[r[0], len(lines), len(gone[r[0]]), "\n".join(x for i, x in enumerate(lines) if i not in gone[r[0]])] += 1
    got = line_dedup.without_repeated_windows(docs.where("doc_id IS NOT NULL")).collect()
    assert collections.Counter(tuple(r) for r in got) == want
    assert line_dedup.without_repeated_windows(docs).count() == len(some_docs())
    assert line_dedup.without_repeated_windows(empty).count() == 0


def test_lm_scores(docs, empty):
    rows = lm.score_texts(docs, known=20).collect()
    counts = collections.Counter()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    for r in some_docs():
        if not held(r[0]):
            counts.update([*split(r[1]), b"\n"])
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter()
    for r in some_docs():
        w = [*split(r[1]), b"\n"]
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want[r[0], held(r[0]), len(w), sum(counts[x] > 0 for x in w), n, round(base, 4)] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    by_text = collections.defaultdict(set)
    texts = {r[0]: r[1] for r in some_docs() if r[0] is not None}
    for r in rows:
        if r.doc_id is not None:
            by_text[(texts[r.doc_id] or "").encode().lower()].add(round(r.score, 3))
    assert all(len(s) == 1 for s in by_text.values())
    assert lm.score_texts(empty).count() == 0


def test_lm_scores_do_not_depend_on_how_many_words_every_task_knows(docs):
    few, all_of = (
        sorted((r.doc_id is not None, r.doc_id, r.n_tokens, r.base_score, r.score) for r in lm.score_texts(docs.coalesce(1), known=k).collect())
        for k in (5, lm.WORDS)
    )
    assert [r[:3] for r in few] == [r[:3] for r in all_of]
    assert np.allclose([r[3:] for r in few], [r[3:] for r in all_of], rtol=1e-5)


def test_lm_mix_is_fitted_on_all_training_words(spark):
    from hostgauge.llm.attention import Attention, Vocabulary
    from hostgauge.llm.subwords import Subwords, vocabulary_path

    path = vocabulary_path(lm.VOCABULARY)
    begins = np.append(Subwords(path).begins_word(), True)
    rng = random.Random(4)
    texts = [prose(rng, rng.randrange(1, 400)) for _ in range(60)] + [None, "once", "zz zz"]
    train = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    counts = lm._counted(train, "text").cache()
    exact = {bytes(r.word): r.n for r in counts.collect()}
    total = sum(exact.values())
    vocabulary, model = Vocabulary.of(lm._id_counts(counts, path, len(begins)), begins), Attention()
    few = {w: exact[w] for w in sorted(exact, key=exact.get)[-7:]}
    speller = lm.Speller(path, vocabulary, few)
    shared = spark.sparkContext.broadcast((model.flat, vocabulary, few, speller.ready()))
    got = lm._share_of_attention(train, "text", counts, total, path, shared)
    documents = [[*split(t), lm.END] for t in texts]
    p = 10.0 ** lm.Scorer(speller, model).score(documents)[0]
    q, w = np.array([(exact[x] - 1) / total for d in documents for x in d]), 0.5
    for _ in range(50):
        w = np.mean(w * p / (w * p + (1 - w) * q))
    assert got == pytest.approx(max(w, 0.01), rel=1e-4)


def test_lm_scores_every_text_once_and_mixes_what_is_stored(spark):
    from pyspark.sql import types as T

    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randrange(0, 120))) for i in range(40)] + [(40, None), (41, "once"), (42, "")]
    reads = spark.sparkContext.accumulator(0)

    def read(t):
        reads.add(1)
        return t

    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3, "doc_id").withColumn("text", F.udf(read, T.StringType())("text"))
    got = lm.score_texts(docs, known=9).collect()
    train = sum(not r.held_out for r in got)
    # read to count words, to draw runs, to train and to be scored: fitting the mix takes no pass of its own
    assert 0 < train < len(rows) and reads.value <= 3 * train + len(rows)
    assert sorted(r.doc_id for r in got) == list(range(43))

    judged = spark.createDataFrame([(1, -7.5, np.array([-1.0, 2.0, 0.5], np.float32).tobytes()), (2, 0.0, b"")], "row bigint, own double, ratios binary")
    want = -7.5 + sum(math.log10(0.7 + 0.3 * 10.0**r) for r in (-1, 2, 0.5))
    assert [r.score for r in lm._mixed(judged, 0.7).orderBy("row").collect()] == pytest.approx([want, 0.0])
    assert [r.score for r in lm._mixed(judged, 1.0).orderBy("row").collect()] == pytest.approx([-7.5, 0.0])


def test_lm_learns_from_every_word(spark):
    from hostgauge.llm.attention import HIDDEN, Attention, Vocabulary
    from hostgauge.llm.subwords import Subwords, vocabulary_path

    path = vocabulary_path(lm.VOCABULARY)
    begins = np.append(Subwords(path).begins_word(), True)
    vocabulary = Vocabulary.of(np.arange(len(begins))[::-1].copy(), begins)
    text = ["the", "of", "and", "to"] * 1200
    speller = lm.Speller(path, vocabulary, {})
    start = Attention()

    def weights(words):
        train = spark.createDataFrame([(" ".join(words),)], "text string")
        return lm._trained(train, "text", start, path, vocabulary, {}, speller.ready()).flat

    first = weights(text)
    for at in (700, 1599, 2400, 3900, 4799):  # one word anywhere changes what is learnt
        assert np.abs(weights([*text[:at], "in", *text[at + 1 :]]) - first).max() > 0, at
    documents = [[*split("a b c d"), lm.END], [lm.END], [*split(" ".join(text)), lm.END]]
    ids = sum(len(speller.spell(speller.look_up(d))[0]) for d in documents)
    assert sum(int(real.sum()) for _, _, real in lm.lessons(speller, documents)) == ids
    assert HIDDEN == 32


def test_attention_gradient_and_causality():
    from hostgauge.llm.attention import PAD, Attention, lay_out

    rng = np.random.default_rng(8)
    runs = [rng.integers(0, PAD, n).astype(np.int32) for n in (40, 5, 16)]
    model = Attention()
    laid = lay_out(runs, [3, 4, 5])
    _, g = model.gradient(*laid)
    for k in np.argsort(-abs(g))[:400:40]:
        old = model.flat[k]
        model.flat[k] = old + 1e-2
        up, _ = model.gradient(*laid)
        model.flat[k] = old - 1e-2
        down, _ = model.gradient(*laid)
        model.flat[k] = old
        assert (up - down) / 2e-2 == pytest.approx(g[k], abs=2e-3)
    all_of = model.log10(*laid, model.scoring())
    assert len(all_of) == 61  # every id once
    changed = runs[0].copy()
    changed[30:] = 7
    part = model.log10(*lay_out([changed], [3]), model.scoring())
    assert np.allclose(part[:30], all_of[:30], atol=1e-5)  # what comes later does not matter
    sure = model.log10(*lay_out([np.array([i], np.int32) for i in range(PAD)], [3] * PAD), model.scoring())
    assert (10.0 ** sure[:, 0]).sum() == pytest.approx(1, abs=1e-3)


def test_grammar_reads_clauses():
    lexicon = toxicity.Lexicon({"idiot": 4.0}, {"clow": 3.0})
    weight = lambda t: sum(toxicity.clause_weights(t, lexicon))
    assert weight("an idiot.") == 4 and weight("You idiot!") == 5 and weight("he said an idiot") == 2.5
    assert weight("never an idiot") == 2 and weight("never. an idiot") == 4 and weight("clowns; idiot") == 7
    assert weight("kill time") == 0 and weight("we will kill you") == 2.5 and weight(None) == 0 == weight("")


def test_sketches(docs, empty):
    rows = sorted(((r[0] is not None, r[0], r[1] or "") for r in some_docs()), key=lambda r: (r[0], r[1] or 0, r[2]))
    got = sketches.edited_likeness(docs, buckets=7).collect()
    want = collections.Counter()
    for k, (_, doc, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][2]
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        want[doc, len(text), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert sketches.edited_likeness(empty).count() == 0
    rng = random.Random(9)
    a, b = prose(rng, 30_000), prose(rng, 3000)
    s, t = sketches.sketch(a), sketches.sketch(b)
    whole = sketches.sketch(a + " " + b)
    assert sketches.containment(t, whole) > 0.97 and sketches.resemblance(s, t) < 0.1
    assert len(np.setxor1d(sketches.merge(s, t), whole)) < 20  # only shingles across the seam differ
    assert (sketches.load(sketches.dump(s)) == s).all()


def test_containment_of_a_text_with_no_small_hash_is_unknown():
    rng = random.Random(10)
    whole = prose(rng, 30_000)
    parts = [whole[a : a + 20] for a in range(0, 4000, 40)]  # five shingles each
    found = [sketches.containment(sketches.sketch(t), sketches.sketch(whole)) for t in parts]
    assert set(found) == {None, 1.0}


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs.withColumn("own", F.monotonically_increasing_id()), keep=["doc_id", "own"]).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.own].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    texts = {r.own: r.text for r in docs.withColumn("own", F.monotonically_increasing_id()).collect()}
    assert set(pieces) == set(texts)
    for own, found in pieces.items():
        ids = np.array([*tokenizer.encode(texts[own] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0  # no padding at all
    assert packing.pack(empty).count() == 0
    json.dumps(packing.cut(1023))


def test_a_frequent_window_can_be_split(spark, monkeypatch):
    """The places of a window that all documents share meet its first place in a join that is dealt anew."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    monkeypatch.setattr(line_dedup, "lookup_side", lambda df: df)
    rows = [(i, f"own {i}\nA\nB\nC\nend {i}") for i in range(20_000)] + [(-i, f"x{i}\ny{i}\nz{i}") for i in range(1, 400) for _ in (1, 2)]
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = line_dedup.without_repeated_windows(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8, "doc_id"))
        out = found.where("doc_id >= 0").agg(F.sum("n_removed"), F.count_if(F.expr("doc_id = 0 and n_removed = 0"))).first()
        assert tuple(out) == (3 * 19_999, 1)
        found.write.format("noop").mode("overwrite").save()
        whole = found.agg(F.sum("n_removed"))
        whole.collect()
        assert "skew=true" in whole._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_packing_keeps_special_tokens_apart(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["<|endoftext|>", "a<|endoftext|>b", " <|endoftext|> <|endoftext|>\n", "<|endoftext", "é<|endoftext|>\u4f60  x", "<|ENDOFTEXT|>"]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).where("start = 0").collect()
    for r in rows:
        ids = [*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 0]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[: r.length], "<u4").tobytes())
    assert len(rows) == len(texts)


def test_sketches_by_definition():
    """Every hash of a run of characters below the limit is kept, and likeness is near the exact one of the sets."""
    rng = random.Random(11)
    texts = [prose(rng, n) for n in (900, 2500, 6000)]
    texts += [t[: len(t) // 2] + prose(rng, 800) for t in texts]
    for t in texts:
        points = [ord(c) for c in t]
        grams = {tuple(points[i : i + sketches.SHINGLE]) for i in range(len(points) - sketches.SHINGLE + 1)}
        every = {int(window_hashes(np.array(g, np.uint64), sketches.SHINGLE)[0] >> np.uint64(32)) for g in grams}
        assert sorted(sketches.sketch(t).tolist()) == sorted(h for h in every if h < 2**32 // sketches.FRACTION)
    for a, b in itertools.combinations(texts, 2):
        shingles = [{t[i : i + sketches.SHINGLE] for i in range(len(t) - sketches.SHINGLE + 1)} for t in (a, b)]
        exact = len(shingles[0] & shingles[1]) / len(shingles[0] | shingles[1])
        kept = len(shingles[0] | shingles[1]) / 16
        assert abs(sketches.resemblance(sketches.sketch(a), sketches.sketch(b)) - exact) < 4 * math.sqrt(0.25 / kept) + 0.01


_BODY = "<p>This is a long paragraph of an article, with several words and a full stop at the end of it.</p>"


def _labels(page):
    found = html_extract.blocks(page)
    own = {b.text: c > d for b, (c, d) in ((b, html_extract.costs(b)) for b in found)}
    kept = html_extract.main_text(page)
    return own, {t: t in kept for t in own}


def test_the_cut_decides_against_a_block_on_its_own():
    """A line that is all link goes with the paragraphs around it, and a sentence among links goes with the links."""
    own, kept = _labels(f"<body><div>{_BODY}<p><a href=x>See the full table</a></p>{_BODY}</div></body>")
    assert not own["See the full table"] and kept["See the full table"]
    links = "".join(f"<li><a href=x>Some other page number {i} of this site</a></li>" for i in range(4))
    own, kept = _labels(f"<body><article>{_BODY}</article><ul>{links}<li>Yet more pages can be found here, all of them new and worth a look today.</li>{links}</ul></body>")
    line = next(t for t in own if t.startswith("Yet"))
    assert own[line] and not kept[line] and sum(kept.values()) == 1


def test_class_names_do_not_delete_an_article():
    text = html_extract.main_text(_BODY)
    for page in (
        f'<div id="content" class="has-sidebar"><h1>Title</h1>{_BODY}</div><div class="sidebar"><p>Other things.</p></div>',
        f'<article class="post comments-open"><h1>Title</h1>{_BODY}</article><footer>Words of the foot.</footer><div class="cookie-notice">We use cookies.</div>',
        f'<div class="no-sidebar with-header"><article class="hentry"><h1>Title</h1>{_BODY}</article></div><div>Copyright 2024 Example. All rights reserved.</div>',
        f'<main><h1>Title</h1>{_BODY}<div id="comments"><p>I think this is a great article, thank you for it.</p></div></main>',
        f'<main><h1>Title</h1>{_BODY}<section class="post-comments"><p>I think this is a great article, thank you.</p></section></main>',
    ):
        assert html_extract.main_text(f"<body><nav><a href=x>Home</a></nav>{page}</body>") == "Title " + text, page
    assert html_extract.main_text("<body><p>a<![CDATA[bcdef") == "abcdef"


def test_a_large_page_of_mixed_blocks_takes_seconds():
    import time

    rng = random.Random(12)
    kinds = ["<p>word word word word</p>", '<div class="sidebar"><p>some text here.</p></div>', "<li><a href=x>link text</a></li>",
             "<p>" + "long text " * 20 + ".</p>", "<div>mid size text of a block</div>"]
    page = "<body>" + "".join(rng.choice(kinds) for _ in range(60_000)) + "</body>"
    assert len(page) > 4_000_000
    start = time.process_time()
    assert html_extract.main_text(page).count("long text") > 100_000
    assert time.process_time() - start < 60
