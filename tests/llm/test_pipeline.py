"""Stages against plain versions of themselves, each on its own input."""

import collections
import hashlib

import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from hostgauge.llm import mixing, packing, quality, simhash
from hostgauge.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), duck(SF), ORACLES[name]) is None


def test_all_queries_are_offered():
    offered = entry.queries()
    assert all(sum(q.startswith(f"op{n}_") for q in offered) == 1 for n in range(1, 14)) and "pipeline" in offered


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stages"))
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in pipeline.STAGES:
        stage(spark, docs[-1], SF).write.parquet(f"{folder}/{name}")
        docs.append(spark.read.parquet(f"{folder}/{name}"))
    return docs


def test_stages(spark, stored):
    rows = [d.collect() for d in stored]
    assert all(d.columns == stored[0].columns for d in stored[:-1])
    accepted = {r.doc_id for r in quality.score_quality(stored[0], spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    assert {r.doc_id for r in rows[1]} == accepted
    last = {}
    for r in rows[1]:
        key = hashlib.sha256(r.text.encode().lower()).digest()
        last[key] = max(last.get(key, -1), r.doc_id)
    assert sorted(r.doc_id for r in rows[2]) == sorted(last.values())
    fps = sorted((r.doc_id, simhash.simhash(r.text) % 2**64) for r in rows[2])
    label = {d: d for d, _ in fps}
    for _ in range(5):
        for i, (d, a) in enumerate(fps):
            for e, b in fps[:i]:
                if (a ^ b).bit_count() <= 4:
                    label[d] = label[e] = min(label[d], label[e])
    assert {r.doc_id for r in rows[3]} == {d for d, c in label.items() if d == c}
    copies = collections.Counter(r.doc_id for r in rows[4])
    assert max(copies.values()) <= 2 and set(copies) <= {r.doc_id for r in rows[3]}
    words = lambda some: sum(len((r.text or "").encode().split()) for r in some)
    assert words(rows[4]) == pytest.approx(1.5 * words(rows[3]), rel=0.01)
    assert sum(r.length for r in rows[5]) == sum(r.length for r in packing.pack(stored[4]).select("length").collect())
    assert collections.Counter(r.doc_id for r in rows[5] if r.start == 0) == copies


def test_edge_rows(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string"
    rows = [(1, "a b c", "en", "s", 5, "x"), (1, "a b c", "en", "s", 5, "x"), (2, None, "en", None, 0, "y"), (None, "", None, "t", 0, "z"),
            (3, "A b C", "en", "s", 5, "w"), (4, "d " * 5000, "en", "s", 9, "v")]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
        out.collect()
    kept = {(r.doc_id, r.text) for r in pipeline.distinct_texts(spark, docs, SF).collect()}
    assert kept == {(2, None), (3, "A b C"), (4, "d " * 5000)}


def test_repeated_rows_and_null_ids(spark):
    """One row of each group stays, whatever repeats: rows, ids, or the lack of an id."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    words = " ".join(f"w{i}" for i in range(200))
    texts = {1: words, 2: "a b c d e f"}
    rows = [(1, texts[1]), (1, texts[1]), (1, texts[1].upper()), (None, texts[2]), (None, texts[2].upper()), (None, texts[2]), (7, "alone x"), (7, "other y z")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], schema)
    for stage in (pipeline.distinct_texts, pipeline.distinct_classes):
        for _ in range(2):
            kept = stage(spark, docs.repartition(3), SF).collect()
            assert sorted((str(r.doc_id), r.text.lower()) for r in kept) == [
                ("1", texts[1]), ("7", "alone x"), ("7", "other y z"), ("None", texts[2])]
            assert (1, texts[1]) in {(r.doc_id, r.text) for r in kept} or (1, texts[1].upper()) in {(r.doc_id, r.text) for r in kept}


def test_rows_without_an_id_are_drawn_apart(spark):
    """Null ids of one length do not share one draw: they spread over bins, and the mix still meets its target."""
    docs = spark.range(6000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "concat('a b ', id) AS text", "if(id % 3 = 0, 'x', 'y') AS source")
    first, again = (mixing.mix(docs.repartition(n), keep=["text"]).orderBy("text").collect() for n in (2, 5))
    assert first == again and len(first) == 6000
    for source in (0, 1):
        rows = [r for r in first if (int(r.text.split()[2]) % 3 == 0) == (source == 0)]
        assert abs(sum(r.taken for r in rows) - rows[0].target) < 3
