"""One named query per operator, over whole tables, and the SQL of those that SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hostgauge.llm import (
    exact_dedup, filter_audit, html_extract, lexical_search, line_dedup, lm, mixing, packing, quality, simhash, sketches,
    toxicity, vector_dedup,
)
from hostgauge.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_classes(table(spark, sf_dir, "documents"))


@query("op2_mixing")
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query(
    "op3_exact_dedup",
    """
    WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
               FROM documents),
    g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
    FROM d JOIN g USING (t)
    """,
)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op4_html_extract")
def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op6_line_dedup",
    """
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    p AS (SELECT doc_id, l, unnest(range(0, greatest(len(l) - 2, 0))) AS pos FROM d),
    w AS (SELECT doc_id, pos,
                 row_number() OVER (PARTITION BY l[pos + 1], l[pos + 2], l[pos + 3] ORDER BY doc_id, pos) AS rn FROM p),
    c AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM w WHERE rn > 1),
    s AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM d),
    k AS (SELECT s.doc_id, string_agg(line, chr(10) ORDER BY s.pos) FILTER (WHERE c.pos IS NULL) AS text,
                 count(*) AS n_lines, count(c.pos) AS n_removed
          FROM s LEFT JOIN c ON s.doc_id = c.doc_id AND s.pos = c.pos GROUP BY s.doc_id)
    SELECT doc_id, n_lines, n_removed, coalesce(text, '') AS text FROM k
    """,
)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeated_windows(table(spark, sf_dir, "documents"))


@query("op7_lm_scoring")
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_sketches")
def op9_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.edited_likeness(table(spark, sf_dir, "documents"))


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query(
    "op11_filter_audit",
    r"""
    WITH d AS (
      SELECT d.doc_id, coalesce(d.source, '') AS part, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
             coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
      FROM documents d LEFT JOIN (
        SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
               max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
        FROM labels GROUP BY doc_id
      ) l ON d.doc_id = l.doc_id),
    firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
    f AS (
      SELECT part, good, toxic,
             [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
              100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t),
              regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails
      FROM d JOIN firsts USING (t)),
    m AS (SELECT part, fails, count(*) AS n, sum(good) AS n_good, sum(toxic) AS n_toxic FROM f GROUP BY 1, 2),
    i AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
    o AS (SELECT [a.i, b.i, c.i, e.i, g.i] AS o FROM i a, i b, i c, i e, i g
          WHERE len(list_distinct([a.i, b.i, c.i, e.i, g.i])) = 5),
    s AS (SELECT o, i AS step, o[i] AS filter, o[:i - 1] AS earlier FROM o, i),
    x AS (SELECT part, o, step, filter, n, n_good, n_toxic, fails[filter] AS hit,
                 len(list_filter(earlier, lambda k: fails[k])) > 0 AS gone, len(list_filter(fails, lambda v: v)) = 1 AS alone
          FROM m, s),
    r AS (SELECT part, o, step, filter,
                 coalesce(sum(n) FILTER (WHERE NOT gone AND NOT hit), 0) AS kept,
                 coalesce(sum(n) FILTER (WHERE NOT gone AND hit), 0) AS removed,
                 coalesce(sum(n) FILTER (WHERE gone AND hit), 0) AS redundant,
                 coalesce(sum(n) FILTER (WHERE hit AND alone), 0) AS unique_fails,
                 coalesce(sum(n_good) FILTER (WHERE NOT gone AND hit), 0) AS good_lost,
                 coalesce(sum(n_toxic) FILTER (WHERE NOT gone AND hit), 0) AS toxic_lost
          FROM x GROUP BY ALL)
    SELECT part, array_to_string(list_transform(o, lambda k: substr('ABCDE', k, 1)), '') AS filter_order,
           CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
           CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
           CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
    FROM r
    """,
)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op12_lexical_search",
    r"""
    WITH d AS (
      SELECT doc_id, row_number() OVER () AS row,
             regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
      FROM documents),
    p AS (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM d),
    tf AS (SELECT row, doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
    totals AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS words FROM d WHERE len(w) > 0),
    q AS (
      SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM benchmark),
    w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
          FROM tf, totals GROUP BY term, docs),
    s AS (
      SELECT item_id, row, doc_id,
             CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words)))) AS BIGINT) AS score
      FROM q JOIN tf USING (term) JOIN w USING (term), totals GROUP BY ALL)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank,
           doc_id, score
    FROM s WHERE score > 0 QUALIFY rank <= 10
    """,
)
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_vector_dedup")
def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))
