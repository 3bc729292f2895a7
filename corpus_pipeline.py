"""From raw documents to packed training sequences: filter, deduplicate twice, mix, pack."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hostgauge.llm import exact_dedup, mixing, packing, quality, simhash
from hostgauge.llm.common import table
from hostgauge.session import lookup_side, materialize, shared_folder
from hostgauge.sources.storage import Storage

# Rows are told apart by id and text: rows that agree in both are one document, repeated.
_OWN = "__own"


def _own() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", _own().alias(_OWN), "text")


def _one_of_each(docs: DataFrame, found: DataFrame, group: str) -> DataFrame:
    """One row of ``docs`` per ``group``.

    ``found`` says of each row (doc_id, own) its group and whether its id wins there.
    Where several rows have the winning id (or no row has an id), the text with the
    smallest hash stays, and of rows repeated with id and text any one. Only rows that
    do not stay, and ids that repeat, take part in joins.
    """
    found = materialize(found.select(F.col("doc_id").alias("__id"), F.col(_OWN).alias("__of"), F.col(group).alias("__group"), "wins"))
    wins = found.where("wins")
    several = wins.groupBy("__group").agg(F.count(F.lit(1)).alias("n"), F.min("__of").alias("__least")).where("n > 1")
    several = lookup_side(materialize(several.drop("n")))
    rivals = wins.join(several, "__group")
    gone = found.where("not wins").unionByName(rivals.where("__of <> __least").drop("__least"))
    repeated = rivals.where("__of = __least").groupBy("__id", "__of").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    gone, repeated = (lookup_side(materialize(d.select("__id", "__of").distinct())) for d in (gone, repeated))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (_own() == F.col("__of"))
    left = docs.join(gone, same, "left_anti")
    once = left.join(repeated, same).dropDuplicates(["__id", "__of"]).select(*docs.columns)
    return left.join(repeated, same, "left_anti").unionByName(once)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; rejected ones go."""
    row = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("__row"), "doc_id", "text")
    scored = quality.score_quality(row, table(spark, sf_dir, "labels"), keep=["__row"])
    return scored.where(F.col("predicted") == 1).select("__row.*")


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row: that with the largest id."""
    found = exact_dedup.exact_groups(_keyed(docs), keep=["doc_id", _OWN])
    return _one_of_each(docs, found.withColumn("wins", F.col("kept")), "text_sha256")


def distinct_classes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate texts one row: that with the smallest id."""
    found = simhash.near_classes(_keyed(docs), keep=["doc_id", _OWN], class_col="class")
    return _one_of_each(docs, found.withColumn("wins", F.col("doc_id").eqNullSafe(F.col("component_id"))), "class")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often (0 to 2 times) as the mix takes them."""
    keyed = docs.select("doc_id", _own().alias(_OWN), "text", "source")
    found = mixing.mix(keyed, keep=["doc_id", _OWN])
    plan = found.groupBy(F.col("doc_id").alias("__id"), F.col(_OWN).alias("__of")).agg(
        F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows")
    )
    plan = lookup_side(materialize(plan.where(F.col("__copies") > 0)))
    joined = docs.join(plan, F.col("doc_id").eqNullSafe(F.col("__id")) & (_own() == F.col("__of")))
    columns = [F.col(c) for c in docs.columns]
    once = joined.where(F.col("__rows") == 1).select(*columns, F.col("__copies").cast("int").alias("__n"))
    # rows repeated with id and text share what was drawn for them
    nth = F.row_number().over(Window.partitionBy("__id", "__of").orderBy(F.lit(0)))
    share = F.floor(F.col("__copies") / F.col("__rows")) + (F.col("__nth") <= F.col("__copies") % F.col("__rows")).cast("int")
    repeated = joined.where(F.col("__rows") > 1).withColumn("__nth", nth).select(*columns, share.cast("int").alias("__n"))
    every = once.unionAll(repeated).where(F.col("__n") > 0)
    return every.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("exact_dedup", distinct_texts),
    ("near_dedup", distinct_classes),
    ("mixing", mixed_sources),
    ("packing", packed),
]

ORACLE_SQL = None  # learnt weights and tokenizers are beyond SQL; tests/llm compares with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again.
    A stage's table goes once the next one is written; that of the last but one stays, as the result reads it."""
    storage = Storage(spark, f"{shared_folder(spark).rstrip('/')}/hostgauge-pipeline-{uuid.uuid4().hex}")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{storage.root}/{name}")
        docs = spark.read.parquet(f"{storage.root}/{name}")
        if before:
            storage.delete(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
