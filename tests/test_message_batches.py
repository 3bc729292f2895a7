"""A micro-batch of the message queries is as many files as tasks, so that no single task writes or reads it."""

from pyspark.sql import functions as F

from hostgauge.queries.stream_tables import _in_batches
from hostgauge.streaming import jobs, source


def test_batches_of_several_files(spark, tmp_path):
    rows, folder = spark.range(400).repartition(4), str(tmp_path / "in")

    def start():
        stream = spark.readStream.schema("id long").parquet(folder)
        return jobs.start_stream(
            stream.writeStream.foreachBatch(lambda b, i: jobs.write_batch(b, str(tmp_path / "out"), i)), str(tmp_path / "c"), source.DRAIN
        )

    _in_batches(rows, F.col("id") % 2, 2, folder, start)
    assert len(list((tmp_path / "in").glob("part-*"))) == 8
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["batch_id"], r["id"] % 2) for r in out.collect()} == {(0, 0), (1, 1)} and out.count() == 400
