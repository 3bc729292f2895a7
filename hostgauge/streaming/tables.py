"""Tables that grow by micro-batches, are published once, and are kept to a bounded number of rows.

::

    batch_id=0/ batch_id=1/ ...     rows of the micro-batches; a folder appears in one step and never changes
    _kept/generation=3/             the rows that are left of all batches up to some batch, with their batch_id
    _counts/generation=3/           rows seen so far per group, left or not
    _manifest/3                     says up to which batch generation 3 goes; the newest manifest counts

Readers follow the newest manifest: its kept rows and the batches after it. So a new
generation is swapped in by the appearance of one small file, and no reader sees a row
twice or misses one that is to be kept. Names that begin with ``_`` are passed over by
Spark's readers, so streams that read the table see batches only.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from hostgauge.operators.monitor import latest_rows
from hostgauge.sources.storage import Storage


@dataclass(frozen=True)
class Keep:
    """The newest ``n`` rows per group (without groups: of all) by event time; ``arrival``: by number of arrival (``seq``)."""

    n: int
    groups: tuple[str, ...] = ("hostname",)
    arrival: bool = False
    every: int = 10  # batches from one compaction to the next


class BatchTable:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._storage = Storage(spark, self.path)

    # -- writing -------------------------------------------------------------------

    def prepare(self) -> None:
        """An empty batch, so that readers can start first."""
        if not self._storage.exists("batch_id=-1") and not self.manifest():
            self.spark.createDataFrame([], self.schema).write.mode("ignore").parquet(f"{self.path}/batch_id=-1")

    def publish(self, df: DataFrame, batch_id: int) -> bool:
        """Publishes a micro-batch once; false if it was published before, compacted or not."""
        folder = f"batch_id={batch_id}"
        if self.published(batch_id):
            return False
        staged = f"_staged/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{staged}")
        if not self._storage.move(staged, folder):
            raise RuntimeError(f"{self.path}/{folder} was written by another run of the stream")
        return True

    def published(self, batch_id: int) -> bool:
        return batch_id <= self.upto() or self._storage.exists(f"batch_id={batch_id}")

    def drop(self, batch_id: int) -> None:
        """Removes a batch that nobody needs any more; not for tables that streams read."""
        self._storage.delete(f"batch_id={batch_id}")

    # -- reading -------------------------------------------------------------------

    def manifest(self) -> dict:
        """The newest manifest; empty before the first compaction."""
        generations = [int(n) for n in self._storage.names("_manifest") if n.isdigit()]
        return self._storage.read_json(f"_manifest/{max(generations)}") if generations else {}

    def upto(self) -> int:
        return self.manifest().get("upto", -2)

    def batches(self, after: int = -2) -> list[int]:
        """Published batches that are stored as folders of their own."""
        folders = [n for n in self._storage.names() if n.startswith("batch_id=")]
        return sorted(b for b in (int(n.removeprefix("batch_id=")) for n in folders) if b > after)

    def _read(self, folders: list[str]) -> DataFrame:
        schema = self.schema + ", batch_id bigint"
        if not folders:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("basePath", self.path)
        return reader.parquet(*[f"{self.path}/{f}" for f in folders])

    def of_batches(self, batches: list[int]) -> DataFrame:
        return self._read([f"batch_id={b}" for b in batches])

    def rows(self) -> DataFrame:
        """What the table holds now, with ``batch_id``."""
        found = self.manifest()
        newer = self.of_batches(self.batches(found.get("upto", -2)))
        return self._kept(found).unionByName(newer) if found else newer

    def _kept(self, manifest: dict) -> DataFrame:
        folder = f"{self.path}/_kept/generation={manifest['generation']}"
        return self.spark.read.schema(self.schema + ", batch_id bigint").parquet(folder)

    def stream(self) -> DataFrame:
        """The rows of all batches, as they come, with ``batch_id``."""
        return self.spark.readStream.schema(self.schema + ", batch_id bigint").parquet(self.path)

    def seen(self, groups: tuple[str, ...]) -> DataFrame:
        """Rows published so far per group: ``seen``, ``held`` and ``dropped``."""
        found = self.manifest()
        newer = self.of_batches(self.batches(found.get("upto", -2))).groupBy(*groups).agg(F.count(F.lit(1)).alias("seen"))
        if found:
            newer = newer.unionByName(self.spark.read.schema(newer.schema).parquet(
                f"{self.path}/_counts/generation={found['generation']}"
            ))
        held = self.rows().groupBy(*groups).agg(F.count(F.lit(1)).alias("held"))
        total = newer.groupBy(*groups).agg(F.sum("seen").alias("seen"))
        same = [total[g].eqNullSafe(held[g]) for g in groups]
        joined = total.join(held, same, "left") if groups else total.join(held, F.lit(True))
        out = joined.select(*[total[g] for g in groups], "seen", F.coalesce("held", F.lit(0)).alias("held"))
        return out.withColumn("dropped", F.col("seen") - F.col("held"))

    # -- compaction ----------------------------------------------------------------

    def compact(self, keep: Keep) -> dict:
        """Writes the next generation from the last one and the batches since; earlier folders stay until ``vacuum``.

        The newest n of (the newest n so far and what came since) are the newest n of
        everything, so the cost does not grow with what was dropped before. Rows with a
        null group are one group.
        """
        found = self.manifest()
        newer = self.batches(found.get("upto", -2))
        if not newer:
            return found
        generation, upto = found.get("generation", 0) + 1, newer[-1]
        groups = list(keep.groups)
        rows = self.of_batches(newer)
        counts = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("seen"))
        if found:
            rows = self._kept(found).unionByName(rows)
            before = self.spark.read.schema(counts.schema).parquet(f"{self.path}/_counts/generation={found['generation']}")
            counts = counts.unionByName(before).groupBy(*groups).agg(F.sum("seen").alias("seen"))
        left = newest(rows, keep)
        for what, df in (("_kept", left), ("_counts", counts)):
            staged, target = f"_staged/{uuid.uuid4().hex}", f"{what}/generation={generation}"
            df.write.parquet(f"{self.path}/{staged}")
            if not self.manifest().get("generation", 0) == generation - 1:
                raise RuntimeError(f"{self.path} was compacted by another run")
            self._storage.delete(target)  # left by a run that ended before its manifest
            self._storage.move(staged, target)
        manifest = {"generation": generation, "upto": upto}
        if not self._storage.write_json(f"_manifest/{generation}", manifest, f"_staged/{uuid.uuid4().hex}"):
            raise RuntimeError(f"{self.path} was compacted by another run")
        return manifest

    def vacuum(self, consumed: int) -> None:
        """Removes batches that are in the newest generation and that streams have read (``batch_id`` up to
        ``consumed``), and all but the last two generations (readers may still be on the last but one)."""
        found = self.manifest()
        if not found:
            return
        for b in self.batches():
            if b <= min(found["upto"], consumed):
                self._storage.delete(f"batch_id={b}")
        for what in ("_kept", "_counts"):
            for name in self._storage.names(what):
                if int(name.removeprefix("generation=")) < found["generation"] - 1:
                    self._storage.delete(f"{what}/{name}")
        for name in self._storage.names("_manifest"):
            if name.isdigit() and int(name) < found["generation"] - 1:
                self._storage.delete(f"_manifest/{name}")


def newest(rows: DataFrame, keep: Keep) -> DataFrame:
    """The newest rows per group; equal orders go by number of arrival. Nothing is sorted beyond the bin that holds the cut."""
    known = {f"__{g}": F.coalesce(F.to_json(F.struct(g)), F.lit("")) for g in keep.groups}  # groups that are null must meet
    by = F.col("seq") if keep.arrival else F.coalesce("ts_us", F.lit(0))
    named = rows.withColumns({**known, "__ts": F.col("ts_us"), "ts_us": by})
    return latest_rows(named, keep.n, list(known)).withColumn("ts_us", F.col("__ts")).select(*rows.columns)
