"""Alerts are offered to their hosts until they are acknowledged.

Three tables grow by rounds: ``deliveries`` (what was offered), ``pending`` (what is not
acknowledged yet) and the acknowledgements that consumers write. A round takes the last
round's pending alerts, adds the alerts and takes away the acknowledgements that came
since, offers what is left once more, and stores it as the next pending. So a round
costs what is open and new, and never reads the history. Any acknowledgement may be lost, late or
repeated: an alert is offered at least once, and a consumer knows a repeat by its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hostgauge.plans.jobs import Steps
from hostgauge.schemas import USER_KEY
from hostgauge.session import lookup_side
from hostgauge.streaming.jobs import ALERT_TABLE, Marks
from hostgauge.streaming.tables import BatchTable

OPEN = "alert_id string, hostname string, user_id bigint, ts_us bigint, `trigger` string, offers int"
DELIVERY = OPEN + ", round bigint"
ACK = "alert_id string, round bigint"


def alert_id() -> Column:
    """One alert per user of a host, so these name it."""
    return F.to_json(F.struct(*USER_KEY))


class Outbox:
    def __init__(self, spark: SparkSession, alerts_path: str, path: str):
        self.spark = spark
        self.alerts = BatchTable(spark, alerts_path, ALERT_TABLE)
        self.acks = BatchTable(spark, f"{path}/acks", ACK)
        self.pending = BatchTable(spark, f"{path}/pending", OPEN)
        self.deliveries = BatchTable(spark, f"{path}/deliveries", DELIVERY)
        self._marks = Marks(spark, path)

    def offer(self, number: int) -> DataFrame:
        """Round ``number`` (0, 1, 2, ...): what goes out in it. A repeated round offers the same again."""
        if not self.deliveries.published(number):
            before = self._marks.get(number - 1)
            if before is None:
                raise ValueError(f"round {number - 1} was not offered")
            upto = self._marks.get(number) or self._marks.put(number, {
                "alerts": max(self.alerts.batches(), default=-2), "acks": max(self.acks.batches(), default=-2),
            })
            new = [b for b in self.alerts.batches(before.get("alerts", -2)) if b <= upto["alerts"]]
            acked = [b for b in self.acks.batches(before.get("acks", -2)) if b <= upto["acks"]]
            alerts = self.alerts.of_batches(new).select(
                alert_id().alias("alert_id"), *USER_KEY, "ts_us", "trigger", F.lit(0).alias("offers")
            )
            with Steps(self.spark) as steps:
                done = steps.stored(self.acks.of_batches(acked).select("alert_id").distinct(), "done")
                left = self.pending.of_batches([number - 1] if number else []).drop("batch_id").unionByName(alerts)
                # a null part of an id is its own value, and ids are never null
                left = left.join(lookup_side(done), "alert_id", "left_anti").withColumn("offers", F.col("offers") + 1)
                left = steps.stored(left, "left")
                self.pending.publish(left, number)
                self.deliveries.publish(left.withColumn("round", F.lit(number).cast("bigint")), number)
            if number > 1:
                self.pending.drop(number - 2)
        return self.deliveries.of_batches([number]).drop("batch_id")

    def acknowledge(self, acks: DataFrame, batch_id: int) -> bool:
        """Stores what consumers report (alert_id, round); repeats and unknown ids do no harm."""
        return self.acks.publish(acks.select("alert_id", F.col("round").cast("bigint").alias("round")), batch_id)


def consumed(deliveries: DataFrame) -> DataFrame:
    """What a consumer acts on: the first delivery of every alert."""
    first = F.min_by(F.struct("hostname", "user_id", "ts_us", "trigger", "round"), "round")
    return deliveries.groupBy("alert_id").agg(first.alias("first"), F.count(F.lit(1)).alias("offers")).select(
        "alert_id", "first.*", "offers"
    )
