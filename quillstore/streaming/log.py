"""The event log as a stream: JSON lines in a folder, late events within a watermark, counters and replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.schema import EVENT


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of events from JSON lines; lines that do not parse or lack an id or time are dropped."""
    rows = spark.readStream.schema(EVENT).option("mode", "DROPMALFORMED").json(path)
    return rows.withColumn("ts", F.try_to_timestamp("timestamp")).where("event_id is not null and ts is not null")


def once(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events without those whose id was seen within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def usage_by_hour(events: DataFrame) -> DataFrame:
    """Reads and conflicts per atom and hour; an hour is final once the watermark passes it."""
    refs = events.select("ts", "action", F.explode("atom_refs").alias("atom_id"))
    return refs.groupBy(F.window("ts", "1 hour").alias("hour"), "atom_id").agg(
        F.count_if(F.col("action") == "atom_read").alias("reads"), F.count_if(F.col("action") == "conflict_detected").alias("conflicts")
    )


def replay_into(events: DataFrame, path: str, checkpoint: str):
    """Start a query that keeps, as a table at `path`/<batch>, the last snapshot of each atom.

    Each micro-batch is merged with the state before it by (timestamp, event_id), so late events fall where they belong
    and a batch that runs again writes the same folder.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select(F.explode("atom_refs").alias("atom_id"), "ts", "event_id", "action", "atom_snapshot")
        if number:
            new = new.unionByName(spark.read.parquet(f"{path}/{number - 1}"))
        w = Window.partitionBy("atom_id").orderBy(F.desc("ts"), F.desc("event_id"))
        new.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").write.mode("overwrite").parquet(f"{path}/{number}")

    return events.where(F.col("atom_snapshot").isNotNull() | F.col("action").isin("atom_archived", "atom_expired")).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


MUTATIONS = ("atom_created", "atom_updated", "atom_imported", "atom_promoted", "atom_archived", "atom_expired")  # fixed values: actions that set an atom's state
GONE = ("atom_archived", "atom_expired")


def latest(events: DataFrame) -> DataFrame:
    """(atom_id, ts, event_id, action, atom_snapshot): the last event of each atom by (timestamp, event_id).

    On a stream this is state by atom, in Spark's state store: an event that comes late or again changes nothing unless it
    is the last. A batch of the stream touches the atoms of its events only.
    """
    refs = events.where(F.col("action").isin(*MUTATIONS)).select(F.explode("atom_refs").alias("atom_id"), F.struct("ts", "event_id", "action", "atom_snapshot").alias("e"))
    return refs.groupBy("atom_id").agg(F.max_by("e", F.struct("e.ts", "e.event_id")).alias("e")).select("atom_id", "e.*")


def keep_latest(events: DataFrame, path: str, checkpoint: str):
    """A query that writes what changed in `latest` to `path`/batch=<number>; a batch that runs again writes the same folder."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return latest(events).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The atoms that live, as keep_latest has them: each as its last batch left it."""
    rows = spark.read.parquet(path).groupBy("atom_id").agg(F.max_by(F.struct("ts", "event_id", "action", "atom_snapshot"), "batch").alias("e")).select("atom_id", "e.*")
    return rows.where(~F.col("action").isin(*GONE))
