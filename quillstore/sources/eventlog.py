"""An append-only event log in batches: validated, appended whole or not at all, each event once however often it is tried.

    <path>/batch=<b>/part-*.json     JSON lines of a batch
    <path>/batch=<b>/_SUCCESS        written last: the batch counts from then on

Appends go through Spark's own writer, so each task's lines appear when the job commits. A batch that failed has no
_SUCCESS, is not read, and is overwritten when tried again. Ids that a caller leaves out follow from the event's content
and its number within equal ones, so a retry gives an event the id it had. Events that the log already has are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schema import EVENT

# Actions of events.
ACTIONS = (
    "atom_created", "atom_updated", "atom_archived", "atom_promoted", "atom_expired", "atom_imported", "atom_shared", "atom_unshared", "atom_read", "checkpoint_created",
    "conflict_detected", "conflict_resolved", "human_edit", "atom_reconciled", "reflect_completed", "gc_completed", "session_started", "session_ended", "merge_completed",
)
NAMES = [f.name for f in EVENT.fields]


def problems(events: DataFrame, actions: tuple[str, ...] = ACTIONS):
    """Column: what keeps an event out of the log, an empty array if nothing does."""
    rules = (
        ("timestamp", F.try_to_timestamp("timestamp").isNull()), ("agent_id", F.coalesce("agent_id", F.lit("")) == ""), ("session_id", F.coalesce("session_id", F.lit("")) == ""),
        ("action", ~F.coalesce(F.col("action").isin(*actions), F.lit(False))), ("atom_refs", F.coalesce(F.exists("atom_refs", lambda r: r.isNull() | (r == "")), F.lit(False))),
        ("schema_version", (F.col("schema_version") == 2) & F.col("atom_snapshot").isNull() & F.col("action").isin("atom_created", "atom_updated")),
    )
    return F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]), lambda x: x.isNotNull())


def identified(events: DataFrame) -> DataFrame:
    """events with an event_id each: given ones stay, others follow from the content and a number among equal events."""
    content = F.sha2(F.to_json(F.struct(*[c for c in NAMES if c != "event_id"])), 256)
    rows = events.select(*NAMES).withColumn("_content", content)
    number = F.row_number().over(Window.partitionBy("_content", F.col("event_id").isNull()).orderBy("event_id"))
    made = F.concat(F.lit("ev-"), F.substring("_content", 1, 32), F.lit("-"), number.cast("string"))
    return rows.withColumn("event_id", F.coalesce("event_id", made)).select(*NAMES)


class EventLog:
    """A log at `path`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def batches(self) -> list[int]:
        """Numbers of the batches that are whole."""
        fs, root = self._fs(self.path)
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        numbers = [int(n.split("=")[1]) for n in names if n.startswith("batch=")]
        done = lambda b: (lambda f, p: f.exists(p))(*self._fs(f"{self.path}/batch={b}/_SUCCESS"))
        return sorted(b for b in numbers if done(b))

    def read(self) -> DataFrame:
        """All events of whole batches; lines that do not parse are dropped."""
        found = self.batches()
        if not found:
            return self.spark.createDataFrame([], EVENT)
        rows = self.spark.read.schema(EVENT).option("mode", "DROPMALFORMED").json([f"{self.path}/batch={b}" for b in found])
        return rows.where("event_id is not null")

    def append(self, events: DataFrame, batch: int | None = None) -> int:
        """Append events as one batch and return its number. Raises ValueError, with a few of them, if any is invalid.

        batch: a number for the batch; if it is whole already, nothing happens.
        """
        found = self.batches()
        number = batch if batch is not None else (found[-1] + 1 if found else 0)
        if number in found:
            return number
        bad = events.select(*NAMES).withColumn("_problems", problems(events)).where(F.size("_problems") > 0)
        if some := bad.limit(5).collect():
            raise ValueError("invalid events: " + "; ".join(f"{r.event_id or r.action}: {', '.join(r['_problems'])}" for r in some))
        new = identified(events).dropDuplicates(["event_id"]).join(self.read().select("event_id"), "event_id", "left_anti")
        new.select(*NAMES).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").json(f"{self.path}/batch={number}")
        return number
