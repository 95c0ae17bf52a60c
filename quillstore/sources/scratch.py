"""Tables that hold intermediate results in the cluster's shared folder, for rounds that build on one another."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_paths: list[tuple[SparkSession, str]] = []

#: Rows of fixed width up to which a side is broadcast: some tens of MB at most.
BROADCAST_ROWS = 200_000

#: Narrow rows of a task where a table is dealt by its row count: some 100 MB for the sorts and hash tables of a join and a distinct.
TASK_ROWS = 400_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset in a local session (tests), a folder of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quillstore-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def held(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: no lineage to recompute, whichever executor is lost."""
    return held_at(df, label)[0]


def held_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As held, with the table's path, for `drop` once a later round has taken its place."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _paths.append((spark, path))
    return spark.read.schema(df.schema).parquet(path), path


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, a held table of narrow rows, marked for broadcast if it has at most `rows` of them."""
    return F.broadcast(df) if df.count() <= rows else df


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, a side of a join with some `rows` rows, dealt by keys to tasks of TASK_ROWS at most. Left alone, Spark joins shuffled
    partitions by their compressed bytes, which for narrow rows are millions in a task; a table that gives each core no more
    than TASK_ROWS is left to that."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if rows <= cores * TASK_ROWS else df.repartition(-(-rows // TASK_ROWS), *keys)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a held table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def drop_held() -> None:
    """Delete this process's tables, as far as its session still lives."""
    while _paths:
        spark, path = _paths.pop()
        try:
            drop(spark, path)
        except Exception:  # the session is gone; the shared folder's own cleaning takes over
            return
