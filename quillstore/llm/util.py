"""Shared helpers: intermediate tables in the cluster's shared folder, checked broadcasts, null-safe joins."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What one word is, everywhere in this package.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which `small` lets a side be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000

_paths: list[tuple[SparkSession, str]] = []


_shipped: set[str] = set()


#: Rows of a batch that goes to Python; texts may be long, so that a batch's bytes stay bounded.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that their Python can import it."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(rows, "10000")) > BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="quillstore-")) / "quillstore.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(to))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset in a local session (tests), a folder of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quillstore-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: short lineage, and true sizes for the planner."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _paths.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def drop_written() -> None:
    """Delete this process's intermediate tables, as far as its session still lives."""
    while _paths:
        spark, path = _paths.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone; the shared folder's own cleaning takes over
            return


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most `rows` rows (df is a written table, so counting is cheap)."""
    return F.broadcast(df) if df.count() <= rows else df.hint("shuffle_hash")


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality on the columns named."""
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def n_words(text: Column | str) -> Column:
    """Number of words in a text; null has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
