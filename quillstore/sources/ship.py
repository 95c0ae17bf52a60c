"""Sends this package to the executors' Python."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Rows of a batch that goes to Python; each is a text, and is there as file, header and body at once.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Add the package to the application's Python files, once, and keep batches for Python small."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(rows, "10000")) not in range(1, BATCH_ROWS + 1):
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
