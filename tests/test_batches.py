import pandas as pd
from pyspark.sql import functions as F

from quillstore.sources import tables as tb


def test_python_gets_texts_in_small_batches(spark, tmp_path, monkeypatch):
    spark.range(5000).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr("quillstore.sources.ship._shipped", {spark.sparkContext.applicationId})
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")

        @F.pandas_udf("int")
        def rows(x: pd.Series) -> pd.Series:
            return pd.Series([len(x)] * len(x))

        assert tb.table(spark, str(tmp_path), "documents").select(rows("id").alias("n")).agg(F.max("n")).first()[0] <= 1000
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
