import pytest
from pyspark.sql import functions as F

from quillstore.plans.catalog import QUERIES
from quillstore.sources import tables as tb

SF = "/root/testdata/sf0.01"


@pytest.fixture
def few(spark, monkeypatch):
    """Tasks of 1,000 rows, and joins as of tables too large for a broadcast."""
    monkeypatch.setattr("quillstore.sources.scratch.TASK_ROWS", 1000)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_task_of_triples_does_not_grow_with_the_table(spark, few):
    sizes = [r["count"] for r in tb.triples(spark, SF).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 60_000 and max(sizes) < 3000


@pytest.mark.parametrize("name", ["M3_insert_triples", "L15_triple_resolution", "J4_triple_conflicts"])
def test_dealt_triples_give_the_same_rows(spark, few, name, monkeypatch):
    got = sorted(map(tuple, QUERIES[name](spark, SF).collect()))
    monkeypatch.setattr("quillstore.sources.scratch.TASK_ROWS", 10**9)
    assert got == sorted(map(tuple, QUERIES[name](spark, SF).collect()))
