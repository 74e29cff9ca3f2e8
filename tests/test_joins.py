"""Broadcast hints follow decoded sizes."""
from pyspark.sql import functions as F

from quorum.operators import joins


def hinted(df, limit):
    return "broadcast" in joins.bounded_broadcast(df, limit)._jdf.queryExecution().logical().toString().lower()


def test_a_table_that_compresses_well(spark, tmp_path):
    path = str(tmp_path / "flat")
    spark.range(0, 2_000_000, 1, 4).select(F.lit(7).cast("long").alias("k")).write.parquet(path)
    flat = spark.read.parquet(path)
    estimate = flat._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(str(estimate)) < 1_000_000                        # the files are small
    assert joins.decoded_size(flat) >= 2_000_000 * 24            # the rows are not
    assert not hinted(flat, 10_000_000) and hinted(flat, 100_000_000)
    assert joins.decoded_size(flat.union(flat.select(F.col("k") + 1)).distinct()) >= 4_000_000 * 24


def test_small_relations_are_broadcast(spark):
    assert hinted(spark.sql("SELECT * FROM VALUES (1, 'a') AS t(k, v)"), joins.BROADCAST_LIMIT)
