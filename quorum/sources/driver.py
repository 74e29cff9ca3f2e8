"""Reader for the driver's parquet tables (one file or folder per table)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Fixed-size dimension tables are never spread out.
DIMENSIONS = {"region", "nation"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan; Catalyst prunes columns and pushes filters into it.

    A table that lands in fewer input splits than the cluster has cores (a
    small file with a single row group) is spread round-robin over
    ``spark.default.parallelism`` partitions so that the work fused after
    the scan runs in parallel.  At scale inputs already have many splits
    and this never triggers.
    """
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    if name in DIMENSIONS:
        return df
    try:
        want = spark.sparkContext.defaultParallelism
        have = df._jdf.rdd().getNumPartitions()  # file splits only; no job runs
    except Exception:  # e.g. a remote (Connect) session: leave the scan as is
        return df
    return df.repartition(want) if have < want else df
