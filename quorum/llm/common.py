"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorum.session import checkpoint_dir

# The ASCII letters that contracts fold, and their word pattern.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the folder named by ``spark.checkpoint.dir``, which
    the driver and every executor can reach."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


BATCH_ROWS = 500  # rows of an Arrow batch: texts can be long, and a worker holds whole batches


def in_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` in batches of at most BATCH_ROWS rows (a session setting
    that is only ever lowered), which bounds a Python worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, BATCH_ROWS)
    return df.mapInArrow(function, schema)


@contextlib.contextmanager
def wide_batches(spark: SparkSession, rows: int = 10_000):
    """Within it, jobs whose Arrow rows are a few numbers come in larger batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextlib.contextmanager
def light_batches(spark: SparkSession, size: int = 4 << 20):
    """Within it, an Arrow batch of a job ends at ``size`` bytes, however few its rows:
    JVM and Python worker hold it outside the heap, and texts may all be long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the
    lineage, so that a lost executor costs only the tasks that it ran."""
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def erase(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and that nothing reads any more."""
    for df in tables:
        jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """True for the fold on which nothing is learned: crc32(text of the id)
    mod 5 = 0; a null id belongs to it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
