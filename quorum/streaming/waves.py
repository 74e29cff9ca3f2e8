"""Streaming ingestion of survey waves.

New answer files (one per wave or batch) land in a folder; a Structured
Streaming query keeps the weighted counts per (question, attribute, group,
code) up to date.  The aggregation is the same operator as the batch
path (``weighted_counts``); state lives in the stream's checkpoint folder
(shared storage), so a restarted driver or a lost executor resumes where
it stopped.  Each micro-batch rewrites the (small) aggregate table.
"""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from quorum.operators.distribution import weighted_counts
from quorum.sources.io import _fs, path_exists


def _published(spark: SparkSession, out_path: str) -> list[str]:
    """The committed epochs' folders, oldest first."""
    fs, path = _fs(spark, out_path)
    folders = sorted(s.getPath().toString() for s in fs.listStatus(path) if s.getPath().getName().startswith("epoch="))
    return [f for f in folders if path_exists(spark, f"{f}/_SUCCESS")]


def read_published(spark: SparkSession, out_path: str) -> DataFrame:
    """The latest whole aggregate."""
    return spark.read.parquet(_published(spark, out_path)[-1])


def start_wave_counts(spark: SparkSession, source: str, schema: StructType, attribute_columns: Mapping[str, str],
                      group_codes: DataFrame, out_path: str, checkpoint: str, files_per_trigger: int = 1,
                      available_now: bool = True):
    """Start the stream; returns the ``StreamingQuery``."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
                   .parquet(source))
    counts = weighted_counts(stream, attribute_columns, group_codes, "cgss")

    def publish(batch: DataFrame, epoch: int) -> None:
        # a folder per epoch: a reader sees a whole table or the one before, never half of one
        batch.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch:012d}")
        for old in _published(batch.sparkSession, out_path)[:-2]:
            fs, path = _fs(batch.sparkSession, old)
            fs.delete(path, True)

    w = (counts.writeStream.outputMode("complete").foreachBatch(publish)
               .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def run_to_end(spark: SparkSession, source: str, schema: StructType, attribute_columns: Mapping[str, str],
               group_codes: DataFrame, root: str, files_per_trigger: int = 1) -> DataFrame:
    """Process every file present now, then read the published aggregate."""
    out, ck = os.path.join(root, "counts"), os.path.join(root, "checkpoint")
    q = start_wave_counts(spark, source, schema, attribute_columns, group_codes, out, ck, files_per_trigger)
    q.awaitTermination()
    return read_published(spark, out)
