"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest side we hint for broadcast, as bytes of decoded rows.
BROADCAST_LIMIT = 64 * 1024 * 1024
ROW_OVERHEAD = 16  # of a hashed relation


def decoded_size(df: DataFrame) -> int:
    """An upper bound of the bytes that ``df`` takes in memory.

    The optimizer's estimate for files is their compressed size.  Where the
    plan cannot make more rows than it reads, the files' row count (footers only, no
    data is read) times the decoded width of a row bounds it instead."""
    plan = df._jdf.queryExecution().optimizedPlan()
    size = plan.stats().sizeInBytes()
    size = size if isinstance(size, int) else int(size.toString())  # py4j may hand over a JVM BigInt
    text = plan.toString()
    scans = text.count("Relation [")
    if not scans or any(x in text for x in ("Join", "Generate", "Expand", "MapIn", "FlatMap")) or size > BROADCAST_LIMIT:
        return size
    files = df.inputFiles()
    rows = df.sparkSession.read.parquet(*files).count() if files and all(f.endswith(".parquet") for f in files) else 0
    return max(size if not rows else 0, scans * rows * (df._jdf.schema().defaultSize() + ROW_OVERHEAD))


def bounded_broadcast(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Broadcast ``df`` only when its decoded rows are within ``limit``; beyond it
    the join stays a shuffle join and AQE may still convert it at run time
    from measured sizes."""
    try:
        size = decoded_size(df)
    except Exception:  # statistics unavailable (e.g. remote session): let the planner decide
        return df
    return F.broadcast(df) if size <= limit else df


FILTER_BITS = 1 << 27  # of a key filter: 16 MB, whatever the number of keys


def with_keys_of(df: DataFrame, keys: DataFrame, key: str, bits: int = FILTER_BITS, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """The rows of ``df`` whose ``key`` is in ``keys``, and perhaps a few others:
    a filter ahead of a join, so that a large table is not shuffled for a short list.

    A list of proven size is broadcast whole.  Beyond, the list's hashes set bits in
    a bitmap of fixed size, which is broadcast in pieces (``bitmap_construct_agg``)
    and looked up natively; n keys let a share of about n / ``bits`` of the others through."""
    listed = keys.select(F.col(key)).where(F.col(key).isNotNull()).distinct()
    small = bounded_broadcast(listed, limit)
    if small is not listed:
        return df.join(small, key, "left_semi")

    def place(c):
        return F.pmod(F.xxhash64(c), F.lit(bits))
    pieces = (listed.select(place(key).alias("_h")).groupBy(F.bitmap_bucket_number("_h").alias("_piece"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_h")).alias("_bits")))
    h = df.withColumn("_h", place(key)).withColumn("_piece", F.bitmap_bucket_number("_h")).withColumn("_bit", F.bitmap_bit_position("_h"))
    met = h.join(F.broadcast(pieces), "_piece")  # at most bits / 8 bytes
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(F.col("_bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return met.where(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1).select(*df.columns)
