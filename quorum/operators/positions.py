"""Positions and running values over a whole table or over hot keys (W2–W4,
W6–W9, T7, J9, S5).

A prefix scan in two passes, without a one-partition window and without a
join back on key values:

1. ``repartitionByRange`` and a sort within partitions put the rows in order;
   one Arrow pass over each sorted partition (a *block*) adds the place of a
   row in its run (the rows of one partition key), its running value there,
   and whether the run is the block's first.  Blocks are written once to the
   shared folder, so a lost executor cannot change them.
2. Totals per block (one row each, as many as shuffle partitions) give each
   block what the run it begins with has gathered before; that is added while
   the blocks are read.

Rows are carried through, so repeated keys, NULL keys and whole repeated rows
keep one position each.  Rows with equal keys come in the order of the input.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL = T.StructType([T.StructField("_q_block", T.IntegerType()), T.StructField("_q_at", T.LongType()),
                       T.StructField("_q_head", T.BooleanType()), T.StructField("_q_place", T.LongType())])


class Scan(NamedTuple):
    rows: DataFrame       # the input's columns, ``name``
    count: int            # of all rows
    total: float | None   # of ``value`` over all rows


def _local(columns: list[str], run: str, value: str | None, how: str, integral: bool):
    """Adds to sorted rows: block, place in the block, whether the row is in
    the block's first run, place in the run, and the running value before it."""
    kind = np.int64 if integral else np.float64

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at, last, before, so_far, head = TaskContext.get().partitionId(), 0, None, 0, None, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = batch.column(batch.schema.get_field_index(run)).to_numpy()
            change = np.concatenate([[last is None or key[0] != last], key[1:] != key[:-1]])
            if last is not None and change[0]:
                head = False
            number = np.cumsum(change) - change[0]      # 0: the run that the batch begins with
            goes_on = ~change[0]
            if change[0]:
                before, so_far = 0, None
            starts = np.concatenate([[0], np.flatnonzero(change[1:]) + 1])
            place = np.arange(n) - starts[number] + np.where(number == 0, before if goes_on else 0, 0)
            heads = (number == 0) & head
            out = [pa.array(np.full(n, block, np.int32)), pa.array(at + np.arange(n)), pa.array(heads), pa.array(place)]
            if value is not None:
                x = batch.column(batch.schema.get_field_index(value)).to_pandas()
                if how == "sum":
                    x = x.fillna(0).astype(kind)
                    own = x.groupby(number).cumsum() + np.where(number == 0, so_far or 0, 0).astype(kind)
                    running = own - x
                    out.append(pa.array(running.to_numpy(), pa.int64() if integral else pa.float64()))
                else:
                    x = x.astype(np.float64)
                    if so_far is not None:
                        carried = pd.concat([pd.Series([so_far]), x], ignore_index=True)
                        groups = np.concatenate([[0], number])
                    else:
                        carried, groups = x.reset_index(drop=True), number
                    grouped = carried.groupby(groups)
                    own = grouped.cummin().groupby(groups).ffill()
                    running = own.groupby(groups).shift(1)
                    if so_far is not None:
                        own, running = own.iloc[1:], running.iloc[1:]
                    out.append(pa.array(running.to_numpy(), pa.float64(), from_pandas=True))
                so_far = own.iloc[-1]
                so_far = None if how == "min" and np.isnan(so_far) else so_far
            last, before, at = key[-1], int(place[-1]) + 1, at + n
            head = head and not change[1:].any()
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), *out],
                                             [*columns, "_q_block", "_q_at", "_q_head", "_q_place", *(["_q_run_value"] if value else [])])
    return task


def _is_plain(df: DataFrame) -> bool:
    """No join, aggregate or sort below: cheap to run twice."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return not any(x in plan for x in ("Join", "Aggregate", "Window", "Sort", "Repartition", "Python", "Pandas", "Arrow", "Generate"))


def scan(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), name: str = "row_idx", value: str | None = None,
         how: str = "sum", derived: Mapping[str, Column] | None = None, drop: Sequence[str] = (), place: str | None = None) -> Scan:
    """Every row of ``df`` with ``name``: its 0-based place by ``order`` within
    its run (the rows with equal ``keys``; all rows without keys), or, with
    ``value``, the ``sum`` or ``min`` of that column over the run's rows before
    it (0 or NULL at the start).  ``derived`` columns are computed in the ordered
    blocks, once, and ``drop`` leaves columns out of them that only make these.
    ``place`` adds the place as well where ``name`` is a running value."""
    from quorum.sources.io import kept
    spark = df.sparkSession
    plain = _is_plain(df)
    source = df if plain else df.persist(StorageLevel.MEMORY_AND_DISK)  # sampled for the ranges, then dealt out
    run = F.xxhash64(*keys, F.lit(1)) if keys else F.lit(0).cast("long")
    placed = source.withColumn("_q_order", F.monotonically_increasing_id()).withColumn("_q_run", run)
    by = [*keys, *order, "_q_order"]
    ordered = (placed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by)
               .sortWithinPartitions(*by).drop("_q_order"))
    for column, made in (derived or {}).items():
        ordered = ordered.withColumn(column, made)
    columns = [c for c in ordered.columns if c not in drop]
    ordered = ordered.select(*columns)
    schema, integral = T.StructType([*ordered.schema.fields, *_LOCAL.fields]), False
    if value is not None:
        integral = how == "sum" and isinstance(ordered.schema[value].dataType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType))
        schema = schema.add("_q_run_value", T.LongType() if integral else T.DoubleType())
    blocks = kept(ordered.mapInArrow(_local(columns, "_q_run", value, how, integral), schema), "blocks")
    if not plain:
        source.unpersist()

    last = {"run": "_q_run", "place": "_q_place", "head": "_q_head"}
    facts = [F.count(F.lit(1)).alias("n"), F.min_by("_q_run", "_q_at").alias("first")]
    facts += [F.max_by(c, "_q_at").alias(k) for k, c in last.items()]
    combine = None
    if value is not None:
        combine = {"sum": lambda a, b: (a or 0) + (b or 0), "min": lambda a, b: b if a is None else a if b is None else min(a, b)}[how]
        facts += [F.max_by("_q_run_value", "_q_at").alias("before"), F.max_by(value, "_q_at").alias("value"),
                  {"sum": F.sum, "min": F.min}[how](value).alias("total")]
    # a row a block, as many as shuffle partitions at most
    found = sorted(blocks.groupBy("_q_block").agg(*facts).collect(), key=lambda r: r["_q_block"])
    offsets, open_run, places, gathered, count, total = [], None, 0, None, 0, None
    for r in found:
        if r["first"] != open_run:
            places, gathered = 0, None
        offsets.append((r["_q_block"], places, gathered if gathered is None or integral else float(gathered)))
        whole = r["head"]  # the block holds one run only
        places = (places if whole else 0) + r["place"] + 1
        if combine:
            own = combine(r["before"], r["value"])
            gathered = combine(gathered, own) if whole else own
            total = combine(total, r["total"])
        open_run, count = r["run"], count + r["n"]
    kind = "long" if integral else "double"
    table = F.broadcast(spark.createDataFrame(offsets, f"_q_block int, _q_places long, _q_gathered {kind}"))
    out = blocks.join(table, "_q_block")
    if value is None:
        out = out.withColumn(name, F.col("_q_place") + F.when(F.col("_q_head"), F.col("_q_places")).otherwise(0))
    elif how == "sum":
        out = out.withColumn(name, F.col("_q_run_value") + F.when(F.col("_q_head"), F.coalesce("_q_gathered", F.lit(0))).otherwise(0))
    else:
        least = F.least("_q_run_value", F.when(F.col("_q_head"), F.col("_q_gathered")))
        out = out.withColumn(name, least.cast(ordered.schema[value].dataType))
    if place:
        out = out.withColumn(place, F.col("_q_place") + F.when(F.col("_q_head"), F.col("_q_places")).otherwise(0))
    return Scan(out.select(*[c for c in columns if c != "_q_run"], name, *([place] if place else [])), count, total)
