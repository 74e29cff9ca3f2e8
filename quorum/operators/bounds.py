"""WD lower bound by bootstrap (F12): multinomial counts, an Arrow pass over the rows.

Spark deals the rows; a task draws the samples of a row at once for all
repeats, as NumPy arrays of options by repeats, and measures them by the ordinal
distance of ``functions.metrics.emd``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorum.functions import rng
from quorum.functions.metrics import ZERO_TOL


def sorted_uniforms(spark: SparkSession, n: int, repeats: int, sides: int = 2, seed: int = 42) -> DataFrame:
    """(b, u): for each repeat, ``sides`` sorted arrays of ``n`` hash-uniform
    numbers (u of md5 seed:repeat:side:draw).  Its size follows from the parameters
    alone, whatever the number of rows that draw from it."""
    def side(k: int) -> Column:
        return F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: rng.hash_uniform(seed, F.col("b"), k, i)))
    return spark.range(1, repeats + 1).select(F.col("id").cast("int").alias("b")).select("b", F.array(*[side(k + 1) for k in range(sides)]).alias("u"))


def count_below(sorted_values: Column, x: Column, n: int) -> Column:
    """How many of a sorted array's ``n`` values are below ``x``: a binary search."""
    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(sorted_values, at + step - 1) < x, at + step).otherwise(at))


class Uniforms:
    """Sorted arrays of uniforms (a row each), merged into one list with how many
    of each array lie before every ``step``-th place of it."""

    def __init__(self, u: np.ndarray):
        self.arrays, self.n = u.shape
        order = np.argsort(u, axis=None, kind="stable")
        self.merged, self.of = u.ravel()[order], order // self.n
        self.step = max(1024, self.arrays)
        parts = [np.bincount(self.of[at:at + self.step], minlength=self.arrays) for at in range(0, len(order), self.step)]
        self.before = np.cumsum([np.zeros(self.arrays, np.int64), *parts], axis=0)

    def below(self, x: np.ndarray) -> np.ndarray:
        """How many of every array's values are below each of ``x`` (x by arrays)."""
        places = np.searchsorted(self.merged, x)
        out = self.before[places // self.step]
        for row, place in zip(out, places):
            row += np.bincount(self.of[place // self.step * self.step:place], minlength=self.arrays)
        return out


def cdf(weights: np.ndarray) -> np.ndarray:
    """Running sums over the whole."""
    upto = np.cumsum(weights)
    return upto / upto[-1]


def multinomial_counts(u: Uniforms, weights: np.ndarray, shift: float) -> np.ndarray:
    """The counts (options by arrays) of a multinomial sample from each array of
    uniforms.  They are turned by ``shift`` on the circle, which makes each row's
    draws its own: the count up to c is that up to c - shift, from 0 - shift
    on.  The last option takes what is left."""
    ends = np.concatenate([[0.0], cdf(weights)[:-1]]) - shift
    g = u.below(np.where(ends < 0, ends + 1, ends)) - np.where(ends < 0, u.n, 0)[:, None]
    return np.diff(np.concatenate([g - g[0], np.full((1, u.arrays), u.n)]), axis=0)


def distances(p: np.ndarray, q: np.ndarray, ordinal: list) -> np.ndarray:
    """``metrics.emd`` of the samples ``p`` and ``q`` (options by repeats),
    those that are undefined left out."""
    known = [x for x in ordinal if x is not None]
    used = [k for k, x in enumerate(ordinal) if x is not None and x >= 0] or ([] if len(known) < len(ordinal) else list(range(len(ordinal))))
    order = sorted(used, key=ordinal.__getitem__)
    o = np.array([ordinal[k] for k in order])
    if not len(o) or max(known) == min(known) or o[-1] == o[0]:
        return np.zeros(0)
    whole = p[order].sum(axis=0), q[order].sum(axis=0)
    some = (np.abs(whole[0]) > ZERO_TOL) & (np.abs(whole[1]) > ZERO_TOL)
    gaps = [np.cumsum(x[order][:-1, some], axis=0) / w[some] for x, w in zip((p, q), whole)]
    return np.diff(o) @ np.abs(gaps[0] - gaps[1]) / (o[-1] - o[0])


def _means(df: DataFrame, key: str, gold: str, ordinal: str, own: Column, measure: Callable, name: str) -> DataFrame:
    """``(key, name)``: the mean over all rows of a key of what
    ``measure(gold, ordinal, own)`` gives for a row; NULL where that is nothing."""
    schema = T.StructType([df.schema[key], T.StructField("_sum", T.DoubleType()), T.StructField("_n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for g, o, x in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                values = measure(g, o, x) if g and o else ()
                found.append((float(np.sum(values)), len(values)))
            sums, counts = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.float64()), pa.array(counts, pa.int64())], [key, "_sum", "_n"])

    rows = df.select(key, F.col(gold).cast("array<double>"), F.col(ordinal).cast("array<double>"), own.alias("_own"))
    return rows.mapInArrow(run, schema).groupBy(key).agg(F.try_divide(F.sum("_sum"), F.sum("_n")).alias(name))


def wd_lower_draws(df: DataFrame, n_per_side: int, n_bootstrap: int, seed: int = 42, key: str = "row_idx",
                   gold: str = "gold", ordinal: str = "ordinal") -> DataFrame:
    """The bound from hash-uniform draws (u of md5 seed:key:repeat:side:draw):
    for small n and B, where every draw can be hashed.  A draw is the first
    option whose share of the distribution function is above u, and the first
    of all in a row without mass.  Undefined repeats are left out of the mean."""
    draws = [f":{b}:{side}:{i}".encode() for side in (1, 2) for b in range(1, n_bootstrap + 1) for i in range(1, n_per_side + 1)]
    sample = np.repeat(np.arange(2 * n_bootstrap), n_per_side)

    def measure(g: list, o: list, begin: str) -> np.ndarray:
        start = begin.encode()
        u = np.frombuffer(b"".join([hashlib.md5(start + d).digest()[:4] for d in draws]), ">u4") / rng.TWO_32
        upto = cdf(np.array(g)) if None not in g and sum(g) != 0 else np.zeros(0)
        option = np.minimum((upto[:, None] <= u).sum(axis=0), len(g) - 1)
        counts = np.bincount(sample * len(g) + option, minlength=2 * n_bootstrap * len(g)).reshape(-1, len(g)).T / n_per_side
        return distances(counts[:, :n_bootstrap], counts[:, n_bootstrap:], o)
    return _means(df, key, gold, ordinal, F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), measure, "wd_lower")


def wd_lower_bootstrap(df: DataFrame, n_per_side: int = 500, n_bootstrap: int = 500, seed: int = 42,
                       key: str = "row_idx", gold: str = "gold", ordinal: str = "ordinal") -> DataFrame:
    """Mean EMD between two Multinomial(n, gold) draws over ``n_bootstrap``
    repeats, per row; undefined repeats are left out, and a row without mass has
    NULL.  A row looks its distribution function up in sorted uniforms, turned
    by its own hash: a place in all of them at once by one search in their merged
    list, so a sample depends on the key alone, not on partitioning or retries."""
    drawn = sorted_uniforms(df.sparkSession, n_per_side, n_bootstrap, 2, seed).orderBy("b").collect()  # 16 n B bytes by its parameters
    u, held = np.array([r["u"] for r in drawn]).transpose(1, 0, 2).reshape(-1, n_per_side), []

    def measure(g: list, o: list, shift: float) -> np.ndarray | tuple:
        if None in g or not sum(g) > 0:
            return ()
        if not held:
            held.append(Uniforms(u))
        counts = multinomial_counts(held[0], np.array(g), shift)
        return distances(counts[:, :n_bootstrap], counts[:, n_bootstrap:], o)
    return _means(df, key, gold, ordinal, rng.hash_uniform(seed, F.col(key)), measure, "wd_lower_bootstrap_mean").select(
        key, "wd_lower_bootstrap_mean", F.lit(n_per_side).alias("n_per_side"), F.lit(n_bootstrap).alias("n_bootstrap"))
