"""Entropy of answers and of joint answers."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum.operators import codes as C
from quorum.operators.joins import bounded_broadcast
from quorum.sources.io import kept


def joint_cells(wide: DataFrame, questions: Sequence[str], sizes: Sequence[int], name: str = "subset") -> DataFrame:
    """``(subset, n)``, a row for each distinct joint answer of the people who
    answered every question of a subset, for all subsets of ``sizes`` questions
    in one pass (grouping sets).  A subset is named by its questions, ``|`` between."""
    cols = [F.when(C.answered(q), F.col(q).cast("double")).alias(q) for q in questions]
    sets = [list(s) for size in sizes for s in itertools.combinations(questions, size)]
    out = F.grouping  # 1: the question is not in the row's subset
    cells = wide.select(*cols).groupingSets(sets, *questions).agg(F.count(F.lit(1)).alias("n"), *[out(q).alias(f"_out_{q}") for q in questions])
    for q in questions:
        cells = cells.where((F.col(f"_out_{q}") == 1) | F.col(q).isNotNull())
    names = F.concat_ws("|", *[F.when(F.col(f"_out_{q}") == 0, F.lit(q)) for q in questions])
    return cells.select(names.alias(name), "n")


def entropy(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, entropy``: -sum p log2(p + 1e-9) over a key's cells (``n`` each),
    divided by log2(#cells) unless there is one.  The totals, a row a key, are
    joined to the cells, whose terms are summed where they lie: no key's cells are gathered."""
    cells = kept(cells, "cells")
    total = cells.groupBy(*keys).agg(F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_m"))
    p = F.col("n") / F.col("_n")
    h = cells.join(bounded_broadcast(total), list(keys)).groupBy(*keys).agg((-F.sum(p * F.log2(p + 1e-9))).alias("_h"), F.first("_m").alias("_m"))
    return h.select(*keys, F.when(F.col("_m") > 1, F.col("_h") / F.log2(F.col("_m").cast("double"))).otherwise(F.col("_h")).alias("entropy"))
