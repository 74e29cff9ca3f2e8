"""Per-person answer lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorum.operators import codes as C
from quorum.operators.joins import bounded_broadcast, with_keys_of


def responses_in(resp: DataFrame, members: DataFrame, key: str = "human_id") -> DataFrame:
    """Answers of the people listed in ``members`` (left semi join).

    Spark sizes the id side at run time (AQE): a small list is broadcast,
    a large one goes through a sort-merge semi join."""
    return resp.join(members.select(key).distinct(), key, "left_semi")


def drop_refusal(resp: DataFrame, codebook: DataFrame) -> DataFrame:
    """Drop answers equal to the question's refusal code (last label)."""
    ref = codebook.groupBy("var").agg(F.max_by("code", "pos").alias("_ref"))
    return (resp.join(bounded_broadcast(ref), "var", "left")
                .where(F.col("_ref").isNull() | (F.col("code") != F.col("_ref"))).drop("_ref"))


def joint_responses_wide(df: DataFrame, qkeys: Sequence[str], key: str = "human_id") -> DataFrame:
    """J2 on wide data (one row per person, one column per question): the
    people who answered every question, with their answers in question
    order.  No shuffle: it is a row filter."""
    ok = [C.answered(q) for q in qkeys]
    cond = ok[0]
    for c in ok[1:]:
        cond = cond & c
    return df.where(cond).select(key, F.array(*[F.col(q).cast("double") for q in qkeys]).alias("codes"))


def joint_responses_long(resp: DataFrame, qkeys: Sequence[str], key: str = "human_id",
                         order: str | None = None) -> DataFrame:
    """J2 on long data ``(key, qkey, code)``: group by person once, keep
    people with all ``n`` questions, answers ordered by question position.
    Of several answers to a question the last in ``order`` wins (as in a dict);
    without an order column, the largest code."""
    pos = F.array_position(F.array(*[F.lit(q) for q in qkeys]), F.col("qkey"))
    r = resp.where(F.col("qkey").isin(list(qkeys)) & C.answered("code")).withColumn("_pos", pos)
    last = F.max_by("code", F.struct(order, "code")) if order else F.max("code")
    g = (r.groupBy(key, "_pos").agg(last.alias("code")).groupBy(key)
          .agg(F.map_from_entries(F.collect_list(F.struct("_pos", "code"))).alias("_m")))
    n = len(qkeys)
    return (g.where(F.size("_m") == n)
             .select(key, F.transform(F.sequence(F.lit(1), F.lit(n)),
                                      lambda i: F.element_at("_m", i.cast("int"))).alias("codes")))


def weight_column(columns: Sequence[str], wave: int) -> str:
    """The wave's weight column, found by its name pattern
    ``weight_*_w<wave>`` (case-insensitive) — schema metadata."""
    for c in columns:
        lc = c.lower()
        if "weight_" in lc and f"_w{wave}" in lc:
            return c
    raise KeyError(f"no weight column for wave {wave}")


def wave_weights(wave_df: DataFrame, wave: int, key: str = "QKEY") -> DataFrame:
    """``(key, weight)`` of a wave table; carried in the same scan."""
    return wave_df.select(key, F.col(weight_column(wave_df.columns, wave)).alias("weight"))


def lookup_responses(lookups: DataFrame, resp: DataFrame, codebook: DataFrame) -> DataFrame:
    """``(human_id, qkey)`` lookups -> ``(idx, label)``.

    idx = option position (0-based, label order); -1 = the refusal (last)
    label; -2 = in the wave but no (labelled) answer; -3 = not in the wave.
    Answers of people whom no lookup names are left out before the join.
    """
    ans = with_keys_of(resp, lookups, "human_id").select("human_id", "qkey", "var", "code", F.lit(True).alias("_in"))
    cb = codebook.withColumn("_maxpos", F.max("pos").over(Window.partitionBy("var")))
    j = (lookups.join(ans, ["human_id", "qkey"], "left")
                .join(bounded_broadcast(cb.select("var", "code", "pos", "label", "_maxpos")), ["var", "code"], "left"))
    idx = (F.when(F.col("_in").isNull(), F.lit(-3))
            .when(F.col("pos").isNull(), F.lit(-2))
            .when(F.col("pos") == F.col("_maxpos"), F.lit(-1))
            .otherwise(F.col("pos") - 1))
    # The two labels of lookups without an answer
    lab = (F.when(F.col("_in").isNull(), F.lit("Not participated for wave"))
            .when(F.col("pos").isNull(), F.lit("Nan response"))
            .otherwise(F.col("label")))
    return j.select("human_id", "qkey", idx.cast("int").alias("idx"), lab.alias("label"))


def intersect_ids(a: DataFrame, b: DataFrame, key: str = "human_id") -> DataFrame:
    """Ids present in both (distinct)."""
    return a.select(key).intersect(b.select(key))
