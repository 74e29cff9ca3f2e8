"""Prompt tables from distributions.

Everything is one projection over ``dist ⋈ demographics ⋈ steering``:
the steering and demographic tables are metadata (a few rows per
attribute), so they are broadcast; the question split is a join with a
small key table.  No per-group frames, no union loop.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorum.functions import rng, text
from quorum.operators.codes import wave_number
from quorum.operators.groups import recode_group
from quorum.operators.joins import bounded_broadcast

STEERING_TYPES = ("bio", "qa", "portray")


def split_questions(keys: DataFrame, train: float = 0.9, val: float = 0.1, test: float = 0.0,
                    test_waves: Sequence[int] = (), seed: int = 42) -> DataFrame:
    """Question-level split.

    Questions of the dedicated ``test_waves`` (exact wave match, Q8) go to
    test; the others are ranked by md5(seed:qkey) and cut at
    ``bround(train*n)`` / ``bround(val*n)``.  ``keys`` holds distinct
    question keys — a key table, so the global ranking window is small.
    """
    if min(train, val, test) < 0 or abs(train + val + test - 1.0) > 1e-9:
        raise ValueError("ratios must be non-negative and sum to 1")
    k = keys.select("qkey").distinct()
    dedicated = wave_number("qkey").isin(list(test_waves)) if test_waves else F.lit(False)
    rest = k.where(~dedicated)
    w = Window.orderBy(rng.hash_order(seed, F.col("qkey")), "qkey")
    n = F.count(F.lit(1)).over(Window.partitionBy())
    ranked = rest.select("qkey", F.row_number().over(w).alias("rn"), n.alias("n"))
    n_train = F.bround(F.lit(train) * F.col("n"), 0)
    n_val = F.bround(F.lit(val) * F.col("n"), 0)
    split = (F.when(F.col("rn") <= n_train, F.lit("train"))
              .when(F.col("rn") <= n_train + n_val, F.lit("val"))
              .otherwise(F.lit("test")))
    return ranked.select("qkey", split.alias("split")).unionByName(
        k.where(dedicated).select("qkey", F.lit("test").alias("split")))


def sample_tokens(dist, seed, *key_cols, n: int = 100) -> F.Column:
    """``n`` draws from the weights ``dist`` (inverse CDF of hash
    uniforms keyed by the row and draw number) as letters ``" A"``…"""
    from quorum.functions.metrics import let

    def body(d):
        def on_cum(cum):
            total = F.try_element_at(cum, F.lit(-1))

            def draw(i):
                u = rng.hash_uniform(seed, *key_cols, i)
                idx = F.size(F.filter(cum, lambda c: c <= u * total))
                idx = F.least(idx, F.size(cum) - 1)
                return F.concat(F.lit(" "), text.letter(idx))
            return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), draw)
        cum = F.aggregate(d, F.array().cast("array<double>"),
                          lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)),
                                                                          F.lit(0.0)) + x)))
        return let(cum, on_cum)
    return let(dist, body)


def steering_prompt(kind: F.Column, prefix: str = "s_") -> F.Column:
    """Steering text for the row's type: QA = MCQ + chosen letter, BIO/PORTRAY = statement."""
    def c(n):
        return F.col(prefix + n)
    return (F.when(kind == "qa", text.steer_qa(c("qa_prompt"), c("options"), F.col("group_label")))
             .when(kind == "bio", text.steer_statement(c("bio_prompt"), F.col("group_label")))
             .when(kind == "portray", text.steer_statement(c("portray_prompt"), F.col("group_label"))))


def build_prompts(dist: DataFrame, steering: DataFrame, demographics: DataFrame, splits: DataFrame,
                  types: Sequence[str] = STEERING_TYPES, recode: Mapping[tuple[str, str], str] | None = None,
                  seed: int = 42, n_tokens: int = 100, check_groups: bool = True) -> DataFrame:
    """full prompt table.

    dist: ``qkey, attribute, grp, responses, refusal_rate, ordinal,
    question, options``; steering: ``attribute, bio_prompt, qa_prompt,
    portray_prompt, options``; demographics: ``attribute, grp`` (one row per
    steered group); splits: ``qkey, split``.  J8 joins the distribution
    rows on (attribute, recoded group); J4 checks the group is one of the
    steering options (``raise_error`` like the reference's assert).
    """
    s = steering.select("attribute", *[F.col(c).alias(f"s_{c}") for c in steering.columns if c != "attribute"])
    demo = demographics.select("attribute", F.col("grp").alias("group_label"))
    demo = demo.withColumn("grp", recode_group("attribute", "group_label", recode))
    j = (dist.join(bounded_broadcast(demo), ["attribute", "grp"])
             .join(bounded_broadcast(s), "attribute")
             .join(bounded_broadcast(splits), "qkey"))
    if check_groups:  # a filter, so the check cannot be pruned away
        j = j.where(F.when(F.array_contains("s_options", F.col("group_label")), F.lit(True))
                     .otherwise(F.raise_error(F.concat(F.lit("group not in steering options: "),
                                                       F.col("group_label"))).cast("boolean")))
    j = j.withColumn("steering_type", F.explode(F.array(*[F.lit(t) for t in types])))
    survey = text.mcq("question", "options", add_answer_forcing=True)
    out_dist = F.concat("responses", F.array("refusal_rate"))
    out = j.select(
        "qkey", "attribute", F.col("group_label").alias("grp"), "steering_type", "split",
        F.concat(steering_prompt(F.col("steering_type")), survey).alias("input_prompt"),
        out_dist.alias("output_dist"), "ordinal")
    if n_tokens:
        out = out.withColumn("output_token", sample_tokens(
            "output_dist", seed, F.col("qkey"), F.col("attribute"), F.col("grp"), F.col("steering_type"),
            n=n_tokens))
    return out


def except_keys(keys: DataFrame, reserved: DataFrame) -> DataFrame:
    """U4: keys not reserved (left anti join, reserved side broadcast when small)."""
    return keys.join(reserved.select("qkey").distinct(), "qkey", "left_anti")


def refine_prompt(mcq: F.Column, head: str) -> F.Column:
    """a question's text before the first 'Refused', last line dropped,
    stripped, behind the instruction and its worked examples (``head``)."""
    before = F.split(mcq, "Refused").getItem(0)
    return F.concat(F.lit(head), text.strip(F.regexp_replace(before, r"\n[^\n]*$", "")))


def refine_clean(reply: F.Column, mark: str = "Refined question:") -> F.Column:
    """F20 post-processing of a model's reply: without its mark, stripped."""
    return text.strip(F.replace(reply, F.lit(mark), F.lit("")))
