"""Queries: user hooks — batch scoring, refinement, builder registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorum.functions import metrics as M
from quorum.operators import scoring as SC
from quorum.operators.joins import bounded_broadcast
from quorum.plans.registry import query
from quorum.sources.driver import table


@SC.register("survey_prompts")
def _b_survey_prompts(spark, sf_dir):
    from quorum.plans.prompt_queries import prompt_table
    return prompt_table(spark, sf_dir, n_tokens=0)


@SC.register("instructions")
def _b_instructions(spark, sf_dir):
    from quorum.operators.safety import instruction_prompt
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("Summarize the text from "), "source").alias("instruction"),
        F.col("text").alias("input"))
    return d.select("doc_id", instruction_prompt("instruction", "input").alias("prompt"))


@SC.register("dialogues")
def _b_dialogues(spark, sf_dir):
    from quorum.operators.safety import dialog_prompt
    return dialog_prompt(table(spark, sf_dir, "conversations"))


@SC.register("moderation")
def _b_moderation(spark, sf_dir):
    from quorum.plans.safety_queries import moderation_examples
    return moderation_examples(spark, sf_dir)


def _dialog_sql():
    from quorum.plans import safety_queries  # noqa: F401  (registers dialog_prompt and its oracle)
    from quorum.plans.registry import ORACLES
    return ORACLES["dialog_prompt"]


@query("registry", _dialog_sql())
def q_registry(spark, sf_dir):
    return SC.get_builder("dialogues")(spark, sf_dir)


def _scored_prompts(spark, sf_dir):
    """Prompts of every steering type, scored by the whole population's answer shares."""
    from quorum.operators.distribution import OVERALL
    from quorum.plans.distribution_queries import cgss_distribution
    from quorum.plans.prompt_queries import prompt_table
    overall = cgss_distribution(spark, sf_dir).where(F.col("attribute") == OVERALL).select("qkey", F.col("responses").alias("shares"))
    p = prompt_table(spark, sf_dir, n_tokens=0).withColumn("k", F.size("ordinal")).join(bounded_broadcast(overall), "qkey")
    return SC.batch_score(p.select("qkey", "attribute", "grp", "steering_type", "input_prompt", "k", "shares"), "input_prompt", "k",
                          SC.share_predictor, "shares")


def _batch_sql():
    from quorum.plans.distribution_queries import _DIST_VIEWS
    from quorum.plans.oracle_views import with_views
    from quorum.plans.prompt_queries import _PROMPT_CTES
    return with_views(*_DIST_VIEWS, ctes=_PROMPT_CTES + """
ov AS (SELECT qkey, opt_idx AS j, p + 1e-6 AS pr, sum(p + 1e-6) OVER (PARTITION BY qkey) AS s FROM dist WHERE attribute = 'Overall')""") + """
SELECT p.qkey, p.attribute, p.grp, p.steering_type, ov.j, round(ov.pr / ov.s, 9) AS prob, round(ov.s, 9) AS prob_sum
FROM pr p JOIN ov ON ov.qkey = p.qkey"""


@query("batch_score", _batch_sql())
def q_batch_score(spark, sf_dir):
    s = _scored_prompts(spark, sf_dir)
    keys = ["qkey", "attribute", "grp", "steering_type"]
    p = s.select(*keys, M.option_probs("logprobs", "k").alias("raw")).select(
        *keys, M.normalize("raw").alias("prob"), M.array_sum("raw").alias("prob_sum"))
    return (p.select(*keys, "prob_sum", F.posexplode("prob").alias("i", "prob"))
             .select(*keys, (F.col("i") + 1).alias("j"), F.round("prob", 9).alias("prob"), F.round("prob_sum", 9).alias("prob_sum")))


def demo_refiner(text: str) -> str:
    """A deterministic refiner: trims, squeezes blanks, ends with '?'; it
    fails on empty questions (to show error isolation)."""
    t = " ".join(text.split())
    if not t:
        raise ValueError("empty question")
    return t if t.endswith("?") else t + "?"


def _refine_sql():
    from quorum.plans.prompt_queries import _MCQ_SQL
    return _MCQ_SQL + """,
qq AS (SELECT qkey, trim(regexp_replace(regexp_replace(split_part(mcq, chr(10) || 'A. ', 1), '^Question: ?', ''), '\\s+', ' ', 'g')) AS q FROM m)
SELECT qkey, CASE WHEN q = '' THEN NULL WHEN suffix(q, '?') THEN q ELSE q || '?' END AS refined,
       CASE WHEN q = '' THEN 'ValueError: empty question' END AS error FROM qq"""


@query("refine_batch", _refine_sql())
def q_refine_batch(spark, sf_dir):
    from quorum.plans.prompt_queries import _question_mcq
    m = _question_mcq(spark, sf_dir).select("qkey", F.split("mcq", "\nA\\. ").getItem(0).alias("q"))  # all of it, up to the options
    m = m.withColumn("q", F.regexp_replace("q", "^Question: ?", ""))
    return SC.refine_batch(m, "qkey", "q", demo_refiner, max_retries=2, base_delay=0.001)
