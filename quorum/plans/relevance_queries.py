"""Queries: contingency, AMI relevance, question pairs, top-k."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quorum.operators import relevance as RL
from quorum.operators.groups import exclude_listed
from quorum.plans.distribution_queries import _DIST_VIEWS, _EMD_CTES, cgss_distribution, emd_vs_overall, r9
from quorum.plans.oracle_views import with_views
from quorum.plans.registry import query
from quorum.sources import views as V
from quorum.sources.io import kept, scratch

QUESTIONS = sorted(V.LINE_VARS)
_PAIRS = [(t, o) for i, t in enumerate(QUESTIONS) for o in QUESTIONS[i + 1:]]

_CELLS = "\n  UNION ALL ".join(
    f"SELECT '{t}' AS target, '{o}' AS other, {t} AS a, {o} AS b FROM line_answers "
    f"WHERE {t} IS NOT NULL AND {o} IS NOT NULL" for t, o in _PAIRS)

_CONT_CTES = f"""
cells AS (SELECT target, other, a, b, count(*) AS n FROM (
  {_CELLS}) GROUP BY target, other, a, b),"""

_AMI_CTES = _CONT_CTES + """
tot AS (SELECT target, other, sum(n) AS nn FROM cells GROUP BY target, other),
ra AS (SELECT target, other, a, sum(n) AS ai FROM cells GROUP BY target, other, a),
cb AS (SELECT target, other, b, sum(n) AS bj FROM cells GROUP BY target, other, b),
mi AS (SELECT c.target, c.other, greatest(sum(c.n / t.nn * ln(t.nn * c.n / (r.ai * q.bj))), 0) AS mi
       FROM cells c JOIN tot t ON t.target = c.target AND t.other = c.other
       JOIN ra r ON r.target = c.target AND r.other = c.other AND r.a = c.a
       JOIN cb q ON q.target = c.target AND q.other = c.other AND q.b = c.b GROUP BY c.target, c.other),
hu AS (SELECT r.target, r.other, -sum(r.ai / t.nn * ln(r.ai / t.nn)) AS h, count(*) AS k
       FROM ra r JOIN tot t ON t.target = r.target AND t.other = r.other GROUP BY r.target, r.other),
hv AS (SELECT q.target, q.other, -sum(q.bj / t.nn * ln(q.bj / t.nn)) AS h, count(*) AS k
       FROM cb q JOIN tot t ON t.target = q.target AND t.other = q.other GROUP BY q.target, q.other),
grid AS (SELECT r.target, r.other, CAST(r.ai AS DOUBLE) AS ai, CAST(q.bj AS DOUBLE) AS bj, CAST(t.nn AS DOUBLE) AS nn
         FROM ra r JOIN cb q ON q.target = r.target AND q.other = r.other
         JOIN tot t ON t.target = r.target AND t.other = r.other),
terms AS (SELECT target, other, ai, bj, nn, CAST(unnest(range(CAST(greatest(1, ai + bj - nn) AS BIGINT),
                                                     CAST(least(ai, bj) AS BIGINT) + 1)) AS DOUBLE) AS x FROM grid),
emi AS (SELECT target, other, sum(x / nn * ln(nn * x / (ai * bj)) * exp(lgamma(ai + 1) + lgamma(bj + 1) + lgamma(nn - ai + 1)
               + lgamma(nn - bj + 1) - lgamma(nn + 1) - lgamma(x + 1) - lgamma(ai - x + 1) - lgamma(bj - x + 1)
               - lgamma(nn - ai - bj + x + 1))) AS emi FROM terms GROUP BY target, other),
ami AS (SELECT t.target, t.other, t.nn,
               CASE WHEN t.nn < 100 THEN -1e9
                    WHEN u.k = 1 AND v.k = 1 THEN 1.0 / ln(2)
                    ELSE greatest((m.mi - e.emi) / (0.5 * (u.h + v.h) - e.emi), 0) / ln(2) END AS rel
        FROM tot t JOIN mi m ON m.target = t.target AND m.other = t.other
        JOIN hu u ON u.target = t.target AND u.other = t.other JOIN hv v ON v.target = t.target AND v.other = t.other
        JOIN emi e ON e.target = t.target AND e.other = t.other),
rel AS (SELECT target, other AS qkey, nn AS n_joint, rel AS relevance FROM ami
        UNION ALL SELECT other, target, nn, rel FROM ami)"""


def _ami(spark, sf_dir):
    return RL.ami_pairs(RL.contingency(V.line_answers(spark, sf_dir), QUESTIONS))


@query("contingency", with_views("line_answers", ctes=_CONT_CTES) + "SELECT target, other, a, b, n FROM cells")
def q_contingency(spark, sf_dir):
    return RL.contingency(V.line_answers(spark, sf_dir), QUESTIONS)


@query("ami_pairs", with_views("line_answers", ctes=_AMI_CTES) +
       "SELECT target, qkey, CAST(n_joint AS BIGINT) AS n_joint, round(relevance, 6) AS relevance FROM rel")
def q_ami_pairs(spark, sf_dir):
    return _ami(spark, sf_dir).select("target", "qkey", "n_joint", F.round("relevance", 6).alias("relevance"))


@query("question_pairs", with_views("line_responses") + """
SELECT t.qkey AS target, q.qkey FROM (SELECT DISTINCT qkey FROM line_responses) t,
     (SELECT DISTINCT qkey FROM line_responses) q WHERE t.qkey <> q.qkey""")
def q_question_pairs(spark, sf_dir):
    return RL.question_pairs(V.line_responses(spark, sf_dir))


@query("topk_pairwise", with_views("line_answers", ctes=_AMI_CTES) + """
SELECT target, qkey, rank, round(relevance, 6) AS relevance FROM (
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY relevance DESC, qkey) AS rank FROM rel
  WHERE relevance >= 0) WHERE rank <= 2""")
def q_topk_pairwise(spark, sf_dir):
    t = RL.topk_pairwise(_ami(spark, sf_dir), 2)
    return t.select("target", "qkey", "rank", F.round("relevance", 6).alias("relevance"))


def _ami_ctes(pre: str, cells: str) -> str:
    """AMI (x log2 e, clipped at 0) per candidate from a cells CTE
    ``(cand, a, b, n)``, every CTE name prefixed by ``pre``."""
    return f"""
{pre}tot AS (SELECT cand, sum(n) AS nn FROM {cells} GROUP BY cand),
{pre}ra AS (SELECT cand, a, sum(n) AS ai FROM {cells} GROUP BY cand, a),
{pre}cb AS (SELECT cand, b, sum(n) AS bj FROM {cells} GROUP BY cand, b),
{pre}mi AS (SELECT c.cand, greatest(sum(c.n / t.nn * ln(t.nn * c.n / (r.ai * q.bj))), 0) AS mi
            FROM {cells} c JOIN {pre}tot t ON t.cand = c.cand JOIN {pre}ra r ON r.cand = c.cand AND r.a = c.a
            JOIN {pre}cb q ON q.cand = c.cand AND q.b = c.b GROUP BY c.cand),
{pre}hu AS (SELECT r.cand, -sum(r.ai / t.nn * ln(r.ai / t.nn)) AS h FROM {pre}ra r JOIN {pre}tot t ON t.cand = r.cand
            GROUP BY r.cand),
{pre}hv AS (SELECT q.cand, -sum(q.bj / t.nn * ln(q.bj / t.nn)) AS h FROM {pre}cb q JOIN {pre}tot t ON t.cand = q.cand
            GROUP BY q.cand),
{pre}grid AS (SELECT r.cand, CAST(r.ai AS DOUBLE) AS ai, CAST(q.bj AS DOUBLE) AS bj, CAST(t.nn AS DOUBLE) AS nn
              FROM {pre}ra r JOIN {pre}cb q ON q.cand = r.cand JOIN {pre}tot t ON t.cand = r.cand),
{pre}terms AS (SELECT cand, ai, bj, nn, CAST(unnest(range(CAST(greatest(1, ai + bj - nn) AS BIGINT),
                                                    CAST(least(ai, bj) AS BIGINT) + 1)) AS DOUBLE) AS x FROM {pre}grid),
{pre}emi AS (SELECT cand, sum(x / nn * ln(nn * x / (ai * bj)) * exp(lgamma(ai + 1) + lgamma(bj + 1) + lgamma(nn - ai + 1)
             + lgamma(nn - bj + 1) - lgamma(nn + 1) - lgamma(x + 1) - lgamma(ai - x + 1) - lgamma(bj - x + 1)
             - lgamma(nn - ai - bj + x + 1))) AS emi FROM {pre}terms GROUP BY cand),
{pre}rel AS (SELECT t.cand, CASE WHEN t.nn < 100 THEN -1e9
                    ELSE greatest((m.mi - e.emi) / (0.5 * (u.h + v.h) - e.emi), 0) / ln(2) END AS rel
             FROM {pre}tot t JOIN {pre}mi m ON m.cand = t.cand JOIN {pre}hu u ON u.cand = t.cand
             JOIN {pre}hv v ON v.cand = t.cand JOIN {pre}emi e ON e.cand = t.cand)"""


_GREEDY_TARGET = "QTY"
_OTHERS = [q for q in QUESTIONS if q != _GREEDY_TARGET]
_C1 = "\n  UNION ALL ".join(
    f"SELECT '{c}' AS cand, {_GREEDY_TARGET} AS a, CAST({c} AS VARCHAR) AS b FROM line_answers "
    f"WHERE {_GREEDY_TARGET} IS NOT NULL AND {c} IS NOT NULL" for c in _OTHERS)
_C2 = "\n  UNION ALL ".join(
    f"SELECT '{c}' AS cand, l.{_GREEDY_TARGET} AS a, CASE s.best "
    + " ".join(f"WHEN '{o}' THEN CAST(l.{o} AS VARCHAR)" for o in _OTHERS)
    + f" END || '|' || CAST(l.{c} AS VARCHAR) AS b FROM line_answers l CROSS JOIN s1 s "
    f"WHERE s.best <> '{c}' AND l.{_GREEDY_TARGET} IS NOT NULL AND l.{c} IS NOT NULL AND CASE s.best "
    + " ".join(f"WHEN '{o}' THEN l.{o}" for o in _OTHERS) + " END IS NOT NULL" for c in _OTHERS)

GREEDY_SQL = with_views("line_answers", ctes=f"""
c1raw AS ({_C1}),
c1 AS (SELECT cand, a, b, count(*) AS n FROM c1raw GROUP BY cand, a, b),""" + _ami_ctes("g1", "c1") + f""",
s1 AS (SELECT cand AS best, rel AS best_rel FROM g1rel ORDER BY rel DESC, cand LIMIT 1),
c2raw AS ({_C2}),
c2 AS (SELECT cand, a, b, count(*) AS n FROM c2raw GROUP BY cand, a, b),""" + _ami_ctes("g2", "c2") + """,
s2 AS (SELECT cand AS best, rel AS best_rel FROM g2rel ORDER BY rel DESC, cand LIMIT 1)""") + f"""
SELECT '{_GREEDY_TARGET}' AS target, best AS qkey, 1 AS step, round(best_rel, 6) AS gain FROM s1
UNION ALL SELECT '{_GREEDY_TARGET}', s2.best, 2, round(s2.best_rel - s1.best_rel, 6) FROM s2 CROSS JOIN s1"""


@query("topk_greedy", GREEDY_SQL)
def q_topk_greedy(spark, sf_dir):
    wide = V.line_answers(spark, sf_dir)
    g = RL.topk_greedy(wide, _GREEDY_TARGET, QUESTIONS, 2)
    return g.select("target", "qkey", "step", F.round("gain", 6).alias("gain"))


# ---- X2: scores of a sub-population, remembered from call to call
_SUBPOP = "BUILDING"


@query("relevance_remembered", with_views("line_answers", ctes=_AMI_CTES.replace(
    "FROM line_answers", f"FROM (SELECT * FROM line_answers WHERE segment = '{_SUBPOP}')")) +
    "SELECT target, qkey, CAST(n_joint AS BIGINT) AS n_joint, round(relevance, 6) AS relevance FROM rel")
def q_relevance_remembered(spark, sf_dir):
    """Every ordered pair within a segment, in three calls on one table of
    scores: one target, one target for everybody (which shares no entry), all pairs."""
    wide = V.line_answers(spark, sf_dir, segment=True)
    qa = F.explode(F.array(*[F.struct(F.lit(q).alias("qkey"), F.col(q).alias("code")) for q in QUESTIONS])).alias("qa")
    wide = wide.withColumn("human_id", F.monotonically_increasing_id())  # a line is a respondent; order and line number may repeat
    answers = kept(wide.select("human_id", "segment", qa).select("human_id", "segment", "qa.*").where("code is not null"), "answers")
    pairs, path = kept(RL.question_pairs(answers), "pairs"), scratch(spark, "relevance")
    RL.remembered_relevance(path, answers, pairs.where(F.col("target") == QUESTIONS[0]), "segment", _SUBPOP)
    RL.remembered_relevance(path, answers, pairs.where(F.col("target") == QUESTIONS[1]))
    out = RL.remembered_relevance(path, answers, pairs, "segment", _SUBPOP)
    return out.select("target", "qkey", "n_joint", F.round("relevance", 6).alias("relevance"))


# ---- P14: the questions whose answers tell each other's
NEAR = 0.0005
_NEAR_CTES = _EMD_CTES + """,
ans AS (SELECT human_id, wave, qkey, code FROM responses WHERE code IS NOT NULL),
cells AS (SELECT p.qkey AS target, s.qkey AS other, p.code AS a, s.code AS b, count(*) AS n
          FROM ans p JOIN ans s ON s.human_id = p.human_id AND p.qkey < s.qkey GROUP BY ALL),
""" + re.sub(r"\btot\b", "rtot", _AMI_CTES[_AMI_CTES.index("tot AS"):]) + f""",
ks AS (SELECT qkey, row_number() OVER (ORDER BY md5('42:' || qkey)) AS r FROM (SELECT DISTINCT qkey FROM rel)),
nb AS (SELECT ks.qkey, ks.r, coalesce(list(e.qkey) FILTER (e.qkey IS NOT NULL), []) AS near
       FROM ks LEFT JOIN rel e ON e.target = ks.qkey AND e.relevance >= {NEAR} GROUP BY ks.qkey, ks.r),
walk AS (SELECT stay, n FROM (WITH RECURSIVE g(n, stay) AS (
           SELECT 0, CAST([] AS VARCHAR[]) UNION ALL
           SELECT g.n + 1, CASE WHEN list_has_any(g.stay, nb.near) THEN g.stay ELSE list_append(g.stay, nb.qkey) END
           FROM g JOIN nb ON nb.r = g.n + 1) SELECT * FROM g) ORDER BY n DESC LIMIT 1)"""


@query("exclude_relevant", with_views(*_DIST_VIEWS, ctes=_NEAR_CTES) + """
SELECT qkey, attribute, grp, round(CASE WHEN rng = 0 THEN NULL ELSE s / rng END, 9) AS emd FROM emdt
WHERE qkey NOT IN (SELECT qkey FROM ks) OR qkey IN (SELECT unnest(stay) FROM walk)""")
def q_exclude_relevant(spark, sf_dir):
    """EMD rows without near-duplicate questions: those whose answers by the
    same people are relevant for each other, but for a maximal independent set."""
    answers = V.responses(spark, sf_dir).select("human_id", "qkey", "code")
    keys = answers.select("qkey").distinct()
    cont = RL.contingency_long(answers, keys, keys).where("target < other")
    listed = RL.near_duplicates(kept(RL.ami_pairs(cont), "relevance"), NEAR)
    e = exclude_listed(emd_vs_overall(cgss_distribution(spark, sf_dir)), listed)
    return e.select("qkey", "attribute", "grp", r9("emd").alias("emd"))
