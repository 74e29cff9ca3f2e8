"""Queries: distributions, refusal rates, EMD against Overall."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorum.functions import metrics as M
from quorum.operators import distribution as D
from quorum.plans.oracle_views import with_views
from quorum.plans.registry import query
from quorum.sources import views as V


def r9(c):
    return F.round(c, 9)


def cgss_distribution(spark: SparkSession, sf_dir: str, k: int = 1, report: bool = False) -> DataFrame:
    return D.distribution_cgss(
        V.responses(spark, sf_dir), V.codebook(spark), V.question_policy(spark), V.variables(spark),
        V.group_codes(spark), V.ATTRIBUTE_COLUMNS, V.GLOBAL_INVALID, V.GLOBAL_REFUSAL,
        k=k, with_report=report)


def emd_vs_overall(dist: DataFrame) -> DataFrame:
    """Each group's distribution against the same question's Overall one.

    The Overall row is found with a window over the question's rows (one
    row per group: metadata-sized partitions), so the distribution is
    computed once — a self-join would rebuild it from the raw answers.
    Also carries the question's Overall refusal rate."""
    w = Window.partitionBy("qkey")
    is_ov = F.col("attribute") == D.OVERALL
    d = (dist.withColumn("overall_responses", F.first(F.when(is_ov, F.col("responses")), ignorenulls=True).over(w))
             .withColumn("overall_refusal_rate", F.max(F.when(is_ov, F.col("refusal_rate"))).over(w))
             .where(F.col("overall_responses").isNotNull()))
    return d.select("qkey", "attribute", "grp", "refusal_rate", "overall_refusal_rate",
                    M.emd("responses", "overall_responses", "ordinal").alias("emd"))


# ----------------------------------------------------------------- oracle

_REFUSED = "((var = 'PRIORITY' AND code IN (4)) OR (var <> 'PRIORITY' AND code IN (-3, 98, 99)))"
_INVALID = "(code IN (-8, -7, -5, -4, -1, 0))"

_MEMB = """
memb AS (
  SELECT r.qkey, r.var, r.code, r.weight, 'Overall' AS attribute, 'Overall' AS grp FROM responses r
  UNION ALL SELECT r.qkey, r.var, r.code, r.weight, g.attribute, g.grp
    FROM responses r JOIN group_codes g ON g.attribute = 'SEGMENT' AND g.code = r.segment
  UNION ALL SELECT r.qkey, r.var, r.code, r.weight, g.attribute, g.grp
    FROM responses r JOIN group_codes g ON g.attribute = 'REGION' AND g.code = r.region
  UNION ALL SELECT r.qkey, r.var, r.code, r.weight, g.attribute, g.grp
    FROM responses r JOIN group_codes g ON g.attribute = 'BALANCE' AND g.code = CAST(r.balance_code AS VARCHAR)
),"""

def _dist_ctes(memb: str) -> str:
    return memb + f"""
base AS (SELECT * FROM memb WHERE code IS NOT NULL AND NOT isnan(code) AND weight IS NOT NULL
         AND NOT isnan(weight) AND weight > 0 AND weight < CAST('inf' AS DOUBLE)),
cls AS (SELECT *, CASE WHEN {_REFUSED} THEN 'refused' WHEN {_INVALID} THEN 'invalid' ELSE 'valid' END AS status
        FROM base),
opts AS (SELECT var, code, trim(label) AS label, row_number() OVER (PARTITION BY var ORDER BY code) AS opt_idx
         FROM codebook WHERE NOT {_REFUSED} AND NOT {_INVALID}),
valid AS (SELECT c.qkey, c.var, c.attribute, c.grp, o.opt_idx, sum(c.weight) AS w
          FROM cls c JOIN opts o ON o.var = c.var AND o.code = c.code
          WHERE c.status = 'valid' GROUP BY c.qkey, c.var, c.attribute, c.grp, o.opt_idx),
tot AS (SELECT qkey, var, attribute, grp,
               sum(CASE WHEN status = 'refused' THEN weight ELSE 0 END) AS ref_w
        FROM cls GROUP BY qkey, var, attribute, grp),
vt AS (SELECT qkey, attribute, grp, sum(w) AS valid_w FROM valid GROUP BY qkey, attribute, grp),
keys AS (SELECT t.qkey, t.var, t.attribute, t.grp, coalesce(v.valid_w, 0) AS valid_w, t.ref_w
         FROM tot t LEFT JOIN vt v ON v.qkey = t.qkey AND v.attribute = t.attribute AND v.grp = t.grp
         WHERE t.var IN (SELECT var FROM opts)),
ok AS (SELECT * FROM keys WHERE valid_w + ref_w > 0 AND abs(valid_w) > 1e-8),
dist AS (
  SELECT k.qkey, k.attribute, k.grp, o.opt_idx, o.label AS option,
         coalesce(v.w, 0) / k.valid_w AS p, k.ref_w / (k.valid_w + k.ref_w) AS refusal_rate,
         CAST(o.opt_idx AS DOUBLE) AS ordinal
  FROM ok k JOIN opts o ON o.var = k.var
  LEFT JOIN valid v ON v.qkey = k.qkey AND v.attribute = k.attribute AND v.grp = k.grp AND v.opt_idx = o.opt_idx
),"""


_DIST_CTES = _dist_ctes(_MEMB)

_DIST_VIEWS = ("responses", "codebook", "group_codes")

DIST_SQL = with_views(*_DIST_VIEWS, ctes=_DIST_CTES) + """
SELECT qkey, attribute, grp, opt_idx, option, round(p, 9) AS p, round(refusal_rate, 9) AS refusal_rate, ordinal
FROM dist"""

REFUSAL_SQL = with_views(*_DIST_VIEWS, ctes=_DIST_CTES) + """
SELECT DISTINCT qkey, attribute, grp, round(refusal_rate, 9) AS refusal_rate FROM dist"""

_EMD_CTES = _DIST_CTES + """
cum AS (SELECT qkey, attribute, grp, opt_idx, ordinal, refusal_rate,
               sum(p) OVER (PARTITION BY qkey, attribute, grp ORDER BY opt_idx ROWS UNBOUNDED PRECEDING) AS cp,
               lead(ordinal) OVER (PARTITION BY qkey, attribute, grp ORDER BY opt_idx) AS next_o
        FROM dist),
emdt AS (SELECT g.qkey, g.attribute, g.grp, g.refusal_rate,
                sum(CASE WHEN g.next_o IS NULL THEN 0 ELSE abs(g.cp - o.cp) * (g.next_o - g.ordinal) END) AS s,
                max(g.ordinal) - min(g.ordinal) AS rng
         FROM cum g JOIN cum o ON o.qkey = g.qkey AND o.attribute = 'Overall' AND o.opt_idx = g.opt_idx
         GROUP BY g.qkey, g.attribute, g.grp, g.refusal_rate)"""

EMD_SQL = with_views(*_DIST_VIEWS, ctes=_EMD_CTES) + """
SELECT qkey, attribute, grp, round(refusal_rate, 9) AS refusal_rate,
       round(CASE WHEN rng = 0 THEN NULL ELSE s / rng END, 9) AS emd
FROM emdt"""


@query("dist_cgss", DIST_SQL)
def q_dist_cgss(spark, sf_dir):
    d = D.explode_distribution(cgss_distribution(spark, sf_dir))
    return d.select("qkey", "attribute", "grp", F.col("opt_idx").cast("bigint").alias("opt_idx"),
                    "option", r9("p").alias("p"), r9("refusal_rate").alias("refusal_rate"), "ordinal")


@query("refusal_rate", REFUSAL_SQL)
def q_refusal_rate(spark, sf_dir):
    d = cgss_distribution(spark, sf_dir)
    return d.select("qkey", "attribute", "grp", r9("refusal_rate").alias("refusal_rate"))


@query("emd", EMD_SQL)
def q_emd(spark, sf_dir):
    e = emd_vs_overall(cgss_distribution(spark, sf_dir))
    return e.select("qkey", "attribute", "grp", r9("refusal_rate").alias("refusal_rate"),
                    r9("emd").alias("emd"))


# ----------------------------------------------------------------- A1, A6, A2, A5, A7, A19

def _atp(spark, sf_dir, remove_refusal=True):
    return D.distribution_atp(V.responses(spark, sf_dir), V.codebook(spark), V.group_codes(spark),
                              V.ATTRIBUTE_COLUMNS, remove_refusal=remove_refusal)


_ATP_CTES = _MEMB + """
ref AS (SELECT var, arg_max(code, pos) AS refusal_code FROM codebook GROUP BY var),
base AS (SELECT m.qkey, m.var, m.attribute, m.grp, m.code,
                CASE WHEN m.weight IS NULL OR isnan(m.weight) THEN 0 ELSE m.weight END AS w
         FROM memb m WHERE m.code IS NOT NULL AND NOT isnan(m.code)),
"""

ATP_SQL = with_views(*_DIST_VIEWS, ctes=_ATP_CTES + """
opts AS (SELECT c.var, c.code FROM codebook c JOIN ref r ON r.var = c.var WHERE c.code <> r.refusal_code),
agg AS (SELECT b.qkey, b.var, b.attribute, b.grp, b.code, sum(b.w) AS w
        FROM base b JOIN opts o ON o.var = b.var AND o.code = b.code
        GROUP BY b.qkey, b.var, b.attribute, b.grp, b.code),
tot AS (SELECT qkey, var, attribute, grp, sum(w) AS tot FROM agg
        GROUP BY qkey, var, attribute, grp HAVING sum(w) <> 0)""") + """
SELECT t.qkey, t.attribute, t.grp, o.code, round(coalesce(a.w, 0) / t.tot, 9) AS p
FROM tot t JOIN opts o ON o.var = t.var
LEFT JOIN agg a ON a.qkey = t.qkey AND a.attribute = t.attribute AND a.grp = t.grp AND a.code = o.code"""


@query("dist_atp", ATP_SQL)
def q_dist_atp(spark, sf_dir):
    d = _atp(spark, sf_dir)
    return (d.select("qkey", "attribute", "grp", F.explode(F.arrays_zip("codes", "responses")).alias("x"))
             .select("qkey", "attribute", "grp", F.col("x.codes").alias("code"), r9("x.responses").alias("p")))


ASSEMBLE_SQL = with_views(*_DIST_VIEWS, "variables", ctes=_ATP_CTES + """
agg AS (SELECT b.qkey, b.var, b.attribute, b.grp, b.code, sum(b.w) AS w
        FROM base b JOIN codebook c ON c.var = b.var AND c.code = b.code
        GROUP BY b.qkey, b.var, b.attribute, b.grp, b.code),
tot AS (SELECT a.qkey, a.var, a.attribute, a.grp, sum(a.w) AS tot,
               sum(CASE WHEN a.code = r.refusal_code THEN a.w ELSE 0 END) AS ref_w
        FROM agg a JOIN ref r ON r.var = a.var
        GROUP BY a.qkey, a.var, a.attribute, a.grp HAVING sum(a.w) <> 0),
ok AS (SELECT *, tot - ref_w AS rest_w FROM tot WHERE abs((tot - ref_w) / tot) > 1e-8),
rest AS (SELECT c.var, c.code, row_number() OVER (PARTITION BY c.var ORDER BY c.code) AS pos
         FROM codebook c JOIN ref r ON r.var = c.var WHERE c.code <> r.refusal_code),
labs AS (SELECT var, string_agg(trim(label), '|' ORDER BY pos) AS options FROM codebook GROUP BY var),
qt AS (SELECT var, CASE WHEN instr(label, '.') > 0 THEN trim(substr(label, instr(label, '.') + 1)) ELSE '' END
              AS question FROM variables)""") + """
SELECT k.qkey, k.attribute, k.grp, rs.pos,
       round(coalesce(a.w, 0) / k.rest_w, 9) AS p, round(k.ref_w / k.tot, 9) AS refusal_rate,
       CAST(1 AS DOUBLE) AS ordinal, qt.question, l.options
FROM ok k JOIN rest rs ON rs.var = k.var
JOIN labs l ON l.var = k.var LEFT JOIN qt ON qt.var = k.var
LEFT JOIN agg a ON a.qkey = k.qkey AND a.attribute = k.attribute AND a.grp = k.grp AND a.code = rs.code"""


@query("dist_assemble", ASSEMBLE_SQL)
def q_dist_assemble(spark, sf_dir):
    d = D.assemble_atp(V.responses(spark, sf_dir), V.codebook(spark), V.variables(spark),
                       V.group_codes(spark), V.ATTRIBUTE_COLUMNS)
    return (d.select("qkey", "attribute", "grp", "refusal_rate", "question",
                     F.array_join("options", "|").alias("options"),
                     F.posexplode(F.arrays_zip("responses", "ordinal")).alias("pos", "x"))
             .select("qkey", "attribute", "grp", (F.col("pos") + 1).cast("bigint").alias("pos"),
                     r9("x.responses").alias("p"), r9("refusal_rate").alias("refusal_rate"),
                     F.col("x.ordinal").alias("ordinal"), "question", "options"))


def gss_options(spark):
    """GSS-style dictionary: options in code order, ordinal 1..K."""
    cb = V.codebook(spark)
    return (cb.groupBy("var").agg(F.sort_array(F.collect_list(F.struct("code", F.trim("label").alias("l"))))
                                  .alias("_p"))
              .select("var", F.transform("_p", lambda x: x["l"]).alias("options"),
                      F.transform("_p", lambda x, i: (i + 1).cast("double")).alias("ordinal")))


GSS_SQL = with_views("responses", "codebook", "group_codes", ctes=_MEMB + """
gmin AS (SELECT qkey, min(code) AS min_code FROM responses WHERE code >= 0 GROUP BY qkey),
nopt AS (SELECT var, count(*) AS k FROM codebook GROUP BY var),
base AS (SELECT m.qkey, m.var, m.attribute, m.grp, CAST(m.code - g.min_code AS INTEGER) AS idx, m.weight AS w
         FROM memb m JOIN gmin g ON g.qkey = m.qkey
         WHERE m.code >= 0 AND m.code = floor(m.code) AND m.weight IS NOT NULL AND NOT isnan(m.weight)),
agg AS (SELECT b.qkey, b.var, b.attribute, b.grp, b.idx, sum(b.w) AS w
        FROM base b JOIN nopt n ON n.var = b.var WHERE b.idx >= 0 AND b.idx < n.k
        GROUP BY b.qkey, b.var, b.attribute, b.grp, b.idx),
tot AS (SELECT a.qkey, a.var, a.attribute, a.grp, sum(a.w) AS tot,
               sum(CASE WHEN a.idx < n.k - 1 THEN a.w ELSE 0 END) AS head_w
        FROM agg a JOIN nopt n ON n.var = a.var
        GROUP BY a.qkey, a.var, a.attribute, a.grp HAVING sum(a.w) <> 0),
pos AS (SELECT var, CAST(row_number() OVER (PARTITION BY var ORDER BY code) - 1 AS INTEGER) AS idx FROM codebook)""") + """
SELECT t.qkey, t.attribute, t.grp, CAST(p.idx + 1 AS BIGINT) AS pos,
       round(coalesce(a.w, 0) / t.head_w, 9) AS p, CAST(0 AS DOUBLE) AS refusal_rate
FROM tot t JOIN nopt n ON n.var = t.var JOIN pos p ON p.var = t.var AND p.idx < n.k - 1
LEFT JOIN agg a ON a.qkey = t.qkey AND a.attribute = t.attribute AND a.grp = t.grp AND a.idx = p.idx
WHERE abs(t.head_w / t.tot) > 1e-8"""


@query("dist_gss", GSS_SQL)
def q_dist_gss(spark, sf_dir):
    # GSS files hold no sentinel codes: negative codes are "not asked" there
    resp = V.responses(spark, sf_dir).withColumn("code", F.when(F.col("code") >= 0, F.col("code")))
    d = D.distribution_gss(resp, gss_options(spark), V.group_codes(spark), V.ATTRIBUTE_COLUMNS)
    return (d.select("qkey", "attribute", "grp", "refusal_rate", F.posexplode("responses").alias("pos", "p"))
             .select("qkey", "attribute", "grp", (F.col("pos") + 1).cast("bigint").alias("pos"),
                     r9("p").alias("p"), r9("refusal_rate").alias("refusal_rate")))


N_RESP_SQL = with_views("responses", "codebook", ctes="""
ref AS (SELECT var, arg_max(code, pos) AS refusal_code FROM codebook GROUP BY var)""") + """
SELECT r.qkey, count(*) AS n_with_refusal,
       count(*) FILTER (WHERE f.refusal_code IS NULL OR r.code <> f.refusal_code) AS n_without_refusal
FROM responses r LEFT JOIN ref f ON f.var = r.var
WHERE r.code IS NOT NULL AND NOT isnan(r.code) GROUP BY r.qkey"""


@query("n_respondent", N_RESP_SQL)
def q_n_respondent(spark, sf_dir):
    return D.n_respondent(V.responses(spark, sf_dir), V.codebook(spark))


def _joint_memb() -> str:
    combos = [("SEGMENT", "segment", "REGION", "region"),
              ("SEGMENT", "segment", "BALANCE", "CAST(r.balance_code AS VARCHAR)"),
              ("REGION", "region", "BALANCE", "CAST(r.balance_code AS VARCHAR)")]
    parts = []
    for a1, c1, a2, c2 in combos:
        c1 = c1 if c1.startswith("CAST") else f"r.{c1}"
        c2 = c2 if c2.startswith("CAST") else f"r.{c2}"
        parts.append(
            f"SELECT r.qkey, r.var, r.code, r.weight, '[''{a1}'', ''{a2}'']' AS attribute, "
            f"'[''' || g1.grp || ''', ''' || g2.grp || ''']' AS grp FROM responses r "
            f"JOIN group_codes g1 ON g1.attribute = '{a1}' AND g1.code = {c1} "
            f"JOIN group_codes g2 ON g2.attribute = '{a2}' AND g2.code = {c2}")
    return "\nmemb AS (\n  " + "\n  UNION ALL ".join(parts) + "\n),"


JOINT_SQL = with_views(*_DIST_VIEWS, ctes=_dist_ctes(_joint_memb())) + """
SELECT qkey, attribute, grp, opt_idx, option, round(p, 9) AS p, round(refusal_rate, 9) AS refusal_rate, ordinal
FROM dist"""


@query("dist_joint_k2", JOINT_SQL)
def q_dist_joint_k2(spark, sf_dir):
    d = D.explode_distribution(cgss_distribution(spark, sf_dir, k=2))
    return d.select("qkey", "attribute", "grp", F.col("opt_idx").cast("bigint").alias("opt_idx"),
                    "option", r9("p").alias("p"), r9("refusal_rate").alias("refusal_rate"), "ordinal")


_MEMB_K3 = """
memb AS (SELECT r.qkey, r.var, r.code, r.weight, '[''SEGMENT'', ''REGION'', ''BALANCE'']' AS attribute,
                '[''' || g1.grp || ''', ''' || g2.grp || ''', ''' || g3.grp || ''']' AS grp FROM responses r
         JOIN group_codes g1 ON g1.attribute = 'SEGMENT' AND g1.code = r.segment
         JOIN group_codes g2 ON g2.attribute = 'REGION' AND g2.code = r.region
         JOIN group_codes g3 ON g3.attribute = 'BALANCE' AND g3.code = CAST(r.balance_code AS VARCHAR)
),"""


@query("dist_joint_k3", with_views(*_DIST_VIEWS, ctes=_dist_ctes(_MEMB_K3)) + """
SELECT qkey, attribute, grp, opt_idx, option, round(p, 9) AS p, round(refusal_rate, 9) AS refusal_rate, ordinal
FROM dist""")
def q_dist_joint_k3(spark, sf_dir):
    d = D.explode_distribution(cgss_distribution(spark, sf_dir, k=3))
    return d.select("qkey", "attribute", "grp", F.col("opt_idx").cast("bigint").alias("opt_idx"),
                    "option", r9("p").alias("p"), r9("refusal_rate").alias("refusal_rate"), "ordinal")


SKIP_SQL = with_views(*_DIST_VIEWS, ctes=_DIST_CTES) + """
SELECT CASE WHEN valid_w + ref_w <= 0 THEN 'no_weight' WHEN abs(valid_w) <= 1e-8 THEN 'all_refused'
            ELSE 'ok' END AS reason, count(*) AS n
FROM keys GROUP BY 1"""


@query("skip_report", SKIP_SQL)
def q_skip_report(spark, sf_dir):
    return D.skip_report(cgss_distribution(spark, sf_dir, report=True))


_CHANGED = """
resp2 AS (SELECT * REPLACE (CASE WHEN region = 'ASIA' THEN 0 ELSE weight END AS weight,
                            CASE WHEN segment = 'BUILDING' THEN CASE var WHEN 'PRIORITY' THEN CAST(4 AS DOUBLE) ELSE CAST(3 AS DOUBLE) END
                                 ELSE code END AS code) FROM responses),"""

SKIP_WAVES_SQL = with_views(*_DIST_VIEWS, ctes=_CHANGED + _ATP_CTES.replace("FROM responses", "FROM resp2") + """
agg AS (SELECT b.qkey, b.var, b.attribute, b.grp, b.code, sum(b.w) AS w FROM base b JOIN codebook c ON c.var = b.var AND c.code = b.code
        GROUP BY ALL),
tot AS (SELECT a.qkey, a.attribute, a.grp, sum(a.w) AS tot, sum(CASE WHEN a.code = r.refusal_code THEN a.w ELSE 0 END) AS ref_w
        FROM agg a JOIN ref r ON r.var = a.var GROUP BY ALL)""") + """
SELECT CASE WHEN tot = 0 THEN 'no_weight' WHEN abs((tot - ref_w) / tot) <= 1e-8 THEN 'all_refused' ELSE 'ok' END AS reason, count(*) AS n
FROM tot GROUP BY 1"""


@query("skip_report_waves", SKIP_WAVES_SQL)
def q_skip_report_waves(spark, sf_dir):
    """A19 on the wave scheme, with one region unweighted and one segment that
    refuses every question."""
    refused = F.when(F.col("var") == "PRIORITY", 4.0).otherwise(3.0)
    resp = V.responses(spark, sf_dir).withColumns({
        "weight": F.when(F.col("region") == "ASIA", 0.0).otherwise(F.col("weight")),
        "code": F.when(F.col("segment") == "BUILDING", refused).otherwise(F.col("code"))})
    full = D.assemble_atp(resp, V.codebook(spark), V.variables(spark), V.group_codes(spark), V.ATTRIBUTE_COLUMNS, with_report=True)
    return D.skip_report(full)


TEXT_SQL = with_views(*_DIST_VIEWS, "variables", ctes=_DIST_CTES + """
qt AS (SELECT v.var, coalesce(CASE WHEN p.t IS NOT NULL AND length(p.t) > 0 THEN trim(p.t) END,
                              CASE WHEN length(v.label) > 0 THEN trim(v.label) END, v.var) AS question
       FROM variables v LEFT JOIN (SELECT 'STATUS' AS var, 'What is the status of your order?' AS t) p
       ON p.var = v.var)""") + """
SELECT DISTINCT d.qkey, d.attribute, d.grp, qt.question
FROM dist d JOIN qt ON qt.var = split_part(d.qkey, '_W', 1)"""


@query("dist_with_text", TEXT_SQL)
def q_dist_with_text(spark, sf_dir):
    return cgss_distribution(spark, sf_dir).select("qkey", "attribute", "grp", "question")
