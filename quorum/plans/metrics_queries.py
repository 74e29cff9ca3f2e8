"""Queries: distance metrics, option probabilities, bounds, entropy."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorum.functions import metrics as M
from quorum.operators import distribution as D
from quorum.operators import entropy as E
from quorum.operators.bounds import wd_lower_bootstrap, wd_lower_draws
from quorum.plans.distribution_queries import _DIST_CTES, _DIST_VIEWS, _EMD_CTES, cgss_distribution, emd_vs_overall, r9
from quorum.plans.oracle_views import with_views
from quorum.plans.registry import query
from quorum.sources import views as V


def scored(spark, sf_dir):
    """V9 + the model's option distribution (F6) and an output_dist with a
    refusal entry r = label/20 (the prompt-table shape)."""
    lg = V.logits(spark, sf_dir)
    r = F.col("label") / 20.0
    return lg.select(
        "row_idx", "k", "logits", "gold", "ordinal",
        M.option_softmax("logits", "k").alias("q"),
        F.concat(F.transform("gold", lambda g: g * (1 - r)), F.array(r)).alias("output_dist"))


def _explode(df, *arrays, keep=("row_idx",)):
    z = F.arrays_zip(*[F.col(a).alias(a) for a in arrays])
    return (df.select(*keep, F.posexplode(z).alias("_j", "_x"))
              .select(*keep, (F.col("_j") + 1).alias("j"), *[F.col(f"_x.{a}").alias(a) for a in arrays]))


_EMD_LONG = """
f AS (SELECT row_idx, j, o, p / sum(p) OVER (PARTITION BY row_idx) AS pn, q / sum(q) OVER (PARTITION BY row_idx) AS qn
      FROM {src} WHERE o >= 0),
c AS (SELECT row_idx, o, sum(pn) OVER (PARTITION BY row_idx ORDER BY o, pn, qn ROWS UNBOUNDED PRECEDING) AS cp,
             sum(qn) OVER (PARTITION BY row_idx ORDER BY o, pn, qn ROWS UNBOUNDED PRECEDING) AS cq,
             lead(o) OVER (PARTITION BY row_idx ORDER BY o, pn, qn) AS nxt FROM f),
e AS (SELECT row_idx, sum(CASE WHEN nxt IS NULL THEN 0 ELSE abs(cp - cq) * (nxt - o) END) / (max(o) - min(o)) AS emd
      FROM c GROUP BY row_idx)"""


# ---- F1 / F2
@query("emd_logits", with_views("lg_long", ctes=_EMD_LONG.format(src="lg_long")) +
       "SELECT row_idx, round(emd, 9) AS emd FROM e")
def q_emd_logits(spark, sf_dir):
    s = scored(spark, sf_dir)
    return s.select("row_idx", r9(M.emd("gold", "q", "ordinal")).alias("emd"))


@query("emd_zero", with_views("lg_long", ctes=_EMD_LONG.format(src="lg_long")) +
       "SELECT row_idx, round(emd, 9) AS emd FROM e")
def q_emd_zero(spark, sf_dir):
    s = scored(spark, sf_dir)
    return s.select("row_idx", r9(M.emd_zero("gold", "q", "ordinal")).alias("emd"))


# ---- F3
@query("kl", with_views("lg_long") + """
SELECT row_idx, round(sum(p * (ln(p + 1e-8) - ln(q + 1e-8))), 9) AS kl FROM lg_long GROUP BY row_idx""")
def q_kl(spark, sf_dir):
    return scored(spark, sf_dir).select("row_idx", r9(M.kl("gold", "q")).alias("kl"))


# ---- F4
@query("normalize", with_views("lg_x") + """
SELECT row_idx, i AS j, round(abs(x) / sum(abs(x)) OVER (PARTITION BY row_idx), 9) AS v FROM lg_x""")
def q_normalize(spark, sf_dir):
    lg = V.logits(spark, sf_dir)
    n = lg.select("row_idx", M.normalize(F.transform("logits", F.abs)).alias("v"))
    return _explode(n, "v").select("row_idx", "j", r9("v").alias("v"))


# ---- F6
@query("option_softmax", with_views("lg_q") + "SELECT row_idx, j, round(q, 9) AS q FROM lg_q")
def q_option_softmax(spark, sf_dir):
    return _explode(scored(spark, sf_dir), "q").select("row_idx", "j", r9("q").alias("q"))


# ---- F5
def logprob_maps(spark, sf_dir):
    """Token log-probs at the answer position: "L" -> x_i - 3 for every
    option letter, " L" -> x_(26+i) - 4 where (row + i) % 3 != 0."""
    lg = V.logits(spark, sf_dir)
    seq = F.sequence(F.lit(1), F.col("k"))
    a = F.transform(seq, lambda i: F.struct(F.char(F.lit(64) + i).alias("t"),
                                            (F.col("logits")[i - 1] - 3).alias("lp")))
    b = F.filter(F.transform(seq, lambda i: F.struct(
        F.concat(F.lit(" "), F.char(F.lit(64) + i)).alias("t"),
        F.when((F.col("row_idx") + i) % 3 != 0, F.col("logits")[i + 25] - 4).alias("lp"))),
        lambda s: s["lp"].isNotNull())
    return lg.select("row_idx", "k", "gold", "ordinal", "label",
                     F.map_from_entries(F.concat(a, b)).alias("logprobs"))


_PROBS_CTES = """
pr AS (SELECT a.row_idx, a.i AS j, exp(a.x - 3) + CASE WHEN (a.row_idx + a.i) % 3 <> 0 THEN exp(b.x - 4) ELSE 0 END AS pr
       FROM lg_x a JOIN lg_x b ON b.row_idx = a.row_idx AND b.i = a.i + 26 WHERE a.i <= a.k),
ps AS (SELECT row_idx, j, pr, sum(pr) OVER (PARTITION BY row_idx) AS s FROM pr)"""


@query("option_probs", with_views("lg_x", ctes=_PROBS_CTES) +
       "SELECT row_idx, j, round(pr / s, 9) AS prob, round(s, 9) AS prob_sum FROM ps")
def q_option_probs(spark, sf_dir):
    m = logprob_maps(spark, sf_dir)
    raw = M.option_probs("logprobs", "k")
    p = m.select("row_idx", raw.alias("raw")).select(
        "row_idx", M.normalize("raw").alias("prob"), M.array_sum("raw").alias("prob_sum"))
    return _explode(p, "prob", keep=("row_idx", "prob_sum")).select(
        "row_idx", "j", r9("prob").alias("prob"), r9("prob_sum").alias("prob_sum"))


# ---- F7
@query("score_inference", with_views("lg_long", "lg_x", ctes=_PROBS_CTES + """,
hum AS (SELECT l.row_idx, l.j, l.o, l.p * (1 - x.label / 20.0) AS p0 FROM lg_long l
        JOIN (SELECT DISTINCT row_idx, label FROM lg_x) x ON x.row_idx = l.row_idx),
sc AS (SELECT h.row_idx, h.j, h.o, h.p0 / sum(h.p0) OVER (PARTITION BY h.row_idx) AS p, ps.pr / ps.s AS q, ps.s
       FROM hum h JOIN ps ON ps.row_idx = h.row_idx AND ps.j = h.j),""" + _EMD_LONG.format(src="sc")) + """
SELECT e.row_idx, round(e.emd, 9) AS emd, round(s.s, 9) AS llm_prob_sum
FROM e JOIN (SELECT DISTINCT row_idx, s FROM sc) s ON s.row_idx = e.row_idx""")
def q_score_inference(spark, sf_dir):
    m = logprob_maps(spark, sf_dir)
    r = F.col("label") / 20.0
    od = F.concat(F.transform("gold", lambda g: g * (1 - r)), F.array(r))
    raw = M.option_probs("logprobs", "k")
    s = m.select("row_idx", "ordinal", od.alias("output_dist"), raw.alias("raw"))
    human = M.normalize(F.slice("output_dist", 1, F.size("output_dist") - 1))
    return s.select("row_idx", r9(M.emd(human, M.normalize("raw"), "ordinal")).alias("emd"),
                    r9(M.array_sum("raw")).alias("llm_prob_sum"))


# ---- F8
@query("pad_options", with_views("lg_long", "lg_sm", ctes="""
slots AS (SELECT row_idx, unnest(range(1, 27)) AS pos FROM (SELECT DISTINCT row_idx FROM lg_long)),
mo AS (SELECT row_idx, max(o) AS mo FROM lg_long GROUP BY row_idx),
fu AS (SELECT row_idx, i, e / sum(e) OVER (PARTITION BY row_idx) AS s FROM lg_sm),
fc AS (SELECT row_idx, i, s / sum(s) OVER (PARTITION BY row_idx) AS f FROM fu WHERE i <= 26)""") + """
SELECT sl.row_idx, sl.pos, round(coalesce(l.p, 0), 9) AS p_gold, coalesce(l.o, mo.mo) AS o_gold,
       round(fc.f, 9) AS p_full
FROM slots sl JOIN mo ON mo.row_idx = sl.row_idx
LEFT JOIN lg_long l ON l.row_idx = sl.row_idx AND l.j = sl.pos
JOIN fc ON fc.row_idx = sl.row_idx AND fc.i = sl.pos""")
def q_pad_options(spark, sf_dir):
    lg = V.logits(spark, sf_dir)
    g, o = M.pad_target("gold", "ordinal")
    full, _ = M.pad_target(M.softmax("logits"), F.sequence(F.lit(1.0), F.lit(64.0)))
    p = lg.select("row_idx", g.alias("p_gold"), o.alias("o_gold"), full.alias("p_full"))
    return _explode(p, "p_gold", "o_gold", "p_full").select(
        "row_idx", F.col("j").alias("pos"), r9("p_gold").alias("p_gold"), "o_gold", r9("p_full").alias("p_full"))


# ---- F9 / F10 / F11
def upper_bounds(spark, sf_dir):
    s = scored(spark, sf_dir)
    g, o = M.pad_target("output_dist", "ordinal", always_renormalize=True)
    s = s.select("row_idx", "k", g.alias("g26"), o.alias("o26"))
    u = M.uniform_over_real("o26", "k")
    return s.select("row_idx", M.emd(u, "g26", "o26").alias("wd_upper_uniform"))


_UPPER_CTES = """
slots AS (SELECT row_idx, k, label, unnest(range(1, 27)) AS s FROM (SELECT DISTINCT row_idx, k, label FROM lg_x)),
mo AS (SELECT row_idx, max(o) AS mo, count(*) FILTER (WHERE o >= 0) AS kv FROM lg_long GROUP BY row_idx),
g0 AS (SELECT sl.row_idx, sl.s AS j,
              CASE WHEN sl.s <= sl.k THEN l.p * (1 - sl.label / 20.0) WHEN sl.s = sl.k + 1 THEN sl.label / 20.0 ELSE 0 END AS g,
              coalesce(l.o, mo.mo) AS o,
              CASE WHEN sl.s <= sl.k AND l.o >= 0 THEN 1.0 / mo.kv ELSE 0 END AS u
       FROM slots sl JOIN mo ON mo.row_idx = sl.row_idx
       LEFT JOIN lg_long l ON l.row_idx = sl.row_idx AND l.j = sl.s),
ub AS (SELECT row_idx, j, o, u AS p, g / sum(g) OVER (PARTITION BY row_idx) AS q FROM g0),"""

UPPER_SQL = with_views("lg_long", "lg_x", ctes=_UPPER_CTES + _EMD_LONG.format(src="ub"))


@query("wd_upper", UPPER_SQL + "SELECT row_idx, round(emd, 9) AS wd_upper_uniform FROM e")
def q_wd_upper(spark, sf_dir):
    return upper_bounds(spark, sf_dir).select("row_idx", r9("wd_upper_uniform").alias("wd_upper_uniform"))


# ---- A13
def _lower_ctes() -> str:
    from quorum.functions.rng import sql_uniform
    from quorum.plans.compare_queries import _emd_ctes
    key = "'42:' || CAST(c.row_idx AS VARCHAR) || ':' || CAST(b AS VARCHAR) || ':' || CAST(side AS VARCHAR) || ':' || CAST(i AS VARCHAR)"
    return f"""
lcum AS (SELECT row_idx, j, o, sum(p) OVER (PARTITION BY row_idx ORDER BY j) / sum(p) OVER (PARTITION BY row_idx) AS c,
                count(*) OVER (PARTITION BY row_idx) AS k FROM lg_long),
lrow AS (SELECT DISTINCT row_idx, k FROM lcum),
ldraw AS (SELECT c.row_idx, c.k, b, side, i, {sql_uniform(key)} AS u
          FROM lrow c, range(1, {LOWER_B + 1}) t1(b), range(1, 3) t2(side), range(1, {LOWER_N + 1}) t3(i)),
lpick AS (SELECT d.row_idx, d.b, d.side, d.i, 1 + least(count(*) FILTER (c.c <= d.u), any_value(d.k) - 1) AS j
          FROM ldraw d JOIN lcum c ON c.row_idx = d.row_idx GROUP BY ALL),
lcnt AS (SELECT row_idx, b, j, count(*) FILTER (side = 1) / {LOWER_N} AS p, count(*) FILTER (side = 2) / {LOWER_N} AS q
         FROM lpick GROUP BY ALL),
lsrc AS (SELECT CAST(c.row_idx AS VARCHAR) || '|' || CAST(t.b AS VARCHAR) AS row_idx, c.o, coalesce(n.p, 0) AS p, coalesce(n.q, 0) AS qq
         FROM lcum c CROSS JOIN range(1, {LOWER_B + 1}) t(b) LEFT JOIN lcnt n ON n.row_idx = c.row_idx AND n.b = t.b AND n.j = c.j),""" \
        + _emd_ctes("lsrc", "qq", "lo") + """,
lower_e AS (SELECT CAST(split_part(row_idx, '|', 1) AS BIGINT) AS row_idx, avg(CASE WHEN NOT isnan(emd) AND NOT isinf(emd) THEN emd END) AS wd_lower
            FROM lo_e GROUP BY 1)"""


LOWER_N, LOWER_B = 20, 8


def lower_bounds(spark, sf_dir):
    """Small form of the lower bound, by hash-uniform draws."""
    return wd_lower_draws(scored(spark, sf_dir).select("row_idx", "gold", "ordinal"), LOWER_N, LOWER_B)


def whole_lower_bounds(spark, sf_dir):
    """The lower bound of the padded target (the options and the refusal), 500 x 500."""
    g, o = M.pad_target("output_dist", "ordinal", always_renormalize=True)
    s = scored(spark, sf_dir).select("row_idx", F.slice(g, 1, F.col("k") + 1).alias("gold"), F.slice(o, 1, F.col("k") + 1).alias("ordinal"))
    return wd_lower_bootstrap(s, n_per_side=WHOLE_N, n_bootstrap=WHOLE_B, seed=42)


WHOLE_N, WHOLE_B = 500, 500


def _whole_lower_ctes() -> str:
    from quorum.functions.rng import sql_uniform
    from quorum.plans.compare_queries import _emd_ctes
    return f"""
bc AS (SELECT row_idx, j, o, sum(q) OVER (PARTITION BY row_idx ORDER BY j) / sum(q) OVER (PARTITION BY row_idx) AS c,
              count(*) OVER (PARTITION BY row_idx) AS kk
       FROM ub JOIN (SELECT DISTINCT row_idx, k FROM lg_x) USING (row_idx) WHERE j <= k + 1),
sh AS (SELECT row_idx, {sql_uniform("'42:' || CAST(row_idx AS VARCHAR)")} AS s FROM (SELECT DISTINCT row_idx FROM bc)),
ur AS (SELECT b, side, u, count(*) OVER (PARTITION BY b, side ORDER BY u) AS r FROM (
         SELECT b, side, {sql_uniform("'42:' || CAST(b AS VARCHAR) || ':' || CAST(side AS VARCHAR) || ':' || CAST(i AS VARCHAR)")} AS u
         FROM range(1, {WHOLE_B + 1}) t1(b), range(1, 3) t2(side), range(1, {WHOLE_N + 1}) t3(i))),
pt AS (SELECT row_idx, j, c - s AS x FROM bc JOIN sh USING (row_idx) WHERE j < kk UNION ALL SELECT row_idx, 0, 0.0 - s FROM sh),
py AS (SELECT row_idx, j, b, side, CASE WHEN x >= 0 THEN x ELSE x + 1 END AS y, CASE WHEN x >= 0 THEN 0 ELSE -{WHOLE_N} END AS base
       FROM pt, range(1, {WHOLE_B + 1}) t1(b), range(1, 3) t2(side)),
pg AS (SELECT py.row_idx, py.j, py.b, py.side, py.base + coalesce(ur.r, 0) AS g
       FROM py ASOF LEFT JOIN ur ON py.b = ur.b AND py.side = ur.side AND py.y > ur.u),
pc AS (SELECT g.row_idx, g.j, g.b, g.side, g.g - z.g AS upto FROM pg g JOIN pg z USING (row_idx, b, side) WHERE z.j = 0 AND g.j > 0
       UNION ALL SELECT row_idx, j, b, side, {WHOLE_N} FROM bc, range(1, {WHOLE_B + 1}) t1(b), range(1, 3) t2(side) WHERE j = kk),
pn AS (SELECT row_idx, j, b, side, upto - coalesce(lag(upto) OVER (PARTITION BY row_idx, b, side ORDER BY j), 0) AS n FROM pc),
wsrc AS (SELECT CAST(bc.row_idx AS VARCHAR) || '|' || CAST(x.b AS VARCHAR) AS row_idx, bc.o, x.n AS p, y.n AS qq
         FROM bc JOIN pn x ON x.row_idx = bc.row_idx AND x.j = bc.j AND x.side = 1
         JOIN pn y ON y.row_idx = bc.row_idx AND y.j = bc.j AND y.side = 2 AND y.b = x.b),""" \
        + _emd_ctes("wsrc", "qq", "wh") + """,
whole_e AS (SELECT CAST(split_part(row_idx, '|', 1) AS BIGINT) AS row_idx,
                   avg(CASE WHEN NOT isnan(emd) AND NOT isinf(emd) THEN emd END) AS wd_lower FROM wh_e GROUP BY 1)"""


def register_bounds():
    """Registered from compare_queries, whose EMD text the SQL uses."""
    whole = UPPER_SQL + "," + _whole_lower_ctes()

    @query("wd_lower_draws", with_views("lg_long", ctes=_lower_ctes()) + "SELECT row_idx, round(wd_lower, 9) AS wd_lower FROM lower_e")
    def q_wd_lower_draws(spark, sf_dir):
        return lower_bounds(spark, sf_dir).select("row_idx", r9("wd_lower").alias("wd_lower"))

    @query("wd_lower", whole + f"""
SELECT row_idx, round(wd_lower, 9) AS wd_lower_bootstrap_mean, {WHOLE_N} AS n_per_side, {WHOLE_B} AS n_bootstrap FROM whole_e""")
    def q_wd_lower(spark, sf_dir):
        w = whole_lower_bounds(spark, sf_dir)
        return w.withColumn("wd_lower_bootstrap_mean", r9("wd_lower_bootstrap_mean"))

    @query("bounds_summary", whole + """
SELECT round(avg(emd) FILTER (NOT isnan(emd)), 9) AS mean_upper, round(median(emd) FILTER (NOT isnan(emd)), 9) AS median_upper,
       count(emd) FILTER (NOT isnan(emd)) AS n_upper,
       (SELECT round(avg(wd_lower), 9) FROM whole_e) AS mean_lower, (SELECT round(median(wd_lower), 9) FROM whole_e) AS median_lower,
       (SELECT count(wd_lower) FROM whole_e) AS n_lower FROM e""")
    def q_bounds_summary(spark, sf_dir):
        from quorum.operators.compare import bounds_summary
        both = upper_bounds(spark, sf_dir).join(whole_lower_bounds(spark, sf_dir), "row_idx", "full")
        out = bounds_summary(both, {"wd_upper_uniform": "upper", "wd_lower_bootstrap_mean": "lower"})
        return out.select(*[r9(c).alias(c) if not c.startswith("n_") else c for c in out.columns])


# ---- A8
@query("entropy", with_views("line_responses", ctes="""
cnt AS (SELECT qkey, code, count(*) AS c FROM line_responses GROUP BY qkey, code),
tot AS (SELECT qkey, sum(c) AS n, count(*) AS m FROM cnt GROUP BY qkey)""") + """
SELECT c.qkey, round(CASE WHEN t.m > 1 THEN -sum((c.c / t.n) * log2(c.c / t.n + 1e-9)) / log2(t.m)
                          ELSE -sum((c.c / t.n) * log2(c.c / t.n + 1e-9)) END, 9) AS entropy
FROM cnt c JOIN tot t ON t.qkey = c.qkey GROUP BY c.qkey, t.m""")
def q_entropy(spark, sf_dir):
    lr = V.line_responses(spark, sf_dir)
    c = lr.groupBy("qkey", "code").agg(F.count(F.lit(1)).alias("n"))
    return E.entropy(c, ["qkey"]).select("qkey", r9("entropy").alias("entropy"))


_NAMES = sorted(V.LINE_VARS)
JOINT_PAIRS = [(a, b) for i, a in enumerate(_NAMES) for b in _NAMES[i + 1:]]
_JOINT_ROWS = " UNION ALL ".join(f"SELECT '{a}|{b}' AS pair, {a} AS a, {b} AS b FROM line_answers WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
                                 for a, b in JOINT_PAIRS)


@query("entropy_joint", with_views("line_answers", ctes=f"""
j AS ({_JOINT_ROWS}),
cnt AS (SELECT pair, a, b, count(*) AS c FROM j GROUP BY pair, a, b),
tot AS (SELECT pair, sum(c) AS n, count(*) AS m FROM cnt GROUP BY pair)""") + """
SELECT c.pair, round(CASE WHEN t.m > 1 THEN -sum((c.c / t.n) * log2(c.c / t.n + 1e-9)) / log2(t.m)
                          ELSE -sum((c.c / t.n) * log2(c.c / t.n + 1e-9)) END, 9) AS entropy
FROM cnt c JOIN tot t ON t.pair = c.pair GROUP BY c.pair, t.m""")
def q_entropy_joint(spark, sf_dir):
    cells = E.joint_cells(V.line_answers(spark, sf_dir), _NAMES, [2], "pair")
    return E.entropy(cells, ["pair"]).select("pair", r9("entropy").alias("entropy"))


_SUBSETS = [s for size in (1, 2, 3) for s in itertools.combinations(_NAMES, size)]
_SUBSET_ROWS = " UNION ALL ".join(
    f"SELECT '{'|'.join(s)}' AS subset, {' || chr(31) || '.join(f'CAST({q} AS VARCHAR)' for q in s)} AS a FROM line_answers "
    f"WHERE {' AND '.join(f'{q} IS NOT NULL' for q in s)}" for s in _SUBSETS)


@query("entropy_subsets", with_views("line_answers", ctes=f"""
j AS ({_SUBSET_ROWS}),
cnt AS (SELECT subset, a, count(*) AS c FROM j GROUP BY subset, a),
tot AS (SELECT subset, sum(c) AS n, count(*) AS m FROM cnt GROUP BY subset)""") + """
SELECT c.subset, round(CASE WHEN t.m > 1 THEN -sum((c.c / t.n) * log2(c.c / t.n + 1e-9)) / log2(t.m)
                            ELSE -sum((c.c / t.n) * log2(c.c / t.n + 1e-9)) END, 9) AS entropy
FROM cnt c JOIN tot t ON t.subset = c.subset GROUP BY c.subset, t.m""")
def q_entropy_subsets(spark, sf_dir):
    """The joint entropy of every one, two and three questions, in one pass."""
    cells = E.joint_cells(V.line_answers(spark, sf_dir), _NAMES, [1, 2, 3])
    return E.entropy(cells, ["subset"]).select("subset", r9("entropy").alias("entropy"))


# ---- A9 + P14 + P15
def excluded_qkeys(dist):
    """P14 list: questions whose whole-population refusal rate exceeds 10 %."""
    return dist.where((F.col("attribute") == D.OVERALL) & (F.col("refusal_rate") > 0.1)).select("qkey")


def kept_emd(spark, sf_dir):
    """EMD rows with the P14 exclusion applied (from the Overall refusal
    rate carried by ``emd_vs_overall`` — no second pass)."""
    e = emd_vs_overall(cgss_distribution(spark, sf_dir))
    return e.where(~F.coalesce(F.col("overall_refusal_rate") > 0.1, F.lit(False)))


_EXCL = "excl AS (SELECT DISTINCT qkey FROM emdt WHERE attribute = 'Overall' AND refusal_rate > 0.1),"
_KEPT = ("kept AS (SELECT qkey, attribute, grp, CASE WHEN rng = 0 THEN NULL ELSE s / rng END AS emd FROM emdt "
         "WHERE qkey NOT IN (SELECT qkey FROM excl))")


@query("exclude_refused", with_views(*_DIST_VIEWS, ctes=_EMD_CTES + ",\n" + _EXCL + _KEPT) +
       "SELECT qkey, attribute, grp, round(emd, 9) AS emd FROM kept")
def q_exclude_refused(spark, sf_dir):
    return kept_emd(spark, sf_dir).select("qkey", "attribute", "grp", r9("emd").alias("emd"))


@query("exclude_listed", with_views(*_DIST_VIEWS, ctes=_EMD_CTES) + """,
busy AS (SELECT qkey FROM responses GROUP BY qkey HAVING count(*) % 2 = 0)
SELECT qkey, attribute, grp, round(CASE WHEN rng = 0 THEN NULL ELSE s / rng END, 9) AS emd FROM emdt
WHERE qkey NOT IN (SELECT qkey FROM busy)""")
def q_exclude_listed(spark, sf_dir):
    """P14 with a list of questions, here those with an even number of rows."""
    from quorum.operators.groups import exclude_listed
    listed = V.responses(spark, sf_dir).groupBy("qkey").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 0")
    e = exclude_listed(emd_vs_overall(cgss_distribution(spark, sf_dir)), listed)
    return e.select("qkey", "attribute", "grp", r9("emd").alias("emd"))


@query("wd_by_group", with_views(*_DIST_VIEWS, ctes=_EMD_CTES + ",\n" + _EXCL + _KEPT) + """
SELECT attribute, grp, round(avg(emd), 9) AS mean_emd, count(emd) AS n FROM kept GROUP BY ROLLUP (attribute, grp)""")
def q_wd_by_group(spark, sf_dir):
    e = kept_emd(spark, sf_dir)
    return e.rollup("attribute", "grp").agg(r9(F.avg("emd")).alias("mean_emd"), F.count("emd").alias("n"))


@query("wd_one_group", with_views(*_DIST_VIEWS, ctes=_EMD_CTES + ",\n" + _EXCL + _KEPT) + """
SELECT round(avg(emd), 9) AS mean_emd, count(emd) AS n FROM kept WHERE grp = 'ASIA'""")
def q_wd_one_group(spark, sf_dir):
    e = kept_emd(spark, sf_dir)
    return e.where(F.col("grp") == "ASIA").agg(r9(F.avg("emd")).alias("mean_emd"), F.count("emd").alias("n"))


# ---- W1
@query("cdf_window", with_views(*_DIST_VIEWS, ctes=_DIST_CTES) + """
SELECT qkey, attribute, grp, opt_idx,
       round(sum(p) OVER (PARTITION BY qkey, attribute, grp ORDER BY opt_idx ROWS UNBOUNDED PRECEDING), 9) AS cdf,
       lead(ordinal) OVER (PARTITION BY qkey, attribute, grp ORDER BY opt_idx) AS next_ordinal
FROM dist""")
def q_cdf_window(spark, sf_dir):
    d = D.explode_distribution(cgss_distribution(spark, sf_dir))
    w = Window.partitionBy("qkey", "attribute", "grp").orderBy("opt_idx")
    return d.select("qkey", "attribute", "grp", F.col("opt_idx").cast("bigint").alias("opt_idx"),
                    r9(F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("cdf"),
                    F.lead("ordinal").over(w).alias("next_ordinal"))
