"""Queries: predicates, lookups, joins and set operations on survey data
(P1–P18, J1–J13, U1–U3, S9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorum.operators import codes as C
from quorum.operators import distribution as D
from quorum.operators import groups as G
from quorum.operators import responses as R
from quorum.operators.joins import bounded_broadcast
from quorum.plans.distribution_queries import _DIST_CTES, _INVALID, _REFUSED, cgss_distribution
from quorum.plans.oracle_views import with_views
from quorum.plans.registry import query
from quorum.sources import views as V
from quorum.sources.driver import table

# Fixed values used by the queries below (parameters of the operators).
ERROR_QKEYS = ["PRIORITY_W2001"]
EXTRA_REMOVED_WAVES = [1997]
SUBGROUP_ATTRS, SUBGROUP_TRAITS = ["SEGMENT", "REGION"], ["BUILDING", "ASIA"]
RECODE = {("SEGMENT", "AUTOMOBILE"): "Cars", ("REGION", "MIDDLE EAST"): "Middle East"}
TRAITS = [("NATION", "NATION", "nation_1", "prefix"), ("NATION", "NATION", "Nation_2", "prefix"),
          ("NATION", "NATION", "nation_3|NATION_7|nation_24", "list"), ("NATION", "NATION", "zzz", "prefix")]
LINE_JOINT = ["RETURNFLAG", "LINESTATUS", "QTY", "DISCOUNT"]


def _qkeys(spark, sf_dir):
    return V.responses(spark, sf_dir).select("qkey").distinct()


# ---- P1
_WAVE_SQL = "CAST(regexp_extract(qkey, '_W([0-9]+)$', 1) AS INTEGER)"


@query("filter_qkeys", with_views("responses") + f"""
SELECT DISTINCT qkey FROM responses
WHERE qkey NOT IN ('PRIORITY_W2001') AND lower(split_part(qkey, '_W', 1)) NOT IN ('partyln')
  AND {_WAVE_SQL} NOT IN ({', '.join(str(w) for w in C.PROHIBITED_WAVES + C.REMOVED_WAVES + EXTRA_REMOVED_WAVES)})""")
def q_filter_qkeys(spark, sf_dir):
    err = spark.createDataFrame([(k,) for k in ERROR_QKEYS], "qkey string")
    return C.filter_qkeys(_qkeys(spark, sf_dir), err,
                          removed_waves=C.REMOVED_WAVES + EXTRA_REMOVED_WAVES)


# ---- P2
@query("wave_number", with_views("responses") + f"SELECT DISTINCT qkey, {_WAVE_SQL} AS wave FROM responses")
def q_wave_number(spark, sf_dir):
    return _qkeys(spark, sf_dir).select("qkey", C.wave_number("qkey").alias("wave"))


# ---- P3
@query("filter_missing", with_views("responses") + """
SELECT qkey, count(*) AS n_answered FROM responses WHERE code IS NOT NULL AND NOT isnan(code) GROUP BY qkey""")
def q_filter_missing(spark, sf_dir):
    return (V.responses(spark, sf_dir).where(C.answered("code"))
             .groupBy("qkey").agg(F.count(F.lit(1)).alias("n_answered")))


# ---- P4
@query("filter_refusal", with_views("responses", "codebook", ctes="""
ref AS (SELECT var, arg_max(code, pos) AS refusal_code FROM codebook GROUP BY var)""") + """
SELECT r.qkey, count(*) AS n_kept FROM responses r LEFT JOIN ref f ON f.var = r.var
WHERE r.code IS NOT NULL AND NOT isnan(r.code) AND (f.refusal_code IS NULL OR r.code <> f.refusal_code)
GROUP BY r.qkey""")
def q_filter_refusal(spark, sf_dir):
    r = R.drop_refusal(V.responses(spark, sf_dir).where(C.answered("code")), V.codebook(spark))
    return r.groupBy("qkey").agg(F.count(F.lit(1)).alias("n_kept"))


# ---- P5
@query("subpop_filter", with_views("respondents") + """
SELECT human_id, wave FROM respondents WHERE segment = 'BUILDING' AND region = 'ASIA'""")
def q_subpop_filter(spark, sf_dir):
    pred = G.subpop_filter(V.ATTRIBUTE_COLUMNS, G.code_map(V.GROUP_CODE_ROWS), SUBGROUP_ATTRS, SUBGROUP_TRAITS)
    return V.respondents(spark, sf_dir).where(pred).select("human_id", "wave")


# ---- P6
@query("subpop_indicator", with_views("respondents") + """
SELECT human_id FROM respondents WHERE cust_id % 2 = 0 OR cust_id % 5 = 0""")
def q_subpop_indicator(spark, sf_dir):
    r = V.respondents(spark, sf_dir)
    ind = r.select("human_id", *[F.when(F.col("cust_id") % m == 0, 1).otherwise(0).alias(f"ind_{i}")
                                 for i, m in ((1, 2), (2, 3), (3, 5))])
    return ind.where(G.indicator_any(["ind_1", "ind_3"])).select("human_id")


# ---- P7
@query("subpop_in", with_views("respondents", "group_codes") + """
SELECT r.human_id, g.attribute, g.grp FROM respondents r JOIN group_codes g ON g.attribute = 'SEGMENT' AND g.code = r.segment
UNION ALL SELECT r.human_id, g.attribute, g.grp FROM respondents r JOIN group_codes g ON g.attribute = 'REGION' AND g.code = r.region
UNION ALL SELECT r.human_id, g.attribute, g.grp FROM respondents r
  JOIN group_codes g ON g.attribute = 'BALANCE' AND g.code = CAST(r.balance_code AS VARCHAR)""")
def q_subpop_in(spark, sf_dir):
    m = D.membership(V.respondents(spark, sf_dir), V.ATTRIBUTE_COLUMNS, V.group_codes(spark), overall=False)
    return m.select("human_id", "attribute", "grp")


# ---- P8
@query("convert_field", """
WITH cb AS (SELECT 'NATION' AS var, n_nationkey + 1 AS pos, n_nationkey AS code, lower(n_name) AS l FROM nation),
tr AS (SELECT * FROM (VALUES ('NATION', 'NATION', 'nation_1', 'prefix'), ('NATION', 'NATION', 'Nation_2', 'prefix'),
       ('NATION', 'NATION', 'nation_3|NATION_7|nation_24', 'list'), ('NATION', 'NATION', 'zzz', 'prefix'))
       AS t(attribute, var, trait, mode))
SELECT tr.attribute, tr.trait, tr.mode, arg_min(cb.code, cb.pos) AS code, 'c_nationkey' AS "column"
FROM tr JOIN cb ON cb.var = tr.var WHERE tr.mode = 'prefix' AND starts_with(cb.l, lower(tr.trait))
GROUP BY tr.attribute, tr.trait, tr.mode
UNION ALL
SELECT tr.attribute, tr.trait, tr.mode, cb.code, 'c_nationkey' AS "column"
FROM tr JOIN cb ON cb.var = tr.var WHERE tr.mode = 'list' AND list_contains(string_split(lower(tr.trait), '|'), cb.l)""")
def q_convert_field(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    cb = nation.select(F.lit("NATION").alias("var"), (F.col("n_nationkey") + 1).alias("pos"),
                       F.col("n_nationkey").alias("code"), F.col("n_name").alias("label"))
    col = G.choose_column(table(spark, sf_dir, "customer").columns, ["nationkey", "c_nationkey"])
    tr = spark.createDataFrame(TRAITS, "attribute string, var string, trait string, mode string")
    return G.convert_traits(tr, cb).select("attribute", "trait", "mode", "code", F.lit(col).alias("column"))


# ---- P8 over waves that name and code an attribute in their own ways
_P8_COLUMNS = {"REGION": ["F_REGION", "F_CREGION"], "SEGMENT": ["F_SEGMENT"]}
_P8_REGIONS = [g for a, g, _ in V.GROUP_CODE_ROWS if a == "REGION"]


@query("convert_field_waves", with_views("respondents") + """
SELECT human_id, wave, 'REGION' AS attribute, region AS grp FROM respondents WHERE region IS NOT NULL
UNION ALL SELECT human_id, wave, 'SEGMENT', segment FROM respondents WHERE segment IS NOT NULL""")
def q_convert_field_waves(spark, sf_dir):
    """One membership from waves that hold the region as a number in F_REGION
    (even years) or as a letter code in F_CREGION (odd ones)."""
    from quorum.sources import io as IO
    r = V.respondents(spark, sf_dir).select(F.col("human_id").alias("QKEY"), "wave", "region", F.col("segment").alias("F_SEGMENT"))
    number = F.array_position(F.array(*[F.lit(x) for x in _P8_REGIONS]), F.col("region")).cast("int")
    root, waves = IO.scratch(spark, "layouts"), []
    for odd, own in ((0, number.alias("F_REGION")), (1, F.concat(F.lit("R"), number.cast("string")).alias("F_CREGION"))):
        part = r.where(F.col("wave") % 2 == odd).select("QKEY", "wave", "F_SEGMENT", own)
        part.write.mode("append").partitionBy("wave").parquet(root)
        waves += [x.wave for x in part.select("wave").distinct().collect()]  # names of folders
    # the resolution table: the codes of every wave's own column, from its codebook
    found = IO.resolved_columns(spark, root, waves, _P8_COLUMNS)
    codes = {"F_REGION": [(g, str(i)) for i, g in enumerate(_P8_REGIONS, 1)], "F_CREGION": [(g, f"R{i}") for i, g in enumerate(_P8_REGIONS, 1)],
             "F_SEGMENT": [(g, c) for a, g, c in V.GROUP_CODE_ROWS if a == "SEGMENT"]}
    rows = [(w, a, column, g, c) for w, a, column in found for g, c in codes[column]]
    resolution = spark.createDataFrame(rows, "wave int, attribute string, var string, grp string, code string")
    people = IO.scan_wave_attributes(spark, root, waves, _P8_COLUMNS)
    return G.wave_membership(people, resolution).select(F.col("QKEY").alias("human_id"), "wave", "attribute", "grp")


# ---- P9 / X1
_RECODE_SQL = ("CASE " + " ".join(f"WHEN attribute = '{a}' AND grp = '{g}' THEN '{n}'" for (a, g), n in RECODE.items())
               + " ELSE grp END")


@query("recode_group", with_views("responses", "codebook", "group_codes", ctes=_DIST_CTES) + f"""
SELECT DISTINCT qkey, attribute, grp, {_RECODE_SQL} AS recoded FROM dist""")
def q_recode_group(spark, sf_dir):
    d = cgss_distribution(spark, sf_dir)
    return d.select("qkey", "attribute", "grp", G.recode_group("attribute", "grp", RECODE).alias("recoded"))


# ---- P10
@query("code_status", with_views("responses") + f"""
SELECT qkey, CASE WHEN code IS NULL OR isnan(code) THEN 'missing' WHEN {_REFUSED} THEN 'refused'
                  WHEN {_INVALID} THEN 'invalid' ELSE 'valid' END AS status, count(*) AS n
FROM responses GROUP BY 1, 2""")
def q_code_status(spark, sf_dir):
    rp = C.resolve_policy(V.question_policy(spark), V.GLOBAL_INVALID, V.GLOBAL_REFUSAL)
    r = V.responses(spark, sf_dir).join(bounded_broadcast(rp), "var", "left")
    return (r.select("qkey", C.code_status("code", "refusal_set", "invalid_set").alias("status"))
             .groupBy("qkey", "status").agg(F.count(F.lit(1)).alias("n")))


# ---- P11
@query("weight_policy", with_views("respondents") + """
SELECT 'cgss' AS policy, count(*) AS n, round(sum(weight), 2) AS w_sum FROM respondents
  WHERE weight IS NOT NULL AND NOT isnan(weight) AND weight > 0 AND weight < CAST('inf' AS DOUBLE)
UNION ALL SELECT 'gss', count(*), round(sum(weight), 2) FROM respondents WHERE weight IS NOT NULL AND NOT isnan(weight)
UNION ALL SELECT 'atp', count(*), round(sum(CASE WHEN weight IS NULL OR isnan(weight) THEN 0 ELSE weight END), 2)
  FROM respondents""")
def q_weight_policy(spark, sf_dir):
    r = V.respondents(spark, sf_dir)
    aggs = [F.count_if(C.weight_ok("weight", p)).alias(f"n_{p}") for p in ("cgss", "gss", "atp")]
    aggs += [F.sum(F.when(C.weight_ok("weight", p), C.weight_value("weight", p))).alias(f"w_{p}")
             for p in ("cgss", "gss", "atp")]
    one = r.agg(*aggs)  # one pass, three policies
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(p).alias("policy"), F.col(f"n_{p}").alias("n"), F.round(F.col(f"w_{p}"), 2).alias("w_sum"))
        for p in ("cgss", "gss", "atp")])).alias("x")).select("x.*")


# ---- P12
@query("coerce_numeric", r"""
SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN event_type
                               ELSE regexp_extract(props, ':\s*([0-9]+)', 1) END AS DOUBLE) AS x
FROM events""")
def q_coerce_numeric(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    raw = F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(
        F.regexp_extract("props", r":\s*([0-9]+)", 1))
    return ev.select("event_id", C.coerce_numeric(raw).alias("x"))


# ---- P13 / U2
_POLICY_WITH_PLACEHOLDER = V.QUESTION_POLICY_ROWS + [("__REPLACE_ME", [], None, None, "train")]


def _questions_for_split(spark, sf_dir, split):
    pol = V.literal_table(spark, _POLICY_WITH_PLACEHOLDER, V.question_policy(spark).schema)
    present = V.responses(spark, sf_dir).select("var").distinct()
    labelled = V.codebook(spark).select("var").distinct()
    q = C.questions_for_split(pol, split, legacy=V.literal_table(spark, [("PRIORITY",)], "var string"))
    q = q.join(bounded_broadcast(labelled), "var")  # questions without labels are skipped
    return q.join(present, "var", "left_semi").select("var", "split")


@query("question_split_cfg", with_views("responses", "codebook") + """
SELECT DISTINCT r.var, CASE r.var WHEN 'PRIORITY' THEN 'train' ELSE 'eval' END AS split
FROM responses r WHERE r.var IN (SELECT var FROM codebook)""")
def q_question_split_cfg(spark, sf_dir):
    return _questions_for_split(spark, sf_dir, "all")


@query("union_questions", with_views("responses", "codebook") + """
SELECT DISTINCT r.var, CASE r.var WHEN 'PRIORITY' THEN 'train' ELSE 'eval' END AS split
FROM responses r WHERE r.var IN (SELECT var FROM codebook)""")
def q_union_questions(spark, sf_dir):
    return (_questions_for_split(spark, sf_dir, "train")
            .unionByName(_questions_for_split(spark, sf_dir, "eval")))


# ---- P17
@query("build_options", with_views("responses", "codebook") + f"""
SELECT var, code, trim(label) AS label, row_number() OVER (PARTITION BY var ORDER BY code) AS opt_idx,
       CAST(row_number() OVER (PARTITION BY var ORDER BY code) AS DOUBLE) AS ordinal
FROM codebook WHERE NOT {_REFUSED} AND NOT {_INVALID} AND var IN (SELECT DISTINCT var FROM responses)""")
def q_build_options(spark, sf_dir):
    rp = C.resolve_policy(V.question_policy(spark), V.GLOBAL_INVALID, V.GLOBAL_REFUSAL)
    o = C.build_options(V.codebook(spark), rp).join(V.responses(spark, sf_dir).select("var").distinct(),
                                                    "var", "left_semi")
    return (o.select("var", F.posexplode(F.arrays_zip("codes", "options", "ordinal")).alias("i", "x"))
             .select("var", F.col("x.codes").alias("code"), F.col("x.options").alias("label"),
                     (F.col("i") + 1).cast("bigint").alias("opt_idx"), F.col("x.ordinal").alias("ordinal")))


# ---- P18
@query("question_text", with_views("responses", "variables") + """
SELECT v.var, coalesce(CASE WHEN v.var = 'STATUS' THEN 'What is the status of your order?' END, trim(v.label)) AS question,
       CASE WHEN instr(v.label, '.') > 0 THEN trim(substr(v.label, instr(v.label, '.') + 1)) ELSE '' END AS body
FROM variables v WHERE v.var IN (SELECT DISTINCT var FROM responses)""")
def q_question_text(spark, sf_dir):
    rp = V.question_policy(spark).select("var", "question_text")
    v = V.variables(spark).join(rp, "var", "left").join(
        V.responses(spark, sf_dir).select("var").distinct(), "var", "left_semi")
    return v.select("var", C.question_text("question_text", "label", "var").alias("question"),
                    C.question_body_after_dot("label").alias("body"))


# ---- J1
@query("resp_semi", with_views("responses", "codebook", ctes="""
ref AS (SELECT var, arg_max(code, pos) AS refusal_code FROM codebook GROUP BY var)""") + """
SELECT r.qkey, r.human_id, r.code FROM responses r JOIN ref f ON f.var = r.var
WHERE r.code IS NOT NULL AND NOT isnan(r.code) AND r.code <> f.refusal_code
  AND r.cust_id IN (SELECT c.c_custkey FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
                    JOIN region g ON g.r_regionkey = n.n_regionkey WHERE g.r_name = 'ASIA')""")
def q_resp_semi(spark, sf_dir):
    c, n, g = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    asia = (c.join(bounded_broadcast(n), c.c_nationkey == n.n_nationkey)
             .join(bounded_broadcast(g.where(F.col("r_name") == "ASIA")), F.col("n_regionkey") == F.col("r_regionkey"))
             .select(F.col("c_custkey").alias("cust_id")))
    r = R.drop_refusal(V.responses(spark, sf_dir).where(C.answered("code")), V.codebook(spark))
    return R.responses_in(r, asia, "cust_id").select("qkey", "human_id", "code")


# ---- J2
_ALL = " AND ".join(f"{q} IS NOT NULL" for q in LINE_JOINT)


@query("joint_responses", with_views("line_answers") + " UNION ALL ".join(
    f"SELECT human_id, {i + 1} AS pos, {q} AS code FROM line_answers WHERE {_ALL}" for i, q in enumerate(LINE_JOINT)))
def q_joint_responses(spark, sf_dir):
    j = R.joint_responses_wide(V.line_answers(spark, sf_dir), LINE_JOINT)
    return (j.select("human_id", F.posexplode("codes").alias("p", "code"))
             .select("human_id", (F.col("p") + 1).alias("pos"), "code"))


@query("joint_responses_long", with_views("responses") + """
SELECT p.human_id, x.pos, CASE x.pos WHEN 1 THEN p.code ELSE s.code END AS code
FROM responses p JOIN responses s ON s.human_id = p.human_id AND p.var = 'PRIORITY' AND s.var = 'STATUS'
CROSS JOIN (SELECT unnest([1, 2]) AS pos) x WHERE p.code IS NOT NULL AND s.code IS NOT NULL""")
def q_joint_responses_long(spark, sf_dir):
    """J2 on long answers: everybody who answered both questions of their wave."""
    r = V.responses(spark, sf_dir).select("human_id", F.col("var").alias("qkey"), "code")
    j = R.joint_responses_long(r, ["PRIORITY", "STATUS"])
    return j.select("human_id", F.posexplode("codes").alias("p", "code")).select("human_id", (F.col("p") + 1).alias("pos"), "code")


# ---- J3
@query("wave_weights", with_views("respondents") + "SELECT human_id AS QKEY, wave, weight FROM respondents")
def q_wave_weights(spark, sf_dir):
    """Each wave's table names its weight column ``WEIGHT_W<wave>``; the
    column is found by pattern per wave (schema metadata) — all waves."""
    from quorum.sources import io as IO
    root = IO.scratch(spark, "weights")
    waves = IO.write_waves(V.respondents(spark, sf_dir).select(F.col("human_id").alias("QKEY"), "wave", F.col("weight").alias("WEIGHT")), root)
    return IO.scan_wave_weights(spark, root, waves)


# ---- J5
def _group_pairs():
    return [(a, g) for a, g, _ in V.GROUP_CODE_ROWS]


@query("grid_cross", with_views("responses", "group_codes") + """
SELECT q.qkey, g.attribute, g.grp
FROM (SELECT DISTINCT qkey FROM responses) q,
     (SELECT DISTINCT attribute, grp FROM group_codes UNION ALL SELECT 'Overall', 'Overall') g""")
def q_grid_cross(spark, sf_dir):
    return G.group_grid(_qkeys(spark, sf_dir), _group_pairs())


# ---- J13
@query("get_response", with_views("responses", "respondents", "codebook", ctes="""
mx AS (SELECT var, max(pos) AS maxpos FROM codebook GROUP BY var)""") + """
SELECT p.human_id, k.qkey,
       CAST(CASE WHEN r.human_id IS NULL THEN -3 WHEN c.pos IS NULL THEN -2 WHEN c.pos = mx.maxpos THEN -1
            ELSE c.pos - 1 END AS INTEGER) AS idx,
       CASE WHEN r.human_id IS NULL THEN 'Not participated for wave' WHEN c.pos IS NULL THEN 'Nan response'
            ELSE c.label END AS label
FROM respondents p CROSS JOIN (SELECT DISTINCT qkey FROM responses) k
LEFT JOIN responses r ON r.human_id = p.human_id AND r.qkey = k.qkey
LEFT JOIN codebook c ON c.var = r.var AND c.code = r.code
LEFT JOIN mx ON mx.var = r.var""")
def q_get_response(spark, sf_dir):
    """Every respondent's answer to every question of every wave."""
    r = V.respondents(spark, sf_dir)
    answers = V.responses_from(r)
    look = r.select("human_id").crossJoin(F.broadcast(answers.select("qkey").distinct()))  # question names
    return R.lookup_responses(look, answers, V.codebook(spark))


# ---- U1
@query("union_groups", with_views("responses", "codebook", "group_codes", ctes=_DIST_CTES) + """
SELECT DISTINCT qkey, attribute, grp FROM dist
UNION ALL SELECT DISTINCT qkey, 'SEGMENT' AS attribute, 'BUILDING' AS grp FROM dist
  WHERE attribute = 'SEGMENT' AND grp = 'BUILDING'""")
def q_union_groups(spark, sf_dir):
    """Union of per-group frames (here: the full table and one group's slice)."""
    d = cgss_distribution(spark, sf_dir).select("qkey", "attribute", "grp")
    one = d.where((F.col("attribute") == "SEGMENT") & (F.col("grp") == "BUILDING"))
    return d.unionByName(one)


# ---- U3
@query("intersect_ids", with_views("line_responses") + """
SELECT human_id FROM line_responses WHERE qkey = 'RETURNFLAG'
INTERSECT SELECT human_id FROM line_responses WHERE qkey = 'QTY'""")
def q_intersect_ids(spark, sf_dir):
    lr = V.line_responses(spark, sf_dir).select("human_id", "qkey")
    return R.intersect_ids(lr.where(F.col("qkey") == "RETURNFLAG"), lr.where(F.col("qkey") == "QTY"))


# ---- S9
@query("groups_explode", """
SELECT 'SEGMENT' AS attribute, c_mktsegment AS grp FROM (SELECT DISTINCT c_mktsegment FROM customer)
UNION ALL SELECT 'REGION', r_name FROM (SELECT DISTINCT r_name FROM region)""")
def q_groups_explode(spark, sf_dir):
    def catalogue(df, attr, col):
        return df.agg(F.sort_array(F.collect_set(col)).alias("_g")).select(
            F.lit(attr).alias("attribute"),
            F.concat(F.lit("['"), F.array_join("_g", "', '"), F.lit("']")).alias("group"))
    cat = catalogue(table(spark, sf_dir, "customer"), "SEGMENT", "c_mktsegment").unionByName(
        catalogue(table(spark, sf_dir, "region"), "REGION", "r_name"))
    return G.groups_explode(cat)
