"""Queries: prompt tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorum.functions import rng, text
from quorum.operators import groups as G
from quorum.operators import prompts as P
from quorum.operators.codes import question_body_after_dot
from quorum.operators.joins import bounded_broadcast
from quorum.plans.distribution_queries import _DIST_CTES, _DIST_VIEWS, cgss_distribution, r9
from quorum.plans.oracle_views import with_views
from quorum.plans.registry import query
from quorum.sources import io as IO
from quorum.sources import views as V

SEED = 42
RATIOS = (0.7, 0.2, 0.1)
TEST_WAVES = [2001]


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def splits(spark, sf_dir):
    keys = V.responses(spark, sf_dir).select("qkey").distinct()
    return P.split_questions(keys, *RATIOS, test_waves=TEST_WAVES, seed=SEED)


def prompt_table(spark, sf_dir, n_tokens=100):
    """Prompt table; the (small) distribution feeds both the prompt rows and
    the question split, so it is written once instead of rebuilt from the
    raw answers for each use."""
    demo = G.groups_explode(V.demographics(spark))
    dist = IO.kept(cgss_distribution(spark, sf_dir), "dist")
    spl = P.split_questions(dist.select("qkey"), *RATIOS, test_waves=TEST_WAVES, seed=SEED)
    return P.build_prompts(dist, V.steering(spark), demo, spl, seed=SEED, n_tokens=n_tokens)


_STEER = ",\n".join(f"({_sq(a)}, {_sq(b)}, {_sq(q)}, {_sq(p)})" for a, b, q, p, _, _ in V.STEERING_ROWS)
_SOPT = ",\n".join(f"({_sq(a)}, {i + 1}, {_sq(o)})" for a, _, _, _, _, opts in V.STEERING_ROWS
                   for i, o in enumerate(opts))

_PROMPT_CTES = _DIST_CTES + f"""
steer AS (SELECT * FROM (VALUES {_STEER}) AS t(attribute, bio, qa, portray)),
sopt AS (SELECT * FROM (VALUES {_SOPT}) AS t(attribute, pos, option)),
sq AS (SELECT attribute, string_agg(chr(64 + pos) || '. ' || option, chr(10) ORDER BY pos) AS optlist
       FROM sopt GROUP BY attribute),
qt AS (SELECT 'PRIORITY' AS var, 'Q1. How urgent was your order?' AS question
       UNION ALL SELECT 'STATUS', 'What is the status of your order?'),
qo AS (SELECT var, string_agg(chr(64 + CAST(opt_idx AS INTEGER)) || '. ' || label, chr(10) ORDER BY opt_idx) AS optlist,
              string_agg(chr(64 + CAST(opt_idx AS INTEGER)) || '.', ',' ORDER BY opt_idx) AS letters
       FROM opts GROUP BY var),
ks AS (SELECT DISTINCT qkey FROM dist),
rem AS (SELECT qkey, row_number() OVER (ORDER BY md5('{SEED}:' || qkey), qkey) AS rn, count(*) OVER () AS n
        FROM ks WHERE CAST(regexp_extract(qkey, '_W([0-9]+)$', 1) AS INTEGER) NOT IN ({', '.join(map(str, TEST_WAVES))})),
spl AS (SELECT qkey, CASE WHEN rn <= round_even({RATIOS[0]} * n, 0) THEN 'train'
                          WHEN rn <= round_even({RATIOS[0]} * n, 0) + round_even({RATIOS[1]} * n, 0) THEN 'val'
                          ELSE 'test' END AS split FROM rem
        UNION ALL SELECT qkey, 'test' FROM ks
        WHERE CAST(regexp_extract(qkey, '_W([0-9]+)$', 1) AS INTEGER) IN ({', '.join(map(str, TEST_WAVES))})),
pk AS (SELECT DISTINCT d.qkey, split_part(d.qkey, '_W', 1) AS var, d.attribute, d.grp, d.refusal_rate
       FROM dist d JOIN sopt s ON s.attribute = d.attribute AND s.option = d.grp),
types AS (SELECT unnest(['bio', 'qa', 'portray']) AS steering_type),
pr AS (
  SELECT k.qkey, k.attribute, k.grp, t.steering_type, spl.split, k.refusal_rate,
         CASE t.steering_type
           WHEN 'qa' THEN 'Question: ' || st.qa || chr(10) || sq.optlist || chr(10) || chr(10) || 'Answer: '
                          || chr(64 + so.pos) || '. ' || k.grp || chr(10) || chr(10)
                          || 'Answer the following question keeping in mind your previous answers.' || chr(10)
           WHEN 'bio' THEN replace(st.bio, '. ', '.' || chr(10)) || ' ' || k.grp || '.' || chr(10) || chr(10)
           ELSE replace(st.portray, '. ', '.' || chr(10)) || ' ' || k.grp || '.' || chr(10) || chr(10) END
         || 'Question: ' || trim(qt.question) || chr(10) || qo.optlist || chr(10) || 'Answer as a choice between '
         || qo.letters || chr(10) || chr(10) || 'Answer:' AS input_prompt
  FROM pk k CROSS JOIN types t
  JOIN steer st ON st.attribute = k.attribute JOIN sq ON sq.attribute = k.attribute
  JOIN sopt so ON so.attribute = k.attribute AND so.option = k.grp
  JOIN qt ON qt.var = k.var JOIN qo ON qo.var = k.var JOIN spl ON spl.qkey = k.qkey),"""

PROMPTS_SQL = with_views(*_DIST_VIEWS, ctes=_PROMPT_CTES + """
sums AS (SELECT qkey, attribute, grp, count(*) + 1 AS n_dist, sum(p) AS s FROM dist GROUP BY qkey, attribute, grp)""") + """
SELECT pr.qkey, pr.attribute, pr.grp, pr.steering_type, pr.split, pr.input_prompt, s.n_dist,
       round(s.s + pr.refusal_rate, 9) AS dist_sum
FROM pr JOIN sums s ON s.qkey = pr.qkey AND s.attribute = pr.attribute AND s.grp = pr.grp"""


@query("prompts", PROMPTS_SQL)
def q_prompts(spark, sf_dir):
    p = prompt_table(spark, sf_dir, n_tokens=0)
    from quorum.functions.metrics import array_sum
    return p.select("qkey", "attribute", "grp", "steering_type", "split", "input_prompt",
                    F.size("output_dist").cast("bigint").alias("n_dist"),
                    r9(array_sum("output_dist")).alias("dist_sum"))


@query("split_questions", with_views(*_DIST_VIEWS, ctes=_PROMPT_CTES) + "SELECT qkey, split FROM spl")
def q_split_questions(spark, sf_dir):
    return splits(spark, sf_dir)


for _t in ("qa", "bio", "portray"):
    def _mk(t):
        @query(f"steer_{t}", PROMPTS_SQL.replace("SELECT pr.qkey, pr.attribute, pr.grp, pr.steering_type",
                                                 "SELECT pr.qkey, pr.attribute, pr.grp")
               .replace("round(s.s + pr.refusal_rate, 9) AS dist_sum",
                        "round(s.s + pr.refusal_rate, 9) AS dist_sum").replace(
                   "FROM pr JOIN sums", f"FROM (SELECT * FROM pr WHERE steering_type = '{t}') pr JOIN sums"))
        def _q(spark, sf_dir):
            p = prompt_table(spark, sf_dir, n_tokens=0).where(F.col("steering_type") == t)
            from quorum.functions.metrics import array_sum
            return p.select("qkey", "attribute", "grp", "split", "input_prompt",
                            F.size("output_dist").cast("bigint").alias("n_dist"),
                            r9(array_sum("output_dist")).alias("dist_sum"))
        return _q
    _mk(_t)


_TOKENS_SQL = with_views(*_DIST_VIEWS, ctes=_PROMPT_CTES + """
od AS (SELECT qkey, attribute, grp, opt_idx AS i, p FROM dist
       UNION ALL SELECT qkey, attribute, grp, max(opt_idx) + 1, max(refusal_rate) FROM dist GROUP BY qkey, attribute, grp),
cum AS (SELECT qkey, attribute, grp, i, sum(p) OVER (PARTITION BY qkey, attribute, grp ORDER BY i ROWS UNBOUNDED PRECEDING) AS c,
               sum(p) OVER (PARTITION BY qkey, attribute, grp ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS total,
               count(*) OVER (PARTITION BY qkey, attribute, grp) AS n FROM od),
dr AS (SELECT pk.qkey, pk.attribute, pk.grp, t.steering_type, d.draw,
              cast(('0x' || substr(md5('""" + str(SEED) + """:' || pk.qkey || ':' || pk.attribute || ':' || pk.grp || ':'
                    || t.steering_type || ':' || CAST(d.draw AS VARCHAR)), 1, 8)) AS UBIGINT) / 4294967296.0 AS u
       FROM pk CROSS JOIN types t CROSS JOIN (SELECT unnest(range(0, 100)) AS draw) d),
pick AS (SELECT dr.qkey, dr.attribute, dr.grp, dr.steering_type, dr.draw,
                least(count(c.i) FILTER (WHERE c.c <= dr.u * c.total), max(c.n) - 1) AS idx
         FROM dr JOIN cum c ON c.qkey = dr.qkey AND c.attribute = dr.attribute AND c.grp = dr.grp
         GROUP BY dr.qkey, dr.attribute, dr.grp, dr.steering_type, dr.draw)""") + """
SELECT qkey, attribute, grp, steering_type, draw, ' ' || chr(65 + CAST(idx AS INTEGER)) AS token FROM pick"""


@query("sample_tokens", _TOKENS_SQL)
def q_sample_tokens(spark, sf_dir):
    p = prompt_table(spark, sf_dir)
    return (p.select("qkey", "attribute", "grp", "steering_type", F.posexplode("output_token").alias("draw", "token"))
             .select("qkey", "attribute", "grp", "steering_type", F.col("draw").cast("bigint").alias("draw"), "token"))


# ---- F14 / F19
_MCQ_SQL = with_views(*_DIST_VIEWS, "variables", ctes=_DIST_CTES + """
allo AS (SELECT var, string_agg(chr(64 + CAST(pos AS INTEGER)) || '. ' || trim(label), chr(10) ORDER BY pos) AS optlist,
                string_agg(chr(64 + CAST(pos AS INTEGER)) || '.', ',' ORDER BY pos) AS letters FROM codebook GROUP BY var),
body AS (SELECT var, CASE WHEN instr(label, '.') > 0 THEN trim(substr(label, instr(label, '.') + 1)) ELSE '' END AS q
         FROM variables),
m AS (SELECT DISTINCT r.qkey, 'Question: ' || b.q || chr(10) || a.optlist || chr(10) || 'Answer as a choice between '
             || a.letters || chr(10) || chr(10) || 'Answer:' AS mcq
      FROM responses r JOIN allo a ON a.var = r.var JOIN body b ON b.var = r.var)""")


def _question_mcq(spark, sf_dir):
    cb = V.codebook(spark)
    labels = (cb.groupBy("var").agg(F.sort_array(F.collect_list(F.struct("pos", "label"))).alias("_l"))
                .select("var", F.transform("_l", lambda x: x["label"]).alias("options")))
    body = V.variables(spark).select("var", question_body_after_dot("label").alias("question"))
    keys = V.responses(spark, sf_dir).select("qkey", "var").distinct()
    return (keys.join(bounded_broadcast(labels), "var").join(bounded_broadcast(body), "var")
                .select("qkey", text.mcq("question", "options", add_answer_forcing=True).alias("mcq")))


@query("mcq", _MCQ_SQL + "SELECT qkey, mcq FROM m")
def q_mcq(spark, sf_dir):
    return _question_mcq(spark, sf_dir)


@query("get_mcq", _MCQ_SQL + """
SELECT qkey, 'user' AS role, trim(split_part(mcq, 'Answer:', 1), ' ' || chr(10)) AS content FROM m""")
def q_get_mcq(spark, sf_dir):
    m = _question_mcq(spark, sf_dir)
    return m.select("qkey", F.lit("user").alias("role"),
                    text.strip(F.split("mcq", "Answer:").getItem(0)).alias("content"))


# ---- F18
@query("chat_messages", with_views(*_DIST_VIEWS, ctes=_PROMPT_CTES + """
qa AS (SELECT qkey, attribute, grp, input_prompt AS p FROM pr WHERE steering_type = 'qa'),
parts AS (SELECT qkey, attribute, grp, trim(split_part(p, 'Answer:', 1), ' ' || chr(10)) AS s1,
                 trim(split_part(p, 'Answer:', 2), ' ' || chr(10)) AS s2 FROM qa),
msg AS (SELECT *, trim(split_part(s2, chr(10), 1), ' ' || chr(10)) AS ans FROM parts)""") + """
SELECT qkey, attribute, grp, 1 AS turn, 'user' AS role, s1 AS content FROM msg
UNION ALL SELECT qkey, attribute, grp, 2, 'assistant', ans FROM msg
UNION ALL SELECT qkey, attribute, grp, 3, 'user', trim(replace(s2, ans, ''), ' ' || chr(10)) FROM msg""")
def q_chat_messages(spark, sf_dir):
    p = prompt_table(spark, sf_dir, n_tokens=0).where(F.col("steering_type") == "qa")
    m = p.select("qkey", "attribute", "grp", F.posexplode(text.chat_messages("input_prompt")).alias("i", "m"))
    return m.select("qkey", "attribute", "grp", (F.col("i") + 1).alias("turn"),
                    F.col("m.role").alias("role"), F.col("m.content").alias("content"))


# ---- F20
# The refinement instruction and its four worked examples.
REFINE_INSTRUCTION = (
    "Instruction: Refine the question with a minimal change to make the question sensible."
    " Do not modify options, and do not modify a question if it makes sense. "
    "Always start your answer with \"Refined question:\".")
REFINE_EXAMPLES = [
    "Question: A cross // Do you have any of the following for spiritual purposes?\n"
    "A. Yes, I have this for spiritual purposes\nB. No, I do not have this for spiritual purposes\n\n"
    "Refined question: Do you have a cross for spiritual purposes?",
    "Question: As you may know, same-sex marriage is now legal in the U.S. Do you think this is "
    "[a good thing or a bad thing] for our society?\nA. Very good thing\nB. Somewhat good thing\n"
    "C. Somewhat bad thing\nD. Very bad thing\n\nRefined question: As you may know, same-sex marriage is now "
    "legal in the U.S. Do you think this is a good thing or a bad thing for our society?",
    "Question: On a different subject…How much, if at all, do white people benefit from advantages in "
    "society that black people do not have\nA. A great deal\nB. A fair amount\nC. Not too much\nD. Not at all\n\n"
    "Refined question: How much, if at all, do white people benefit from advantages in society that black "
    "people do not have?",
    "Question: Thinking about the past couple of weeks, would you say the news for Donald Trump has been...\n"
    "A. Very good\nB. Mostly good\nC. Neither good nor bad\nD. Mostly bad\nE. Very bad\n\n"
    "Refined question: Thinking about the past couple of weeks, would you say the news for Donald Trump has been...",
]
REFINE_HEAD = REFINE_INSTRUCTION + "\n\n" + "\n\n".join(REFINE_EXAMPLES) + "\n\n"


@query("refine_prompt", _MCQ_SQL + f"""
SELECT qkey, {_sq(REFINE_HEAD)} || trim(regexp_replace(split_part(mcq, 'Refused', 1), '\\n[^\\n]*$', ''), ' ' || chr(10)) AS prompt
FROM m""")
def q_refine_prompt(spark, sf_dir):
    return _question_mcq(spark, sf_dir).select("qkey", P.refine_prompt(F.col("mcq"), REFINE_HEAD).alias("prompt"))


@query("refine_clean", _MCQ_SQL + """
SELECT qkey, trim(replace('Refined question: ' || mcq || ' ', 'Refined question:', ''), ' ' || chr(10)) AS refined FROM m""")
def q_refine_clean(spark, sf_dir):
    """Replies that repeat the whole question with its options."""
    reply = F.concat(F.lit("Refined question: "), "mcq", F.lit(" "))
    return _question_mcq(spark, sf_dir).select("qkey", P.refine_clean(reply).alias("refined"))


# ---- U4
@query("except_keys", with_views(*_DIST_VIEWS, ctes=_PROMPT_CTES) + """
SELECT qkey FROM ks WHERE qkey NOT IN (SELECT qkey FROM spl WHERE split = 'test')""")
def q_except_keys(spark, sf_dir):
    keys = V.responses(spark, sf_dir).select("qkey").distinct()
    return P.except_keys(keys, splits(spark, sf_dir).where(F.col("split") == "test"))


# ---- T7
@query("shuffle", with_views(*_DIST_VIEWS, ctes=_PROMPT_CTES) + f"""
SELECT split, qkey, attribute, grp, steering_type,
       row_number() OVER (PARTITION BY split ORDER BY md5('{SEED}:' || qkey || ':' || attribute || ':' || grp || ':'
                                                          || steering_type)) - 1 AS row_idx
FROM pr""")
def q_shuffle(spark, sf_dir):
    from quorum.operators.sequences import global_row_index
    p = prompt_table(spark, sf_dir, n_tokens=0).select("split", "qkey", "attribute", "grp", "steering_type")
    key = rng.hash_order(SEED, F.col("qkey"), F.col("attribute"), F.col("grp"), F.col("steering_type"))
    return global_row_index(p.withColumn("_k", key), ["_k"], partition_cols=["split"]).drop("_k")


# ---- J4 / J8
def _steering_join(spark, sf_dir):
    d = cgss_distribution(spark, sf_dir)
    s = V.steering(spark)
    j = d.join(bounded_broadcast(s.select("attribute", "qa_prompt", F.col("options").alias("s_options"))), "attribute")
    # the reference asserts the group is a steering option: a filter keeps the check in the plan
    return j.where(F.when(F.array_contains("s_options", F.col("grp")), F.lit(True))
                    .otherwise(F.raise_error(F.concat(F.lit("group not in steering options: "), "grp"))
                               .cast("boolean")))


@query("steer_join", with_views(*_DIST_VIEWS, ctes=_PROMPT_CTES) + """
SELECT DISTINCT d.qkey, d.attribute, d.grp, st.qa AS qa_prompt FROM dist d JOIN steer st ON st.attribute = d.attribute""")
def q_steer_join(spark, sf_dir):
    return _steering_join(spark, sf_dir).select("qkey", "attribute", "grp", "qa_prompt")


@query("demo_join", with_views(*_DIST_VIEWS, ctes=_PROMPT_CTES) + """
SELECT DISTINCT qkey, attribute, grp FROM pk""")
def q_demo_join(spark, sf_dir):
    demo = G.groups_explode(V.demographics(spark))
    d = cgss_distribution(spark, sf_dir)
    return d.join(bounded_broadcast(demo), ["attribute", "grp"]).select("qkey", "attribute", "grp")


# ---- F31
@query("parse_literal", with_views(*_DIST_VIEWS, ctes=_DIST_CTES.rstrip().rstrip(",")) + """
SELECT qkey, attribute, grp, opt_idx, form, round(p, 9) AS p, option
FROM dist CROSS JOIN (SELECT unnest(['python', 'numpy', 'nan']) AS form)""")
def q_parse_literal(spark, sf_dir):
    """Literal text written the three ways seen in files (Python list, with
    nan, NumPy spacing) parses back to the distribution's own numbers and labels."""
    d = cgss_distribution(spark, sf_dir).select("qkey", "attribute", "grp", "responses", "options")
    py = F.concat(F.lit("["), F.array_join(F.transform("responses", lambda x: x.cast("string")), ", "), F.lit("]"))
    npy = F.concat(F.lit("["), F.array_join(F.transform("responses", lambda x: x.cast("string")), " "), F.lit("]"))
    withnan = F.concat(F.lit("["), F.array_join(F.transform("responses", lambda x: x.cast("string")), ", "),
                       F.lit(", nan]"))
    opts = F.concat(F.lit("["), F.array_join(F.transform("options", lambda o: F.concat(
        F.lit("'"), F.replace(o, F.lit("'"), F.lit("\\'")), F.lit("'"))), ", "), F.lit("]"))
    p = d.select("qkey", "attribute", "grp", "responses", "options",
                 text.parse_literal(py).alias("a"), text.parse_literal(npy).alias("b"),
                 text.parse_literal(withnan).alias("c"), text.parse_literal(opts, "string").alias("o"))
    forms = F.explode(F.array(F.struct(F.lit("python").alias("form"), F.col("a").alias("v")), F.struct(F.lit("numpy").alias("form"), F.col("b").alias("v")),
                              F.struct(F.lit("nan").alias("form"), F.filter("c", lambda x: ~F.isnan(x)).alias("v"))))
    each = p.select("qkey", "attribute", "grp", "o", forms.alias("f"))
    return (each.select("qkey", "attribute", "grp", "f.form", F.posexplode(F.arrays_zip(F.col("f.v").alias("p"), F.col("o").alias("option"))).alias("i", "x"))
                .select("qkey", "attribute", "grp", (F.col("i") + 1).cast("bigint").alias("opt_idx"), "form", F.round("x.p", 9).alias("p"), "x.option"))