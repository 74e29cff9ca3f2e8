"""Queries on survey metadata that is derived from the given tables: part
types as questions with their brands as options, regions as attributes with
their nations as groups (P13, P17, P18, U2, S3, S6, S8)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorum.operators import codes as C
from quorum.plans.registry import query
from quorum.sources import io as IO
from quorum.sources.driver import table

REFUSED, INVALID = [3.0], [5.0]  # codes that count as refused and invalid in every question

_CODEBOOK_SQL = """
WITH b AS (SELECT DISTINCT p_type AS var, p_brand AS label FROM part),
codebook AS (SELECT var, row_number() OVER (PARTITION BY var ORDER BY label) AS pos,
                    CAST(row_number() OVER (PARTITION BY var ORDER BY label) AS DOUBLE) AS code, label FROM b),
q AS (SELECT p_type AS var, count(*) AS parts, min(p_name) AS named FROM part GROUP BY p_type)"""


def codebook(spark, sf_dir):
    """(var, pos, code, label): one question per part type, an option per brand."""
    pairs = table(spark, sf_dir, "part").select(F.col("p_type").alias("var"), F.col("p_brand").alias("label")).distinct()
    pos = F.row_number().over(Window.partitionBy("var").orderBy("label"))  # the options of one question
    return pairs.select("var", pos.alias("pos"), pos.cast("double").alias("code"), "label")


def questions(spark, sf_dir):
    """(var, parts, named): a question's size and a name from the table."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("var")).agg(
        F.count(F.lit(1)).alias("parts"), F.min("p_name").alias("named"))


def policy(spark, sf_dir):
    """The code policy: every second question (by size) has a text of its own
    and belongs to the evaluation split."""
    q = questions(spark, sf_dir)
    even = F.col("parts") % 2 == 0
    return q.select("var", F.lit(None).cast("array<double>").alias("invalid_codes"), F.lit(None).cast("array<double>").alias("refusal_codes"),
                    F.when(even, F.concat(F.lit("  About "), "named", F.lit("? "))).alias("question_text"),
                    F.when(even, "eval").otherwise("train").alias("split"))


@query("catalogue_options", _CODEBOOK_SQL + """
SELECT var, code, label, row_number() OVER (PARTITION BY var ORDER BY code) AS opt_idx,
       CAST(row_number() OVER (PARTITION BY var ORDER BY code) AS DOUBLE) AS ordinal
FROM codebook WHERE code NOT IN (3, 5)""")
def q_catalogue_options(spark, sf_dir):
    rp = C.resolve_policy(policy(spark, sf_dir), INVALID, REFUSED)
    o = C.build_options(codebook(spark, sf_dir), rp)
    return (o.select("var", F.posexplode(F.arrays_zip("codes", "options", "ordinal")).alias("i", "x"))
             .select("var", F.col("x.codes").alias("code"), F.col("x.options").alias("label"),
                     (F.col("i") + 1).cast("bigint").alias("opt_idx"), F.col("x.ordinal").alias("ordinal")))


@query("catalogue_text", _CODEBOOK_SQL + """
SELECT var, CASE WHEN parts % 2 = 0 THEN 'About ' || named || '?' ELSE var || '. On ' || named END AS question, 'On ' || named AS body
FROM q""")
def q_catalogue_text(spark, sf_dir):
    rp = C.resolve_policy(policy(spark, sf_dir), INVALID, REFUSED).select("var", "question_text")
    v = questions(spark, sf_dir).withColumn("label", F.concat("var", F.lit(". On "), "named")).join(rp, "var")
    return v.select("var", C.question_text("question_text", "label", "var").alias("question"),
                    C.question_body_after_dot("label").alias("body"))


@query("catalogue_split", _CODEBOOK_SQL + """
SELECT var, CASE WHEN parts % 2 = 0 THEN 'eval' ELSE 'train' END AS split, 'all' AS asked FROM q
UNION ALL SELECT var, 'eval', 'eval' FROM q WHERE parts % 2 = 0""")
def q_catalogue_split(spark, sf_dir):
    p = policy(spark, sf_dir)
    both = [C.questions_for_split(p, s).withColumn("asked", F.lit(s)) for s in ("all", "eval")]
    return both[0].unionByName(both[1])


@query("catalogue_labels", _CODEBOOK_SQL + """
SELECT c.var, CAST(c.pos AS INTEGER) AS pos, c.code, c.label, 'About ' || q.named AS var_label FROM codebook c JOIN q ON q.var = c.var""")
def q_catalogue_labels(spark, sf_dir):
    """S3: labels written into Stata files with the parts' rows, and read back."""
    root = IO.scratch(spark, "stata-catalogue")
    book = codebook(spark, sf_dir)
    labels: dict[str, dict[int, str]] = {}
    for r in book.collect():  # the codebook: metadata
        labels.setdefault(r["var"], {})[int(r["code"])] = r["label"]
    names = {r["var"]: f"About {r['named']}" for r in questions(spark, sf_dir).collect()}
    parts = table(spark, sf_dir, "part").join(book, (F.col("p_type") == F.col("var")) & (F.col("p_brand") == F.col("label")))
    wide = parts.select(F.col("p_size").alias("size"), F.col("p_partkey").alias("QKEY"),
                        *[F.when(F.col("var") == v, F.col("code")).alias(v) for v in sorted(labels)])
    IO.write_stata(wide, root, "size", labels, names).write.format("noop").mode("overwrite").save()
    return (IO.scan_codebook(spark, f"{root}/*/*.dta").where(F.col("var").isin(sorted(labels)))
              .select("var", "pos", "code", "label", "var_label").distinct())


@query("catalogue_config", """
SELECT r.r_name AS attribute, 'c_nationkey' AS "column", n.n_name AS grp, CAST(n.n_nationkey AS VARCHAR) AS code
FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey""")
def q_catalogue_config(spark, sf_dir):
    """Regions as attributes, nations as groups, written as JSON and read back."""
    path = IO.scratch(spark, "config-regions")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    j = n.join(r, n.n_regionkey == r.r_regionkey)
    subs = j.groupBy(F.col("r_name").alias("attribute"), F.lit("c_nationkey").alias("column")).agg(F.map_from_entries(F.collect_list(
        F.struct("n_name", F.array(F.col("n_nationkey").cast("string"))))).alias("value_map"))
    subs.agg(F.collect_list(F.struct("attribute", "column", "value_map")).alias("subpopulations")).coalesce(1).write.json(path)
    return IO.read_config_groups(spark, path)


@query("catalogue_steering", """
SELECT r.r_name AS attribute, 'Where in ' || r.r_name || '?' AS qa_prompt, n.n_name AS option,
       row_number() OVER (PARTITION BY r.r_name ORDER BY n.n_name) - 1 AS pos
FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey""")
def q_catalogue_steering(spark, sf_dir):
    """Steering records made of regions and nations, as a JSON array file."""
    path = IO.scratch(spark, "steering-regions")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rec = n.join(r, n.n_regionkey == r.r_regionkey).groupBy(F.col("r_name").alias("attribute")).agg(
        F.sort_array(F.collect_list("n_name")).alias("options"))
    rec = rec.withColumn("qa_prompt", F.concat(F.lit("Where in "), "attribute", F.lit("?")))
    rec.agg(F.to_json(F.collect_list(F.struct("attribute", "qa_prompt", "options"))).alias("value")).coalesce(1).write.text(path)
    back = IO.read_json_records(spark, path, "attribute string, qa_prompt string, options array<string>")
    return back.select("attribute", "qa_prompt", F.posexplode("options").alias("pos", "option")).withColumn("pos", F.col("pos").cast("bigint"))
