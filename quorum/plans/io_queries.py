"""Queries: scans and sinks round-tripped through files that Spark writes
from the driver tables (S1–S8, S10–S14, K1–K9)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from quorum.operators.joins import bounded_broadcast
from quorum.operators.sequences import sql_token_ids
from quorum.plans.oracle_views import with_views
from quorum.plans.registry import query
from quorum.sources import io as IO
from quorum.sources import views as V
from quorum.sources.driver import table


def _wave_tables(spark, sf_dir, root):
    r = V.responses(spark, sf_dir).select("human_id", "wave", "var", "code", "weight")
    wide = (r.groupBy("wave", F.col("human_id").alias("QKEY")).pivot("var", ["PRIORITY", "STATUS"])
             .agg(F.first("code").alias("code"), F.first("weight").alias("weight"))
             .select("wave", "QKEY", F.col("PRIORITY_code").alias("PRIORITY"), F.col("STATUS_code").alias("STATUS"),
                     F.col("PRIORITY_weight").alias("WEIGHT")))
    return IO.write_waves(wide, root)


@query("scan_waves", with_views("responses") + "SELECT human_id, qkey, code FROM responses")
def q_scan_waves(spark, sf_dir):
    root = IO.scratch(spark, "waves")
    waves = _wave_tables(spark, sf_dir, root)
    long = IO.scan_wave_answers(spark, root, waves)
    return long.select("human_id", "qkey", "code")


@query("scan_stata", with_views("responses") + """
SELECT human_id AS QKEY, max(CASE WHEN var = 'PRIORITY' THEN code END) AS PRIORITY,
       max(CASE WHEN var = 'STATUS' THEN code END) AS STATUS
FROM responses GROUP BY human_id""")
def q_scan_stata(spark, sf_dir):
    root = IO.scratch(spark, "stata")
    r = V.responses(spark, sf_dir)
    wide = (r.groupBy("wave", F.col("human_id").alias("QKEY")).pivot("var", ["PRIORITY", "STATUS"])
             .agg(F.first("code")))
    labels = {"PRIORITY": {int(c): l for v, _, c, l in V.CODEBOOK_ROWS if v == "PRIORITY"}}
    IO.write_stata(wide, root, "wave", labels, {"PRIORITY": "How urgent was your order?"}).write.format("noop").mode("overwrite").save()
    back = IO.scan_stata(spark, os.path.join(root, "*", "*.dta"),
                         "QKEY long, PRIORITY double, STATUS double, source_file string")
    return back.select("QKEY", "PRIORITY", "STATUS")


@query("scan_codebook", with_views("codebook", "variables") + """
SELECT c.var, CAST(row_number() OVER (PARTITION BY c.var ORDER BY c.code) AS INTEGER) AS pos, c.code, c.label,
       v.label AS var_label
FROM codebook c JOIN variables v ON v.var = c.var""")
def q_scan_codebook(spark, sf_dir):
    root = IO.scratch(spark, "stata-cb")
    r = V.responses(spark, sf_dir)
    wide = (r.groupBy("wave", F.col("human_id").alias("QKEY")).pivot("var", ["PRIORITY", "STATUS"])
             .agg(F.first("code")))
    labels = {v: {int(c): l for vv, _, c, l in V.CODEBOOK_ROWS if vv == v} for v in ("PRIORITY", "STATUS")}
    IO.write_stata(wide, root, "wave", labels, {v: t for v, t in V.VARIABLE_ROWS}).write.format("noop").mode("overwrite").save()
    # every wave file carries the same labels (Stata keeps them sorted by code): one row per label
    return (IO.scan_codebook(spark, os.path.join(root, "*", "*.dta"))
              .select("var", "pos", "code", "label", "var_label").distinct())


@query("scan_csv_enc", """
SELECT CAST(r.r_regionkey AS VARCHAR) AS r_regionkey, r.r_name,
       CASE r.r_name WHEN 'AFRICA' THEN '非洲' WHEN 'AMERICA' THEN '美洲' WHEN 'ASIA' THEN '亚洲'
                     WHEN 'EUROPE' THEN '欧洲' WHEN 'MIDDLE EAST' THEN '中东' END AS zh
FROM region r CROSS JOIN (SELECT unnest(['utf-8', 'utf-8-sig', 'gbk']) AS enc) e""")
def q_scan_csv_enc(spark, sf_dir):
    import pandas as pd
    root = IO.scratch(spark, "csv-enc")
    names = {"AFRICA": "非洲", "AMERICA": "美洲", "ASIA": "亚洲", "EUROPE": "欧洲", "MIDDLE EAST": "中东"}
    zh = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    reg = table(spark, sf_dir, "region").select("r_regionkey", "r_name", F.try_element_at(zh, F.col("r_name")).alias("zh"))
    encs = F.explode(F.array(*[F.lit(e) for e in ("utf-8", "utf-8-sig", "gbk")])).alias("enc")

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        enc = pdf["enc"].iloc[0]
        path = f"{root}/region_{enc}.csv"
        IO.write_file(path, pdf.drop(columns=["enc"]).to_csv(index=False).encode(enc))
        return pd.DataFrame({"enc": [enc], "path": [path]})

    reg.select("*", encs).groupBy("enc").applyInPandas(write, "enc string, path string").collect()
    return IO.read_csv_auto(spark, os.path.join(root, "*.csv")).select("r_regionkey", "r_name", "zh")


@query("csv_dropna", with_views("respondents") + """
SELECT human_id, wave, weight, segment FROM respondents WHERE weight IS NOT NULL""")
def q_csv_dropna(spark, sf_dir):
    path = IO.scratch(spark, "csv-dropna")
    V.respondents(spark, sf_dir).select("human_id", "wave", "weight", "segment") \
        .write.mode("overwrite").option("header", True).csv(path)
    d = IO.read_csv_dropna(spark, path, "human_id long, wave int, weight double, segment string")
    return d.select(F.col("human_id").cast("bigint"), F.col("wave").cast("int"), F.col("weight").cast("double"),
                    "segment")


def _present_codes(spark, sf_dir):
    """(attribute, code) pairs that occur in the respondents (from the given tables)."""
    r = V.respondents(spark, sf_dir)
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(c).cast("string").alias("code"))
                                for a, c in V.ATTRIBUTE_COLUMNS.items()]))
    return r.select(pairs.alias("p")).select("p.*").distinct()


def _steering_sql():
    from quorum.plans.prompt_queries import _sq
    vals = ", ".join(f"({_sq(a)}, {_sq(b)}, {_sq(q)}, {_sq(p)}, {len(o)})" for a, b, q, p, _, o in V.STEERING_ROWS)
    return f"""
SELECT attribute, bio AS bio_prompt, qa AS qa_prompt, portray AS portray_prompt, CAST(n AS INTEGER) AS n_options
FROM (VALUES {vals}) AS t(attribute, bio, qa, portray, n)"""


@query("scan_steering", _steering_sql())
def q_scan_steering(spark, sf_dir):
    """Steering records (options limited to groups present in the data)
    written as one JSON array file and read back (multi-line JSON)."""
    path = IO.scratch(spark, "steering")
    present = (V.group_codes(spark).join(_present_codes(spark, sf_dir), ["attribute", "code"], "left_semi")
                .select("attribute", F.col("grp").alias("option")).distinct())
    st = V.steering(spark)
    opts = (st.select("attribute", F.posexplode("options").alias("pos", "option"))
              .join(bounded_broadcast(present), ["attribute", "option"], "left_semi")
              .groupBy("attribute").agg(F.sort_array(F.collect_list(F.struct("pos", "option"))).alias("_o")))
    rec = st.drop("options").join(opts, "attribute").withColumn(
        "options", F.to_json(F.transform("_o", lambda x: x["option"]))).drop("_o")
    arr = rec.agg(F.to_json(F.collect_list(F.struct(*[c for c in rec.columns]))).alias("value"))  # a few rows
    arr.coalesce(1).write.mode("overwrite").text(path)
    back = IO.read_json_records(spark, path)
    return back.select("attribute", "bio_prompt", "qa_prompt", "portray_prompt",
                       F.size(F.from_json("options", "array<string>")).alias("n_options"))


def _qdict_sql():
    from quorum.plans.distribution_queries import TEXT_SQL
    body = TEXT_SQL[:TEXT_SQL.rindex("SELECT DISTINCT")]
    return body.rstrip() + """,
ol AS (SELECT var, string_agg(label, '|' ORDER BY opt_idx) AS option_list, count(*) AS n_ordinal FROM opts GROUP BY var)
SELECT DISTINCT d.qkey, qt.question AS refined_qbody, ol.option_list, ol.n_ordinal
FROM dist d JOIN qt ON qt.var = split_part(d.qkey, '_W', 1) JOIN ol ON ol.var = split_part(d.qkey, '_W', 1)"""


@query("scan_qdict", _qdict_sql())
def q_scan_qdict(spark, sf_dir):
    from quorum.plans.distribution_queries import cgss_distribution
    path = IO.scratch(spark, "qdict")
    d = cgss_distribution(spark, sf_dir).select("qkey", "question", "options", "ordinal").dropDuplicates(["qkey"])
    entry = F.struct(F.col("question").alias("refined_qbody"), F.col("options").alias("option_list"),
                     F.col("ordinal").alias("ordinal"))
    one = d.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("qkey", entry)))).alias("value"))  # questions
    one.coalesce(1).write.mode("overwrite").text(path)
    back = IO.read_json_dict(spark, path, "struct<refined_qbody:string,option_list:array<string>,ordinal:array<double>>")
    return back.select(F.col("key").alias("qkey"), F.col("value.refined_qbody").alias("refined_qbody"),
                       F.array_join("value.option_list", "|").alias("option_list"),
                       F.size("value.ordinal").cast("bigint").alias("n_ordinal"))


@query("scan_config", with_views("respondents", "group_codes") + """
SELECT g.attribute, CASE g.attribute WHEN 'SEGMENT' THEN 'segment' WHEN 'REGION' THEN 'region'
                    ELSE 'balance_code' END AS "column", g.grp, g.code
FROM group_codes g
WHERE (g.attribute = 'SEGMENT' AND g.code IN (SELECT segment FROM respondents))
   OR (g.attribute = 'REGION' AND g.code IN (SELECT region FROM respondents))
   OR (g.attribute = 'BALANCE' AND g.code IN (SELECT CAST(balance_code AS VARCHAR) FROM respondents))""")
def q_scan_config(spark, sf_dir):
    """Nested sub-population config (value_map group -> codes, only codes
    seen in the data) written as JSON and exploded back to the long table."""
    path = IO.scratch(spark, "config")
    gc = V.group_codes(spark).join(_present_codes(spark, sf_dir), ["attribute", "code"], "left_semi")
    col = F.create_map(*[F.lit(x) for kv in V.ATTRIBUTE_COLUMNS.items() for x in kv])
    vm = gc.groupBy("attribute", "grp").agg(F.sort_array(F.collect_list("code")).alias("codes"))
    subs = vm.groupBy("attribute").agg(F.map_from_entries(F.collect_list(F.struct("grp", "codes"))).alias("value_map"))
    cfg = subs.agg(F.collect_list(F.struct("attribute", F.try_element_at(col, F.col("attribute")).alias("column"),
                                           "value_map")).alias("subpopulations")) \
              .select("subpopulations", F.array(*[F.lit(x) for x in V.GLOBAL_INVALID]).alias("global_invalid_codes"),
                      F.array(*[F.lit(x) for x in V.GLOBAL_REFUSAL]).alias("global_refusal_codes"))
    cfg.coalesce(1).write.mode("overwrite").json(path)
    return IO.read_config_groups(spark, path)


def _prompts(spark, sf_dir):
    from quorum.plans.prompt_queries import prompt_table
    return prompt_table(spark, sf_dir, n_tokens=0)


def _pr_sql(select):
    from quorum.plans.distribution_queries import _DIST_VIEWS
    from quorum.plans.prompt_queries import _PROMPT_CTES
    return with_views(*_DIST_VIEWS, ctes=_PROMPT_CTES) + select


@query("scan_prompts", _pr_sql("SELECT qkey, attribute, grp, steering_type, split, input_prompt FROM pr"))
def q_scan_prompts(spark, sf_dir):
    path = IO.scratch(spark, "prompts-csv")
    IO.write_prompts_csv(_prompts(spark, sf_dir), path)
    back = IO.read_prompts_csv(spark, path)
    return back.select("qkey", "attribute", "grp", "steering_type", "split", "input_prompt")


@query("select_split", _pr_sql("""
SELECT qkey, attribute, grp FROM pr WHERE steering_type = 'qa' AND split = 'train'"""))
def q_select_split(spark, sf_dir):
    path = IO.scratch(spark, "prompts-parts")
    IO.write_prompt_sets(_prompts(spark, sf_dir), path, "survey")
    # the sets that the runs ask for: the QA prompts of the train split, of every attribute and group
    wanted = IO.kept(spark.read.parquet(path).select(*IO.PROMPT_SET).distinct().where((F.col("steering_type") == "qa") & (F.col("split") == "train")), "work")
    return IO.select_sets(spark.read.parquet(path), wanted, IO.PROMPT_SET).select("qkey", "attribute", "grp")


@query("write_prompts", _pr_sql("SELECT qkey, attribute, grp, steering_type, split, input_prompt FROM pr"))
def q_write_prompts(spark, sf_dir):
    """K2: one partitioned write for every (data set, attribute, group, steering type, split)."""
    path = IO.scratch(spark, "prompts-k2")
    IO.write_prompt_sets(_prompts(spark, sf_dir), path, "survey")
    return spark.read.parquet(path).select("qkey", "attribute", "grp", "steering_type", "split", "input_prompt")


@query("empty_split", _pr_sql("SELECT qkey, attribute, grp, steering_type, split, input_prompt FROM pr WHERE split = 'none'"))
def q_empty_split(spark, sf_dir):
    """K3: a split with no rows keeps its schema on write and read-back."""
    path = IO.scratch(spark, "prompts-empty")
    empty = _prompts(spark, sf_dir).where(F.col("split") == "none")
    empty.write.mode("overwrite").parquet(path)
    back = spark.read.parquet(path)
    if back.columns != empty.columns:
        raise AssertionError("schema lost")
    return back.select("qkey", "attribute", "grp", "steering_type", "split", "input_prompt")


@query("scan_cached", _pr_sql("SELECT qkey, attribute, grp, steering_type, array_to_string(" + sql_token_ids("input_prompt") + ", ' ') AS ids FROM pr"))
def q_scan_cached(spark, sf_dir):
    """Token records cached by (input, tokenizer); second call reads the cache."""
    from quorum.operators.sequences import whitespace_ids
    root = IO.scratch(spark, "cache")

    def build():
        return _prompts(spark, sf_dir).select("qkey", "attribute", "grp", "steering_type",
                                              whitespace_ids("input_prompt").alias("input_ids"))
    IO.cached(spark, root, "prompts_train.csv", "whitespace/v1", build)
    back = IO.cached(spark, root, "prompts_train.csv", "whitespace/v1", build)  # served from the cache
    return back.select("qkey", "attribute", "grp", "steering_type", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("ids"))


def _eval_sql(select):
    from quorum.plans.compare_queries import EVAL_SQL
    return EVAL_SQL + select


@query("scan_eval", _eval_sql(
    "SELECT row_idx, round(kl_ft, 9) AS kl, round(wd_ft, 9) AS wd, round(loss_ft, 9) AS loss_used FROM paired"))
def q_scan_eval(spark, sf_dir):
    from quorum.plans.compare_queries import eval_rows
    path = IO.scratch(spark, "eval-csv")
    eval_rows(spark, sf_dir, 0.5).select("row_idx", "kl", "wd", F.col("loss").alias("loss_used")) \
        .write.mode("overwrite").option("header", True).csv(path)
    e = IO.read_eval_csv(spark, path, schema="row_idx long, kl double, wd double, loss_used double")
    return e.select(F.col("row_idx").cast("bigint"), *[F.round(c, 9).alias(c) for c in ("kl", "wd", "loss_used")])


@query("scan_train_metrics", """
WITH s AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
                  value / 100 AS loss FROM events),
p AS (SELECT run, (step - 1) // 1000 AS part, (step - 1) % 1000 AS idx, loss FROM s),
k AS (SELECT unnest(['train_step_loss', 'train_epoch_loss', 'train_step_perplexity', 'train_epoch_perplexity',
                     'val_step_loss', 'val_epoch_loss', 'val_step_perplexity', 'val_epoch_perplexity']) AS series)
SELECT CAST(p.run AS BIGINT) AS run, CAST(p.part AS BIGINT) AS part, k.series, CAST(p.idx AS INTEGER) AS idx,
       round(CASE WHEN k.series LIKE '%loss' THEN p.loss ELSE exp(p.loss) END, 9) AS value
FROM p CROSS JOIN k""")
def q_scan_train_metrics(spark, sf_dir):
    """Metric rows built from the events series (run = user), many runs in
    a file of bounded size, plus one malformed line that is reported, not fatal."""
    from quorum.plans.compare_queries import metric_series
    root = IO.scratch(spark, "train-metrics")
    s = metric_series(spark, sf_dir)
    # a row per (run, block of 1000 steps): the block bounds the arrays in a row
    s = s.withColumn("part", F.floor((F.col("step") - 1) / 1000))
    per = s.groupBy("run", "part").agg(F.sort_array(F.collect_list(F.struct("step", "loss"))).alias("_s"))
    loss = F.transform("_s", lambda x: x["loss"])
    cols = {k: (loss if "loss" in k else F.transform(loss, lambda v: F.exp(v))) for k in IO.TRAIN_METRIC_KEYS}
    per.select("run", "part", *[c.alias(k) for k, c in cols.items()]).write.option("maxRecordsPerFile", 10_000).json(root)
    spark.createDataFrame([("{not json",)], "value string").coalesce(1).write.mode("append").text(root)
    m, bad = IO.read_train_metric_rows(spark, root)
    if bad.count() != 1:
        raise AssertionError("the malformed line is not reported")
    return m.select("run", "part", "series", "idx", F.round("value", 9).alias("value"))


def _dist_sql():
    from quorum.plans.distribution_queries import DIST_SQL
    return DIST_SQL


@query("write_dist", _dist_sql())
def q_write_dist(spark, sf_dir):
    """K1: Parquet write of the distribution (arrays kept), read back and
    compared in long form."""
    from quorum.operators.distribution import explode_distribution
    from quorum.plans.distribution_queries import cgss_distribution, r9
    path = IO.publish_path(spark, IO.scratch(spark, "dist"))
    back = IO.write_distribution(cgss_distribution(spark, sf_dir), path)
    d = explode_distribution(back)
    return d.select("qkey", "attribute", "grp", F.col("opt_idx").cast("bigint").alias("opt_idx"),
                    "option", r9("p").alias("p"), r9("refusal_rate").alias("refusal_rate"), "ordinal")


def _qdict_kind_sql():
    from quorum.plans.distribution_queries import TEXT_SQL
    body = TEXT_SQL[:TEXT_SQL.rindex("SELECT DISTINCT")]
    return body + """SELECT DISTINCT d.qkey, CASE WHEN trim(qt.question) = '' THEN 'error' ELSE 'refined' END AS kind
FROM dist d JOIN qt ON qt.var = split_part(d.qkey, '_W', 1)"""


@query("write_qdict", _qdict_kind_sql())
def q_write_qdict(spark, sf_dir):
    """K4: refined questions written as JSON rows, failed refinements (X5
    error rows) to their own table; returns both read back with a kind."""
    from quorum.operators.scoring import refine_batch
    from quorum.plans.distribution_queries import cgss_distribution
    from quorum.plans.hook_queries import demo_refiner
    root = IO.scratch(spark, "qdict-rows")
    d = cgss_distribution(spark, sf_dir).select("qkey", "question", "options", "ordinal").dropDuplicates(["qkey"])
    r = refine_batch(d, "qkey", "question", demo_refiner, max_retries=1, base_delay=0.001)
    ok = (r.where(F.col("error").isNull()).join(d, "qkey")
           .select("qkey", F.col("refined").alias("refined_qbody"), F.col("options").alias("option_list"), "ordinal"))
    IO.write_json_rows(ok, os.path.join(root, "refined"))
    IO.write_json_rows(r.where(F.col("error").isNotNull()).select("qkey", "error"), os.path.join(root, "errors"))
    good = spark.read.json(os.path.join(root, "refined")).select("qkey", F.lit("refined").alias("kind"))
    bad = spark.read.schema("qkey string, error string").json(os.path.join(root, "errors")) \
        .select("qkey", F.lit("error").alias("kind"))
    return good.unionByName(bad)


@query("publish", with_views("respondents") + "SELECT CAST(wave AS VARCHAR) AS wave, CAST(count(*) AS VARCHAR) AS n, '_<14 digits>.csv' AS published_as FROM respondents GROUP BY wave")
def q_publish(spark, sf_dir):
    """K5/K6: the second publish to the same name gets a time-stamp suffix."""
    base = IO.scratch(spark, "publish") + ".csv"
    rows = V.respondents(spark, sf_dir).groupBy("wave").agg(F.count(F.lit(1)).alias("n"))
    first = IO.publish_path(spark, base)
    rows.write.mode("overwrite").option("header", True).csv(first)
    second = IO.publish_path(spark, base)
    rows.write.mode("overwrite").option("header", True).csv(second)
    if second == first:
        raise AssertionError("second publish did not get a time-stamp suffix")
    suffix = F.regexp_replace(F.replace(F.lit(second), F.lit(base[:-len(".csv")]), F.lit("")), r"\d{14}", "<14 digits>")
    return spark.read.option("header", True).csv(second).withColumn("published_as", suffix)


_INPUTS = ["prompts_bio_test", "prompts_portray_test", "prompts_qa_test"]


@query("write_scored", _eval_sql(f"""
SELECT i.input, m.model, row_idx,
       round(CASE WHEN i.input = '{_INPUTS[0]}' AND m.model = 'ft-7B' THEN kl_baseline ELSE kl_ft END, 9) AS kl,
       round(CASE WHEN i.input = '{_INPUTS[0]}' AND m.model = 'ft-7B' THEN wd_baseline ELSE wd_ft END, 9) AS wd
FROM paired CROSS JOIN (SELECT unnest({_INPUTS}) AS input) i CROSS JOIN (SELECT unnest(['base-0.5B', 'ft-7B']) AS model) m"""))
def q_write_scored(spark, sf_dir):
    """K8: scored rows of every (input, model) of the run grid, then one pair
    scored again, which replaces that pair alone."""
    from quorum.operators.compare import run_grid
    from quorum.plans.compare_queries import MODELS, eval_rows
    path = IO.scratch(spark, "scored")
    grid = run_grid(spark.createDataFrame([(i,) for i in _INPUTS], "input string"), MODELS)
    runs = grid.select("input", F.substring_index("model", "/", -1).alias("model"))
    every = F.explode(F.array(*[F.struct(F.lit(r.input).alias("input"), F.lit(r.model).alias("model")) for r in runs.collect()]))  # the grid's names
    IO.replace_sets(eval_rows(spark, sf_dir, 0.5).withColumn("run", every).select("*", "run.*").drop("run"), path, ["input", "model"])
    again = eval_rows(spark, sf_dir, 0.0).withColumns({"input": F.lit(_INPUTS[0]), "model": F.lit("ft-7B")})
    IO.replace_sets(again, path, ["input", "model"])
    return spark.read.parquet(path).select("input", "model", "row_idx", F.round("kl", 9).alias("kl"), F.round("wd", 9).alias("wd"))


@query("write_metrics", _eval_sql("SELECT row_idx, " + ", ".join(
    f"round({c}, 9) AS {c}" for c in ("kl_baseline", "kl_ft", "wd_baseline", "wd_ft", "loss_baseline", "loss_ft",
                                      "kl_delta_base_minus_ft", "wd_delta_base_minus_ft",
                                      "loss_delta_base_minus_ft")) + " FROM paired"))
def q_write_metrics(spark, sf_dir):
    """K9: paired metric table written as CSV and read back."""
    from quorum.plans.compare_queries import _paired
    path = IO.scratch(spark, "paired")
    _paired(spark, sf_dir).write.mode("overwrite").option("header", True).csv(path)
    e = IO.read_eval_csv(spark, path, required=("kl_baseline", "kl_ft", "wd_baseline", "wd_ft"))
    return e.select(F.col("row_idx").cast("bigint"), *[F.round(c, 9).alias(c) for c in e.columns if c != "row_idx"])
