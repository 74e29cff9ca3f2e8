"""Queries: paired runs, summaries, batch means, run matrix, histograms,
bounds join, dedupe, run grid, top-k options, sampling, metric series
(J9, J10, J14, A12–A18, F33, F34, T5, T6, T8, W8, W9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorum.functions import metrics as M
from quorum.operators import compare as CP
from quorum.operators import distribution as D
from quorum.plans.distribution_queries import _DIST_CTES, _DIST_VIEWS, cgss_distribution, emd_vs_overall, r9
from quorum.plans.metrics_queries import register_bounds, scored
from quorum.plans.oracle_views import with_views
from quorum.plans.registry import query
from quorum.sources import io as IO
from quorum.sources.driver import table

# Fixed parameters: mixing weight of the gold distribution per (model, prompt, run).
RUN_WEIGHTS = [
    ("0.5B", "QA", "baseline", 0.0), ("0.5B", "QA", "ft", 0.3),
    ("0.5B", "BIO", "baseline", 0.1), ("0.5B", "BIO", "ft", 0.4),
    ("0.5B", "PORTRAY", "baseline", 0.05), ("0.5B", "PORTRAY", "ft", 0.35),
    ("7B", "QA", "baseline", 0.2), ("7B", "QA", "ft", 0.5),
    ("7B", "BIO", "baseline", 0.25), ("7B", "BIO", "ft", 0.55),
    ("7B", "PORTRAY", "baseline", 0.3), ("7B", "PORTRAY", "ft", 0.6),
]
FT_WEIGHT = 0.5
MODELS = ["org/base-0.5B", "org/ft-7B"]


def _mix(w):
    return F.zip_with("gold", "q", lambda g, q: g * w + q * (1 - w))


def eval_rows(spark, sf_dir, w):
    s = scored(spark, sf_dir)
    q = _mix(w)
    return s.select("row_idx", M.kl("gold", q).alias("kl"), M.emd_zero("gold", q, "ordinal").alias("wd")) \
            .withColumn("loss", F.col("kl"))


def _emd_ctes(src: str, qcol: str, pre: str) -> str:
    return f"""
{pre}_f AS (SELECT row_idx, o, p / sum(p) OVER (PARTITION BY row_idx) AS pn,
                {qcol} / sum({qcol}) OVER (PARTITION BY row_idx) AS qn FROM {src} WHERE o >= 0),
{pre}_c AS (SELECT row_idx, o, sum(pn) OVER (PARTITION BY row_idx ORDER BY o ROWS UNBOUNDED PRECEDING) AS cp,
                sum(qn) OVER (PARTITION BY row_idx ORDER BY o ROWS UNBOUNDED PRECEDING) AS cq,
                lead(o) OVER (PARTITION BY row_idx ORDER BY o) AS nxt FROM {pre}_f),
{pre}_e AS (SELECT row_idx, sum(CASE WHEN nxt IS NULL THEN 0 ELSE abs(cp - cq) * (nxt - o) END) / (max(o) - min(o)) AS emd
            FROM {pre}_c GROUP BY row_idx)"""


register_bounds()

_EVAL_CTES = f"""
ev AS (SELECT row_idx, j, o, p, q AS qb, {FT_WEIGHT} * p + {1 - FT_WEIGHT} * q AS qf FROM lg_long),
klt AS (SELECT row_idx, sum(p * (ln(p + 1e-8) - ln(qb + 1e-8))) AS kl_b,
               sum(p * (ln(p + 1e-8) - ln(qf + 1e-8))) AS kl_f FROM ev GROUP BY row_idx),""" + \
    _emd_ctes("ev", "qb", "eb") + "," + _emd_ctes("ev", "qf", "ef") + """,
paired AS (SELECT k.row_idx, k.kl_b AS kl_baseline, k.kl_f AS kl_ft, b.emd AS wd_baseline, f.emd AS wd_ft,
                  k.kl_b AS loss_baseline, k.kl_f AS loss_ft,
                  k.kl_b - k.kl_f AS kl_delta_base_minus_ft, b.emd - f.emd AS wd_delta_base_minus_ft,
                  k.kl_b - k.kl_f AS loss_delta_base_minus_ft
           FROM klt k JOIN eb_e b ON b.row_idx = k.row_idx JOIN ef_e f ON f.row_idx = k.row_idx)"""

EVAL_SQL = with_views("lg_long", ctes=_EVAL_CTES)
_PAIRED_COLS = ["kl_baseline", "kl_ft", "wd_baseline", "wd_ft", "loss_baseline", "loss_ft",
                "kl_delta_base_minus_ft", "wd_delta_base_minus_ft", "loss_delta_base_minus_ft"]


def _paired(spark, sf_dir):
    return CP.paired_join(eval_rows(spark, sf_dir, 0.0), eval_rows(spark, sf_dir, FT_WEIGHT))


@query("paired_join", EVAL_SQL + "SELECT row_idx, " +
       ", ".join(f"round({c}, 9) AS {c}" for c in _PAIRED_COLS) + " FROM paired")
def q_paired_join(spark, sf_dir):
    return _paired(spark, sf_dir).select("row_idx", *[r9(c).alias(c) for c in _PAIRED_COLS])


@query("paired_files", EVAL_SQL + "SELECT row_number() OVER (ORDER BY row_idx) - 1 AS row_idx, " +
       ", ".join(f"round({c}, 9) AS {c}" for c in _PAIRED_COLS) + " FROM paired")
def q_paired_files(spark, sf_dir):
    """Metric files without an index, paired by their rows' places."""
    paths = []
    for name, w in (("base", 0.0), ("ft", FT_WEIGHT)):
        paths.append(IO.scratch(spark, name))
        eval_rows(spark, sf_dir, w).orderBy("row_idx").drop("row_idx").write.option("header", True).csv(paths[-1])
    p = IO.read_paired_eval_csv(spark, *paths, CP.METRICS, "kl double, wd double, loss double")
    return p.select("row_idx", *[r9(c).alias(c) for c in _PAIRED_COLS])


_SUM_SQL = EVAL_SQL + "SELECT count(*) AS rows, " + ", ".join(
    f"round(avg({m}_baseline), 9) AS {m}_baseline_mean, round(avg({m}_ft), 9) AS {m}_ft_mean, "
    f"round(avg({m}_delta_base_minus_ft), 9) AS {m}_delta_mean, "
    f"round(avg(CASE WHEN {m}_delta_base_minus_ft > 0 THEN 1.0 ELSE 0.0 END) * 100, 9) AS {m}_improved_pct"
    for m in ("kl", "wd", "loss")) + " FROM paired"


@query("paired_summary", _SUM_SQL)
def q_paired_summary(spark, sf_dir):
    s = CP.paired_summary(_paired(spark, sf_dir))
    return s.select("rows", *[r9(c).alias(c) for c in s.columns if c != "rows"])


@query("eval_batch_mean", EVAL_SQL + """
SELECT count(*) AS batches, round(avg(kl_b), 9) AS mean_loss, round(avg(kl_b), 9) AS mean_kl, round(avg(wd_b), 9) AS mean_wd
FROM (SELECT row_idx // 4 AS b, avg(kl_ft) AS kl_b,
             coalesce(avg(CASE WHEN wd_ft <> 0 THEN wd_ft END), avg(wd_ft)) AS wd_b FROM paired GROUP BY 1)""")
def q_eval_batch_mean(spark, sf_dir):
    m = CP.eval_batch_mean(eval_rows(spark, sf_dir, FT_WEIGHT), 4)
    return m.select("batches", *[r9(c).alias(c) for c in ("mean_loss", "mean_kl", "mean_wd")])


_RW = ", ".join(f"('{m}', '{p}', '{r}', {w})" for m, p, r, w in RUN_WEIGHTS)
RUN_SQL = with_views("lg_long", ctes=f"""
rw AS (SELECT * FROM (VALUES {_RW}) AS t(model, prompt, run, w)),
mx AS (SELECT rw.model || '|' || rw.prompt || '|' || rw.run || '|' || CAST(l.row_idx AS VARCHAR) AS row_idx,
              rw.model, rw.prompt, rw.run, l.j, l.o, l.p, rw.w * l.p + (1 - rw.w) * l.q AS qm
       FROM lg_long l CROSS JOIN rw),
kl AS (SELECT row_idx, any_value(model) AS model, any_value(prompt) AS prompt, any_value(run) AS run,
              sum(p * (ln(p + 1e-8) - ln(qm + 1e-8))) AS kl FROM mx GROUP BY row_idx),""" + _emd_ctes("mx", "qm", "rm") + """,
met AS (SELECT k.model, k.prompt, k.run, k.kl, e.emd AS wd FROM kl k JOIN rm_e e ON e.row_idx = k.row_idx),
agg AS (SELECT model, prompt, avg(kl) FILTER (WHERE run = 'baseline') AS baseline_kl,
               avg(wd) FILTER (WHERE run = 'baseline') AS baseline_wd, avg(kl) FILTER (WHERE run = 'ft') AS ft_kl,
               avg(wd) FILTER (WHERE run = 'ft') AS ft_wd FROM met GROUP BY model, prompt)""") + """
SELECT model, prompt, round(baseline_kl, 9) AS baseline_kl, round(baseline_wd, 9) AS baseline_wd,
       round(ft_kl, 9) AS ft_kl, round(ft_wd, 9) AS ft_wd,
       round(ft_kl - baseline_kl, 9) AS delta_kl_ft_minus_baseline, round(ft_wd - baseline_wd, 9) AS delta_wd_ft_minus_baseline
FROM agg"""


@query("run_matrix", RUN_SQL)
def q_run_matrix(spark, sf_dir):
    s = scored(spark, sf_dir)
    runs = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(p).alias("prompt"), F.lit(r).alias("run"),
                                        F.lit(w).alias("w")) for m, p, r, w in RUN_WEIGHTS])).alias("r")
    x = s.select("row_idx", "gold", "q", "ordinal", runs).select("row_idx", "gold", "q", "ordinal", "r.*")
    qm = F.zip_with("gold", "q", lambda g, q: F.col("w") * g + (1 - F.col("w")) * q)
    met = x.select("model", "prompt", "run", M.kl("gold", qm).alias("kl"), M.emd_zero("gold", qm, "ordinal").alias("wd"))
    out = CP.run_matrix(met)
    return out.select("model", "prompt", *[r9(c).alias(c) for c in out.columns if c not in ("model", "prompt")])


@query("hist40", EVAL_SQL + """,
series AS (SELECT 'kl_baseline' AS series, round(kl_baseline, 9) AS x FROM paired
           UNION ALL SELECT 'wd_baseline', round(wd_baseline, 9) FROM paired
           UNION ALL SELECT 'kl_ft', round(kl_ft, 9) FROM paired
           UNION ALL SELECT 'wd_ft', round(wd_ft, 9) FROM paired
           UNION ALL SELECT 'kl_delta_base_minus_ft', round(kl_delta_base_minus_ft, 9) FROM paired),
mm AS (SELECT series, min(x) AS mn, max(x) AS mx FROM series GROUP BY series)
SELECT s.series, CAST(CASE WHEN mm.mx = mm.mn THEN 0 ELSE least(floor((s.x - mm.mn) / (mm.mx - mm.mn) * 40), 39) END AS INTEGER) AS bin,
       count(*) AS n
FROM series s JOIN mm ON mm.series = s.series GROUP BY 1, 2""")
def q_hist40(spark, sf_dir):
    p = _paired(spark, sf_dir)
    cols = ["kl_baseline", "wd_baseline", "kl_ft", "wd_ft", "kl_delta_base_minus_ft"]
    return CP.hist_bins(p.select(*[r9(c).alias(c) for c in cols]), cols)


# ---- J14 (+A17): per-group EMD joined with its uniform upper bound
_BOUNDS_CTES = _DIST_CTES + """
bsrc AS (SELECT qkey || '|' || attribute || '|' || grp AS row_idx, ordinal AS o,
                1.0 / count(*) OVER (PARTITION BY qkey, attribute, grp) AS p, p AS qq FROM dist),""" + \
    _emd_ctes("bsrc", "qq", "bd") + """,
cum AS (SELECT qkey, attribute, grp, opt_idx, ordinal,
               sum(p) OVER (PARTITION BY qkey, attribute, grp ORDER BY opt_idx ROWS UNBOUNDED PRECEDING) AS cp,
               lead(ordinal) OVER (PARTITION BY qkey, attribute, grp ORDER BY opt_idx) AS next_o FROM dist),
emdt AS (SELECT g.qkey, g.attribute, g.grp,
                sum(CASE WHEN g.next_o IS NULL THEN 0 ELSE abs(g.cp - o.cp) * (g.next_o - g.ordinal) END)
                / (max(g.ordinal) - min(g.ordinal)) AS emd
         FROM cum g JOIN cum o ON o.qkey = g.qkey AND o.attribute = 'Overall' AND o.opt_idx = g.opt_idx
         GROUP BY g.qkey, g.attribute, g.grp)"""


@query("eval_bounds_join", with_views(*_DIST_VIEWS, ctes=_BOUNDS_CTES) + """
SELECT e.qkey, e.attribute, e.grp, round(e.emd, 9) AS emd, round(b.emd, 9) AS wd_upper
FROM emdt e JOIN bd_e b ON b.row_idx = e.qkey || '|' || e.attribute || '|' || e.grp""")
def q_eval_bounds_join(spark, sf_dir):
    d = IO.kept(cgss_distribution(spark, sf_dir), "dist")  # small; used by both sides of the join
    bounds = d.select("qkey", "attribute", "grp",
                      M.emd(M.uniform_over_valid("ordinal"), "responses", "ordinal").alias("wd_upper"))
    bounds = CP.dedupe_first(bounds, ["qkey", "attribute", "grp"], ["qkey"])
    e = emd_vs_overall(d).join(bounds, ["qkey", "attribute", "grp"])
    return e.select("qkey", "attribute", "grp", r9("emd").alias("emd"), r9("wd_upper").alias("wd_upper"))


# ---- A17
@query("dedupe_first", with_views(*_DIST_VIEWS, ctes=_DIST_CTES.rstrip().rstrip(",")) + """
SELECT qkey, attribute, grp, opt_idx, option FROM (
  SELECT *, row_number() OVER (PARTITION BY qkey, attribute ORDER BY grp, opt_idx) AS rn FROM dist) WHERE rn = 1""")
def q_dedupe_first(spark, sf_dir):
    d = D.explode_distribution(cgss_distribution(spark, sf_dir))
    f = CP.dedupe_first(d, ["qkey", "attribute"], ["grp", "opt_idx"])
    return f.select("qkey", "attribute", "grp", F.col("opt_idx").cast("bigint").alias("opt_idx"), "option")


@query("dedupe_last", """
SELECT user_id, event_type, event_id, round(value, 9) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def q_dedupe_last(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return CP.dedupe_last(ev, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", r9("value").alias("value"))


# ---- J10
@query("run_grid", """
WITH i AS (SELECT DISTINCT 'prompts_' || lang AS input FROM documents),
m AS (SELECT unnest(['org/base-0.5B', 'org/ft-7B']) AS model)
SELECT i.input, m.model, i.input || '_' || split_part(m.model, '/', -1) AS out_name FROM i CROSS JOIN m""")
def q_run_grid(spark, sf_dir):
    inputs = table(spark, sf_dir, "documents").select(F.concat(F.lit("prompts_"), "lang").alias("input")).distinct()
    return CP.run_grid(inputs, MODELS)


# ---- T5
@query("topk_options", with_views("lg_q") + """
SELECT row_idx, rank, chr(64 + CAST(j AS INTEGER)) AS letter, round(q, 9) AS p FROM (
  SELECT row_idx, j, q, row_number() OVER (PARTITION BY row_idx ORDER BY q DESC, j) AS rank FROM lg_q) WHERE rank <= 3""")
def q_topk_options(spark, sf_dir):
    s = scored(spark, sf_dir)
    t = s.select("row_idx", F.posexplode(CP.topk_options(F.col("q"), 3)).alias("r", "x"))
    return t.select("row_idx", (F.col("r") + 1).alias("rank"), F.col("x.letter").alias("letter"),
                    r9("x.p").alias("p"))


# ---- T6 / T8
@query("sample_n", """
SELECT doc_id FROM documents ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 5""")
def q_sample_n(spark, sf_dir):
    return CP.sample_n(table(spark, sf_dir, "documents").select("doc_id"), 5, "doc_id")


@query("max_rows", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100")
def q_max_rows(spark, sf_dir):
    # the first n rows in key order: a top-k (per-partition heaps, one merge), no full sort
    return table(spark, sf_dir, "documents").select("doc_id").orderBy("doc_id").limit(100)


# ---- W8 / W9 / A15 on the events series (run = user, step = order by time)
def metric_events(spark, sf_dir):
    """(run, ts, event_id, loss, epoch): the series without step numbers."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), "ts", "event_id", (F.col("value") / 100).alias("loss"),
        F.date_format("ts", "yyyy-MM-dd").alias("epoch"))


def metric_series(spark, sf_dir):
    """(run, step, loss, epoch): steps are numbered by blocks, so a run that
    holds much of the table is split over tasks."""
    from quorum.operators.sequences import global_row_index
    ev = metric_events(spark, sf_dir)
    return (global_row_index(ev, ["ts", "event_id"], ["run"], name="_i")
            .select("run", (F.col("_i") + 1).cast("int").alias("step"), "loss", "epoch"))


_SERIES = """
WITH s AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
                  value / 100 AS loss, strftime(ts, '%Y-%m-%d') AS epoch FROM events)"""


@query("best_epoch", _SERIES + """
SELECT run, step, round(loss, 9) AS loss, round(best_before, 9) AS best_before,
       best_before IS NULL OR loss < best_before AS is_best
FROM (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
              AS best_before FROM s)""")
def q_best_epoch(spark, sf_dir):
    b = CP.running_best(metric_series(spark, sf_dir))
    return b.select("run", "step", r9("loss").alias("loss"), r9("best_before").alias("best_before"), "is_best")


@query("step_cap", _SERIES + " SELECT run, step, round(loss, 9) AS loss FROM s WHERE step <= 20")
def q_step_cap(spark, sf_dir):
    return CP.step_cap(metric_series(spark, sf_dir), 20).select("run", "step", r9("loss").alias("loss"))


@query("epoch_metrics", _SERIES + """
SELECT run, epoch, round(avg(loss), 9) AS loss, round(exp(avg(loss)), 9) AS perplexity, count(*) AS steps
FROM s GROUP BY run, epoch""")
def q_epoch_metrics(spark, sf_dir):
    s = metric_events(spark, sf_dir)
    e = CP.epoch_means(s)
    return e.select("run", "epoch", r9("loss").alias("loss"), r9("perplexity").alias("perplexity"), "steps")


@query("epoch_eval", _SERIES.replace("strftime(ts, '%Y-%m-%d') AS epoch", "strftime(ts, '%Y-%m-%d') AS epoch, event_id % 7 AS kl, event_id % 3 AS wd") + """,
ep AS (SELECT run, epoch, avg(loss) AS loss, exp(avg(loss)) AS perplexity, avg(kl) AS kl, avg(CASE WHEN wd <> 0 THEN wd END) AS wd
       FROM s GROUP BY run, epoch)
SELECT run, count(*) AS epochs, round(avg(loss), 9) AS avg_loss, round(avg(perplexity), 9) AS avg_perplexity,
       round(avg(kl), 9) AS avg_kl, round(avg(wd), 9) AS avg_wd, round(min(loss), 9) AS best_loss FROM ep GROUP BY run""")
def q_epoch_eval(spark, sf_dir):
    s = metric_events(spark, sf_dir).withColumns({"kl": (F.col("event_id") % 7).cast("double"), "wd": (F.col("event_id") % 3).cast("double")})
    out = CP.run_averages(CP.epoch_means(s))
    return out.select("run", "epochs", *[r9(c).alias(c) for c in out.columns[2:]])


# ---- F34
def _show_sql():
    from quorum.plans.prompt_queries import _PROMPT_CTES
    return with_views(*_DIST_VIEWS, ctes=_PROMPT_CTES + """
od AS (SELECT qkey, attribute, grp, opt_idx AS i, p FROM dist
       UNION ALL SELECT qkey, attribute, grp, max(opt_idx) + 1, max(refusal_rate) FROM dist GROUP BY qkey, attribute, grp),
gs AS (SELECT *, p / sum(p) OVER (PARTITION BY qkey, attribute, grp) AS g FROM od),
slots AS (SELECT k.qkey, k.attribute, k.grp, s.i FROM (SELECT DISTINCT qkey, attribute, grp FROM od) k
          CROSS JOIN (SELECT unnest(range(1, 27)) AS i) s),
g26 AS (SELECT s.qkey, s.attribute, s.grp, s.i, coalesce(g.g, 0) AS g FROM slots s
        LEFT JOIN gs g ON g.qkey = s.qkey AND g.attribute = s.attribute AND g.grp = s.grp AND g.i = s.i),
top AS (SELECT qkey, attribute, grp, string_agg(chr(64 + CAST(i AS INTEGER)), ',' ORDER BY g DESC, i) AS top5 FROM (
          SELECT *, row_number() OVER (PARTITION BY qkey, attribute, grp ORDER BY g DESC, i) AS r FROM g26) WHERE r <= 5
        GROUP BY qkey, attribute, grp)""") + """
SELECT pr.qkey, pr.attribute, pr.grp, pr.steering_type,
       CASE WHEN length(pr.input_prompt) <= 600 THEN pr.input_prompt
            ELSE substr(pr.input_prompt, 1, 600) || chr(10) || '... [truncated]' END AS shown, t.top5
FROM pr JOIN top t ON t.qkey = pr.qkey AND t.attribute = pr.attribute AND t.grp = pr.grp"""


@query("show_examples", _show_sql())
def q_show_examples(spark, sf_dir):
    """Prompts cut for display, with the gold distribution's five most likely
    letters (gold padded to 26 and renormalised)."""
    from quorum.plans.prompt_queries import prompt_table
    p = prompt_table(spark, sf_dir, n_tokens=0)
    gold, _ = M.pad_target("output_dist", "ordinal", always_renormalize=True)
    top = CP.topk_options(gold, 5)
    return p.select("qkey", "attribute", "grp", "steering_type", CP.show_prompt("input_prompt", 600).alias("shown"),
                    F.array_join(F.transform(top, lambda x: x["letter"]), ",").alias("top5"))
