"""Comparing scored runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from quorum.functions import rng, text
from quorum.operators.positions import scan

METRICS = ("kl", "wd", "loss")


def _with_deltas(pairs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return pairs.withColumns({f"{m}_delta_base_minus_ft": F.col(f"{m}_baseline") - F.col(f"{m}_ft") for m in metrics})


def _sides(baseline: DataFrame, finetuned: DataFrame, metrics: Sequence[str], *others: str) -> tuple[DataFrame, DataFrame]:
    return tuple(df.select(*others, *[F.col(m).alias(f"{m}_{side}") for m in metrics])
                 for df, side in ((baseline, "baseline"), (finetuned, "ft")))


def paired_join(baseline: DataFrame, finetuned: DataFrame, key: str = "row_idx",
                metrics: Sequence[str] = METRICS) -> DataFrame:
    """J9 + F33: pair two metric tables by position in row-index order (error
    on a row-count mismatch) and add ``<m>_delta_base_minus_ft``.  Equal sets of
    indexes pair by the index itself: one full outer join, written, whose unmatched
    rows and repeats tell whether they are.  Others pair by rank
    (``paired_by_position``), keeping the baseline's index."""
    from quorum.sources.io import kept
    sides = _sides(baseline, finetuned, metrics, key)
    # the counts use the join's own partitioning
    b, f = (x.withColumnRenamed(key, f"_{n}").withColumn(f"_n{n}", F.count(F.lit(1)).over(Window.partitionBy(f"_{n}")))
            for x, n in zip(sides, "bf"))
    both = kept(b.join(f, F.col("_b") == F.col("_f"), "full_outer"), "paired")
    alone = both.agg(F.count_if(F.col("_nf").isNull()).alias("b"), F.count_if(F.col("_nb").isNull()).alias("f"),
                     F.max(F.greatest("_nb", "_nf")).alias("n")).first()
    if (alone["n"] or 1) == 1 and alone["b"] != alone["f"]:
        raise ValueError(f"Row count mismatch: {alone['b']} baseline rows and {alone['f']} fine-tuned rows have no partner")
    if (alone["n"] or 1) > 1 or alone["b"]:
        return paired_by_position(baseline, finetuned, [key], key, metrics)
    return _with_deltas(both.drop("_f", "_nb", "_nf").withColumnRenamed("_b", key), metrics)


def paired_by_position(baseline: DataFrame, finetuned: DataFrame, order: Sequence[str], name: str = "row_idx",
                       metrics: Sequence[str] = METRICS) -> DataFrame:
    """The nth row by ``order`` of one table with the nth of the other, equal
    keys in the order of the input.  The scans count the rows while they number
    them, so that a mismatch is an error and each side is read in one pass."""
    numbered = [scan(x.select(*dict.fromkeys([*order, *metrics])), order, name="_rank") for x in (baseline, finetuned)]
    if numbered[0].count != numbered[1].count:
        raise ValueError(f"Row count mismatch: baseline={numbered[0].count} ft={numbered[1].count}")
    index = F.col(name) if name in baseline.columns else F.col("_rank")
    b, f = _sides(numbered[0].rows.withColumn(name, index), numbered[1].rows.withColumn(name, F.lit(None)), metrics, "_rank", name)
    return _with_deltas(b.join(f.drop(name), "_rank").drop("_rank"), metrics)


def paired_summary(paired: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Means of both sides, mean deltas, share of rows improved (%)."""
    aggs = []
    for m in metrics:
        d = F.col(f"{m}_delta_base_minus_ft")
        aggs += [F.avg(f"{m}_baseline").alias(f"{m}_baseline_mean"), F.avg(f"{m}_ft").alias(f"{m}_ft_mean"),
                 F.avg(d).alias(f"{m}_delta_mean"),
                 (F.avg((d > 0).cast("double")) * 100).alias(f"{m}_improved_pct")]
    return paired.agg(F.count(F.lit(1)).alias("rows"), *aggs)


def eval_batch_mean(rows: DataFrame, batch_size: int, index: str = "row_idx") -> DataFrame:
    """Per batch of ``batch_size`` consecutive rows the KL mean and the
    WD mean over non-zero rows (plain mean when all are zero); then the mean
    of the batch means (the loss is the KL term, CE training)."""
    b = rows.withColumn("_b", F.floor(F.col(index) / batch_size))
    per = b.groupBy("_b").agg(
        F.avg("kl").alias("kl_b"),
        F.coalesce(F.avg(F.when(F.col("wd") != 0, F.col("wd"))), F.avg("wd")).alias("wd_b"))
    return per.agg(F.count(F.lit(1)).alias("batches"), F.avg("kl_b").alias("mean_loss"),
                   F.avg("kl_b").alias("mean_kl"), F.avg("wd_b").alias("mean_wd"))


def epoch_means(rows: DataFrame, keys: Sequence[str] = ("run", "epoch")) -> DataFrame:
    """Per run and epoch the mean loss and its perplexity, and, where the
    rows have them, the mean KL and the mean WD over rows with a WD above zero
    (NULL when there is none)."""
    aggs = [F.count(F.lit(1)).alias("steps"), F.avg("loss").alias("loss"), F.exp(F.avg("loss")).alias("perplexity")]
    if "kl" in rows.columns:
        aggs.append(F.avg("kl").alias("kl"))
    if "wd" in rows.columns:
        aggs.append(F.avg(F.when(F.col("wd") != 0, F.col("wd"))).alias("wd"))
    return rows.groupBy(*keys).agg(*aggs)


def run_averages(epochs: DataFrame, run: str = "run") -> DataFrame:
    """Per run the plain averages over its epochs, and the best loss."""
    values = [c for c in ("loss", "perplexity", "kl", "wd") if c in epochs.columns]
    return epochs.groupBy(run).agg(F.count(F.lit(1)).alias("epochs"), *[F.avg(c).alias(f"avg_{c}") for c in values],
                                   F.min("loss").alias("best_loss"))


def bounds_summary(rows: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Mean, median and number of each bound (``columns``: column ->
    name in the result), rows without a value left out."""
    aggs = []
    for c, name in columns.items():
        x = F.when(~F.isnan(c), F.col(c))
        aggs += [F.avg(x).alias(f"mean_{name}"), F.median(x).alias(f"median_{name}"), F.count(x).alias(f"n_{name}")]
    return rows.agg(*aggs)


def run_matrix(metrics: DataFrame) -> DataFrame:
    """Per (model, prompt) the baseline / fine-tuned means of KL and WD
    and ``ft - baseline`` (one pivot, no self-join)."""
    p = (metrics.groupBy("model", "prompt").pivot("run", ["baseline", "ft"])
                .agg(F.avg("kl").alias("kl"), F.avg("wd").alias("wd")))
    return p.select("model", "prompt",
                    F.col("baseline_kl"), F.col("baseline_wd"), F.col("ft_kl"), F.col("ft_wd"),
                    (F.col("ft_kl") - F.col("baseline_kl")).alias("delta_kl_ft_minus_baseline"),
                    (F.col("ft_wd") - F.col("baseline_wd")).alias("delta_wd_ft_minus_baseline"))


def hist_bins(df: DataFrame, series: Sequence[str], bins: int = 40) -> DataFrame:
    """Equal-width histogram of each column on its own [min, max]."""
    # two numbers per series come to the driver and go back as literals: the facts are not shuffled for them
    edges = df.agg(*[f(F.col(s).cast("double")).alias(f"{n}_{i}") for i, s in enumerate(series)
                     for n, f in (("mn", F.min), ("mx", F.max))]).first()

    def bin_of(i: int, s: str):
        mn, mx, x = edges[f"mn_{i}"], edges[f"mx_{i}"], F.col(s).cast("double")
        b = F.lit(0) if mn is None or mn == mx else F.least(F.floor((x - mn) / (mx - mn) * bins), F.lit(bins - 1))
        return F.struct(F.lit(s).alias("series"), F.when(x.isNotNull(), b.cast("int")).alias("bin"))
    long = df.select(F.explode(F.array(*[bin_of(i, s) for i, s in enumerate(series)])).alias("v")).select("v.*")
    return long.groupBy("series", "bin").agg(F.count(F.lit(1)).alias("n"))


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row per key in ``order`` — a ``min_by`` aggregate,
    so it combines map-side and a key holding a third of the rows is not
    sorted in one task."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def dedupe_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key in ``order`` wins (a ``max_by`` aggregate)."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
              .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]))


def run_grid(inputs: DataFrame, models: Sequence[str]) -> DataFrame:
    """Every input × model (models are a parameter list, exploded in
    place) with the output name ``<input>_<model basename>`` (F35)."""
    m = F.explode(F.array(*[F.lit(x) for x in sorted(models)]))
    g = inputs.select("input", m.alias("model"))
    return g.withColumn("out_name", F.concat("input", F.lit("_"), F.substring_index("model", "/", -1)))


def topk_options(probs_col, k: int) -> F.Column:
    """T5: the k most probable option letters, ties in option order."""
    z = F.transform(probs_col, lambda p, i: F.struct((-p).alias("np"), i.alias("i"), p.alias("p")))
    top = F.slice(F.array_sort(z), 1, k)
    return F.transform(top, lambda x: F.struct(text.letter(x["i"]).alias("letter"), x["p"].alias("p")))


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """A seeded sample of ``n`` rows (hash order; the limit is the feature)."""
    return df.orderBy(rng.hash_order(seed, F.col(key)), key).limit(n)


def running_best(series: DataFrame, run: str = "run", step: str = "step", loss: str = "loss") -> DataFrame:
    """Best loss before each step and whether the step is a new best.
    Prefix minimum by blocks, so one very long run is split over tasks."""
    b = scan(series, [step], [run], "best_before", loss, "min").rows
    return b.withColumn("is_best", F.col("best_before").isNull() | (F.col(loss) < F.col("best_before")))


def step_cap(series: DataFrame, cap: int, run: str = "run", step: str = "step") -> DataFrame:
    """Keep the first ``cap`` steps of every run (dense rank by blocks)."""
    r = scan(series, [step], [run], "_rn").rows
    return r.where(F.col("_rn") < cap).drop("_rn")


def show_prompt(prompt, max_chars: int) -> F.Column:
    """prompt cut to ``max_chars`` with a truncation marker."""
    p = F.col(prompt) if isinstance(prompt, str) else prompt
    return F.when(F.length(p) <= max_chars, p).otherwise(
        F.concat(F.substring(p, 1, max_chars), F.lit("\n... [truncated]")))
