"""Answer codes, weights, options and question text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorum.operators.joins import bounded_broadcast

# Question filters of the wave data set.
PROHIBITED_WAVES = [26, 29, 32, 34, 36, 41, 42, 43, 45, 49, 50, 54, 82, 92]
REMOVED_WAVES = [47, 58, 59, 60, 63, 66, 61, 62, 64, 65, 67, 86, 89, 97, 100, 122, 132]
PROHIBITED_QKEY_PREFIXES = ["partyln"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def wave_number(qkey) -> Column:
    """Integer after the last ``_W`` of a question key."""
    return F.substring_index(_c(qkey), "_W", -1).cast("int")


def qkey_prefix(qkey) -> Column:
    return F.split(_c(qkey), "_W").getItem(0)


def coerce_numeric(x) -> Column:
    """Numeric coercion, bad text -> NULL (NaN becomes NULL too)."""
    d = F.expr(f"try_cast({x} AS DOUBLE)") if isinstance(x, str) else x.try_cast("double")
    return F.when(~F.isnan(d), d)


def answered(code) -> Column:
    """The answer exists (neither NULL nor NaN)."""
    c = _c(code)
    return c.isNotNull() & ~F.isnan(c)


def weight_ok(weight, policy: str = "cgss") -> Column:
    """P11 filter part: CGSS = finite and > 0; GSS = not NaN/NULL; ATP keeps all."""
    w = _c(weight)
    if policy == "cgss":
        return w.isNotNull() & ~F.isnan(w) & (w > 0) & (w < F.lit(float("inf")))
    if policy == "gss":
        return w.isNotNull() & ~F.isnan(w)
    if policy == "atp":
        return F.lit(True)
    raise ValueError(f"unknown weight policy {policy!r}")


def weight_value(weight, policy: str = "cgss") -> Column:
    """P11 value part: ATP maps NaN/NULL weights to 0."""
    w = _c(weight)
    if policy == "atp":
        return F.coalesce(F.nanvl(w, F.lit(0.0)), F.lit(0.0))
    return w


def filter_qkeys(qkeys: DataFrame, error_keys: DataFrame | None = None,
                 prohibited_prefixes: Sequence[str] = PROHIBITED_QKEY_PREFIXES,
                 prohibited_waves: Sequence[int] = PROHIBITED_WAVES,
                 removed_waves: Sequence[int] = REMOVED_WAVES) -> DataFrame:
    """Allow-list of questions (``qkey`` column)."""
    out = qkeys
    if error_keys is not None:
        out = out.join(bounded_broadcast(error_keys.select("qkey").distinct()), "qkey", "left_anti")
    waves = list(prohibited_waves) + list(removed_waves)
    return out.where(~F.lower(qkey_prefix("qkey")).isin(list(prohibited_prefixes))
                     & ~wave_number("qkey").isin(waves))


def code_status(code, refusal_codes, invalid_codes) -> Column:
    """P10: 'missing' / 'refused' / 'invalid' / 'valid' (refusal is tested first)."""
    c = _c(code)
    return (F.when(c.isNull() | F.isnan(c), F.lit("missing"))
             .when(F.coalesce(F.array_contains(_c(refusal_codes), c), F.lit(False)), F.lit("refused"))
             .when(F.coalesce(F.array_contains(_c(invalid_codes), c), F.lit(False)), F.lit("invalid"))
             .otherwise(F.lit("valid")))


def resolve_policy(policy: DataFrame, global_invalid: Sequence[float],
                   global_refusal: Sequence[float]) -> DataFrame:
    """Per-question code sets: refusal = own list if given else global;
    invalid = global ∪ own (P10, U5)."""
    gi = F.array(*[F.lit(float(x)) for x in global_invalid]).cast("array<double>")
    gr = F.array(*[F.lit(float(x)) for x in global_refusal]).cast("array<double>")
    return policy.select(
        "var",
        F.coalesce(F.col("refusal_codes"), gr).alias("refusal_set"),
        F.array_union(gi, F.coalesce(F.col("invalid_codes"), F.array().cast("array<double>"))).alias("invalid_set"),
        F.col("question_text"),
        F.col("split"))


def build_options(codebook: DataFrame, resolved_policy: DataFrame,
                  no_order_codes: Sequence[float] = ()) -> DataFrame:
    """Per question the valid options, sorted by code.

    Returns one row per var: ``codes ARRAY<DOUBLE>, options ARRAY<STRING>
    (stripped labels), ordinal ARRAY<DOUBLE> (1..K)``; questions left with
    no option are dropped.  Codes in ``no_order_codes`` (e.g. "don't know")
    get ordinal -1 (Q18; empty by default, as the reference).  Input sizes
    are the codebook's (metadata).
    """
    cb = (codebook.where(answered("code"))
                  .join(bounded_broadcast(resolved_policy.select("var", "refusal_set", "invalid_set")), "var")
                  .where(~F.array_contains("refusal_set", F.col("code"))
                         & ~F.array_contains("invalid_set", F.col("code"))))
    opts = (cb.groupBy("var")
              .agg(F.sort_array(F.collect_list(F.struct("code", F.trim("label").alias("label"))))
                   .alias("pairs")))
    return opts.select(
        "var",
        F.transform("pairs", lambda x: x["code"]).alias("codes"),
        F.transform("pairs", lambda x: x["label"]).alias("options"),
        F.transform("pairs", lambda x, i: F.when(
            F.array_contains(F.array(*[F.lit(float(c)) for c in no_order_codes]).cast("array<double>"), x["code"]),
            F.lit(-1.0)).otherwise((i + 1).cast("double"))).alias("ordinal"))


def option_index(codebook: DataFrame, resolved_policy: DataFrame) -> DataFrame:
    """P17 long form: ``(var, code, opt_idx 1..K, label)``."""
    o = build_options(codebook, resolved_policy)
    return (o.select("var", F.posexplode(F.arrays_zip("codes", "options")).alias("pos", "x"))
             .select("var", F.col("x.codes").alias("code"), (F.col("pos") + 1).alias("opt_idx"),
                     F.col("x.options").alias("label")))


def question_text(config_text, var_label, var) -> Column:
    """P18 (CGSS): config text, else variable label, else the name; trimmed."""
    return (F.when(F.coalesce(F.length(_c(config_text)), F.lit(0)) > 0, F.trim(_c(config_text)))
             .when(F.coalesce(F.length(_c(var_label)), F.lit(0)) > 0, F.trim(_c(var_label)))
             .otherwise(_c(var)))


def question_body_after_dot(label) -> Column:
    """P18 (wave data): text after the first '.', trimmed; empty when no dot."""
    lab = _c(label)
    after = lab.substr(F.instr(lab, ".") + 1, F.length(lab))
    return F.when(F.instr(lab, ".") > 0, F.trim(after)).otherwise(F.lit(""))


def questions_for_split(policy: DataFrame, split: str, legacy: DataFrame | None = None) -> DataFrame:
    """Questions of a split from a per-question config
    (``var, split`` with split 'train'/'eval'): ``train`` falls back to the
    legacy list when no train question is configured, ``all`` is train ∪
    eval (else legacy); placeholder names (``__REPLACE…``) are skipped."""
    if split not in ("train", "eval", "all"):
        raise ValueError(f"unknown split {split!r}")
    p = policy.where(~F.col("var").startswith("__REPLACE"))
    wanted = ["train", "eval"] if split == "all" else [split]
    chosen = p.where(F.col("split").isin(wanted)).select("var", "split")
    if legacy is None or split == "eval":
        return chosen
    fallback = legacy.where(~F.col("var").startswith("__REPLACE")).select("var", F.lit(split).alias("split"))
    # legacy only when nothing was configured for the split (a scalar decision on metadata)
    return chosen if chosen.limit(1).count() > 0 else fallback
