"""Weighted answer distributions per (question, attribute, group).

Plan (one pass over the answers, whatever the number of groups):

1. row filters (answered, weight policy) on the long answers;
2. membership: ``explode`` the respondent's attribute codes (plus the
   ``Overall`` pseudo-attribute) and join the *metadata* table of group code
   lists (broadcast: its size is the codebook's, not the data's);
3. ``groupBy(qkey, var, attribute, grp, code).sum(weight)`` — Spark's
   partial aggregation collapses rows map-side, so a hot group (``Overall``
   holds every row) ships at most ``#partitions × #codes`` rows;
4. everything after that runs on the small aggregate: code status, option
   lookup, normalisation, array assembly.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorum.operators import codes as C
from quorum.operators.joins import bounded_broadcast

OVERALL = "Overall"


def with_overall(group_codes: DataFrame) -> DataFrame:
    """Add the ``Overall / Overall`` group that everybody belongs to."""
    from quorum.sources.views import literal_table
    ov = literal_table(group_codes.sparkSession, [(OVERALL, OVERALL, OVERALL)], "attribute string, grp string, code string")
    return group_codes.select("attribute", "grp", F.col("code").cast("string")).unionByName(ov)


def membership(df: DataFrame, attribute_columns: Mapping[str, str], group_codes: DataFrame,
               overall: bool = True) -> DataFrame:
    """One row per (row, attribute, group) the row belongs to.

    ``attribute_columns`` maps attribute -> column of ``df``; ``group_codes``
    is ``(attribute, grp, code)`` with one row per code of a group (code
    lists, overlapping groups allowed).  Rows in no group of an attribute
    simply produce no row for it (empty groups vanish, P16).
    """
    pairs = [F.struct(F.lit(a).alias("attribute"), F.col(c).cast("string").alias("code"))
             for a, c in attribute_columns.items()]
    gc = group_codes.select("attribute", "grp", F.col("code").cast("string"))
    if overall:
        pairs.append(F.struct(F.lit(OVERALL).alias("attribute"), F.lit(OVERALL).alias("code")))
        gc = with_overall(gc)
    exploded = (df.withColumn("_m", F.explode(F.array(*pairs)))
                  .withColumn("attribute", F.col("_m.attribute"))
                  .withColumn("_code", F.col("_m.code")).drop("_m"))
    return (exploded.join(bounded_broadcast(gc.withColumnRenamed("code", "_code")), ["attribute", "_code"])
                    .drop("_code"))


def _py_list_str(cols: Sequence) -> F.Column:
    """``str(list_of_str)`` as Python prints it: ['a', 'b']."""
    quoted = [F.concat(F.lit("'"), c, F.lit("'")) for c in cols]
    return F.concat(F.lit("["), F.concat_ws(", ", *quoted), F.lit("]"))


def weighted_counts(resp: DataFrame, attribute_columns: Mapping[str, str], group_codes: DataFrame,
                    weight_policy: str = "cgss", use_weight: bool = True,
                    k: int | Sequence[int] = 1) -> DataFrame:
    """Steps 1–3: ``(qkey, var, attribute, grp, code, w, n)``.

    ``k=1`` gives single attributes plus Overall; ``k>=2``, or several such
    sizes at once, gives the joint groups of every subset of so many attributes (A7).
    """
    rows = resp.where(C.answered("code") & C.weight_ok("weight", weight_policy))
    w = C.weight_value("weight", weight_policy) if use_weight else F.lit(1.0)
    rows = rows.withColumn("_w", w)
    if k == 1:
        m = membership(rows, attribute_columns, group_codes, overall=True)
        return m.groupBy("qkey", "var", "attribute", "grp", "code").agg(F.sum("_w").alias("w"), F.count(F.lit(1)).alias("n"))
    return joint_counts(rows, attribute_columns, group_codes, [k] if isinstance(k, int) else list(k))


def joint_counts(rows: DataFrame, attribute_columns: Mapping[str, str], group_codes: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """Joint groups of every subset of ``sizes`` attributes (the product of
    their groups), for all subsets in one pass; labels print like Python lists.

    Answers are summed by grouping sets of the attributes' codes, one set a
    subset.  Groups, which may overlap, are looked up on those sums: each code's groups
    come from a broadcast metadata table, and the product is exploded there."""
    import itertools
    key, names = ["qkey", "var", "code"], list(attribute_columns)
    coded = rows.select(*key, "_w", *[F.col(c).cast("string").alias(f"_c_{a}") for a, c in attribute_columns.items()])
    sets = [[*key, *[f"_c_{a}" for a in subset]] for size in sizes for subset in itertools.combinations(names, size)]
    sums = coded.groupingSets(sets, *key, *[f"_c_{a}" for a in names]).agg(
        F.sum("_w").alias("w"), F.count(F.lit(1)).alias("n"), *[(F.grouping(f"_c_{a}") == 0).alias(f"_in_{a}") for a in names])
    lut = group_codes.select("attribute", "grp", F.col("code").cast("string")).groupBy("attribute", "code").agg(F.collect_set("grp").alias("grps"))
    for a in names:
        own = lut.where(F.col("attribute") == a).select(F.col("code").alias(f"_c_{a}"), F.col("grps").alias("_grps"))
        groups = F.when(F.col(f"_in_{a}"), F.col("_grps")).otherwise(F.array(F.lit(None).cast("string")))
        # a code without a group is in no joint group of its attribute: its array is NULL and explodes to nothing
        sums = sums.join(bounded_broadcast(own), f"_c_{a}", "left").withColumn(f"_g_{a}", F.explode(groups)).drop("_grps")

    def listed(items):
        kept = F.filter(F.array(*items), lambda x: x.isNotNull())
        return F.concat(F.lit("['"), F.array_join(kept, "', '"), F.lit("']"))
    attribute = listed([F.when(F.col(f"_in_{a}"), F.lit(a)) for a in names])
    grp = listed([F.col(f"_g_{a}") for a in names])
    return (sums.select("qkey", "var", attribute.alias("attribute"), grp.alias("grp"), "code", "w", "n")
            .groupBy("qkey", "var", "attribute", "grp", "code").agg(F.sum("w").alias("w"), F.sum("n").alias("n")))


def distribution_cgss(resp: DataFrame, codebook: DataFrame, policy: DataFrame, variables: DataFrame,
                      group_codes: DataFrame, attribute_columns: Mapping[str, str],
                      global_invalid: Sequence[float], global_refusal: Sequence[float],
                      k: int | Sequence[int] = 1, with_report: bool = False, no_order_codes: Sequence[float] = ()) -> DataFrame:
    """A3 (+A4, A6, J6, J12, P10, P11, P16, P17, F36).

    Output per (qkey, attribute, grp): ``responses ARRAY<DOUBLE>`` over the
    valid options sorted by code, ``refusal_rate = ref/(ref+valid)``,
    ``ordinal`` 1..K, ``options``, ``question``; the pair is skipped when
    the denominator is <= 0 or every weight is refused (``with_report``
    keeps those rows with a ``skip_reason``).
    """
    rp = C.resolve_policy(policy, global_invalid, global_refusal)
    opts = C.build_options(codebook, rp, no_order_codes)
    cnt = weighted_counts(resp, attribute_columns, group_codes, "cgss", k=k)
    st = (cnt.join(bounded_broadcast(rp.select("var", "refusal_set", "invalid_set")), "var", "left")
             .withColumn("status", C.code_status(
                 "code",
                 F.coalesce("refusal_set", F.array(*[F.lit(float(x)) for x in global_refusal])),
                 F.coalesce("invalid_set", F.array(*[F.lit(float(x)) for x in global_invalid])))))
    agg = (st.groupBy("qkey", "var", "attribute", "grp")
             .agg(F.map_from_entries(F.collect_list(
                      F.when(F.col("status") == "valid", F.struct("code", "w")))).alias("wmap"),
                  F.sum(F.when(F.col("status") == "refused", F.col("w")).otherwise(0.0)).alias("ref_w")))
    # question text per question with options (metadata: broadcast lookups, no shuffle)
    meta = (opts.join(bounded_broadcast(variables.select("var", "label")), "var", "left")
                .join(bounded_broadcast(rp.select("var", "question_text")), "var", "left")
                .withColumn("question", C.question_text("question_text", "label", "var"))
                .drop("label", "question_text"))
    d = (agg.join(bounded_broadcast(meta), "var")  # J12: unknown questions / codes drop out
            .withColumn("wv", F.transform("codes", lambda c: F.coalesce(F.try_element_at("wmap", c), F.lit(0.0))))
            .withColumn("valid_w", F.aggregate("wv", F.lit(0.0), lambda a, x: a + x)))
    denom = F.col("valid_w") + F.col("ref_w")
    d = d.withColumn("skip_reason",
                     F.when(denom <= 0, F.lit("no_weight"))
                      .when(F.abs(F.col("valid_w")) <= 1e-8, F.lit("all_refused")))
    out = d.select(
        "qkey", "attribute", "grp",
        F.transform("wv", lambda x: F.try_divide(x, F.col("valid_w"))).alias("responses"),
        F.try_divide(F.col("ref_w"), denom).alias("refusal_rate"),
        "ordinal",
        F.coalesce("question", "var").alias("question"),
        "options", "skip_reason")
    if with_report:
        return out
    return out.where(F.col("skip_reason").isNull()).drop("skip_reason")


def explode_distribution(dist: DataFrame, extra: Sequence[str] = ("refusal_rate",)) -> DataFrame:
    """Long form of a distribution table: one row per option."""
    return (dist.select("qkey", "attribute", "grp", *extra,
                        F.posexplode(F.arrays_zip(F.col("responses").alias("p"),
                                                  F.col("options").alias("option"),
                                                  F.col("ordinal").alias("ord"))).alias("pos", "x"))
                .select("qkey", "attribute", "grp", *extra, (F.col("pos") + 1).alias("opt_idx"),
                        F.col("x.option").alias("option"), F.col("x.p").alias("p"),
                        F.col("x.ord").alias("ordinal")))


def _refusal_codes(codebook: DataFrame) -> DataFrame:
    """Wave data convention: a question's last label (max ``pos``) is its refusal."""
    return (codebook.groupBy("var").agg(F.max_by("code", "pos").alias("refusal_code")))


def distribution_atp(resp: DataFrame, codebook: DataFrame, group_codes: DataFrame,
                     attribute_columns: Mapping[str, str], remove_refusal: bool = True,
                     use_weight: bool = True, k: int | Sequence[int] = 1, with_report: bool = False) -> DataFrame:
    """A1: zero-filled weighted distribution over the question's labelled
    options (refusal dropped when ``remove_refusal``), sorted by code
    (T1); NaN/NULL weights count 0; NULL (skipped) when the total is 0.
    Codes without a label are dropped.  ``with_report`` keeps skipped pairs,
    with a ``skip_reason``.
    Output: ``qkey, attribute, grp, codes ARRAY<DOUBLE>, responses ARRAY<DOUBLE>``.
    """
    out = _distribution_atp(resp, codebook, group_codes, attribute_columns, remove_refusal, use_weight, k).drop("var")
    return out if with_report else out.where(F.col("skip_reason").isNull()).drop("skip_reason")


def _distribution_atp(resp, codebook, group_codes, attribute_columns, remove_refusal=True, use_weight=True, k=1):
    ref = _refusal_codes(codebook)
    cb = codebook.join(ref, "var")
    if remove_refusal:
        cb = cb.where(F.col("code") != F.col("refusal_code"))
    opts = cb.groupBy("var").agg(F.sort_array(F.collect_list("code")).alias("codes"))
    cnt = weighted_counts(resp, attribute_columns, group_codes, "atp", use_weight, k=k)
    cnt = cnt.join(bounded_broadcast(ref), "var")
    if remove_refusal:
        cnt = cnt.where(F.col("code") != F.col("refusal_code"))
    agg = (cnt.groupBy("qkey", "var", "attribute", "grp")
              .agg(F.map_from_entries(F.collect_list(F.struct("code", "w"))).alias("wmap")))
    d = (agg.join(bounded_broadcast(opts), "var")
            .withColumn("wv", F.transform("codes", lambda c: F.coalesce(F.try_element_at("wmap", c), F.lit(0.0))))
            .withColumn("tot", F.aggregate("wv", F.lit(0.0), lambda a, x: a + x)))
    return d.select("qkey", "var", "attribute", "grp", "codes",
                    F.transform("wv", lambda x: F.try_divide(x, F.col("tot"))).alias("responses"),
                    F.when(F.col("tot") == 0, F.lit("no_weight")).alias("skip_reason"))


def assemble_atp(resp: DataFrame, codebook: DataFrame, variables: DataFrame, group_codes: DataFrame,
                 attribute_columns: Mapping[str, str], k: int | Sequence[int] = 1, with_report: bool = False) -> DataFrame:
    """A6 (wave data): distribution with refusals kept, ``refusal_rate`` =
    the refusal option's share, ``responses`` = the other options
    renormalised (pair skipped when nothing but refusals), ``ordinal`` all
    1.0 (F36), ``options`` = every label stripped in label order.
    ``with_report`` keeps skipped pairs, with a ``skip_reason``."""
    from quorum.functions.metrics import normalize
    from quorum.operators.codes import question_body_after_dot
    full = _distribution_atp(resp, codebook, group_codes, attribute_columns, remove_refusal=False, k=k)
    ref = _refusal_codes(codebook)
    labels = (codebook.groupBy("var")
                      .agg(F.sort_array(F.collect_list(F.struct("pos", F.trim("label").alias("l")))).alias("_ls"))
                      .select("var", F.transform("_ls", lambda x: x["l"]).alias("options")))
    meta = (labels.join(ref, "var")
                  .join(variables.select("var", question_body_after_dot("label").alias("question")), "var", "left"))
    d = (full.join(bounded_broadcast(meta), "var")
             .withColumn("_ri", F.array_position("codes", F.col("refusal_code")))
             .withColumn("refusal_rate", F.when(F.col("_ri") > 0,
                                                F.try_element_at("responses", F.col("_ri").cast("int")))
                                          .otherwise(F.lit(0.0)))
             .withColumn("_rest", F.filter("responses", lambda x, i: i + 1 != F.col("_ri")))
             .withColumn("responses", normalize("_rest")))
    d = d.withColumn("skip_reason", F.when(F.col("skip_reason").isNull() & F.col("responses").isNull(), F.lit("all_refused"))
                                     .otherwise(F.col("skip_reason")))
    out = d.select("qkey", "attribute", "grp", "responses", "refusal_rate",
                   F.transform("responses", lambda x: F.lit(1.0)).alias("ordinal"), "question", "options", "skip_reason")
    return out if with_report else out.where(F.col("skip_reason").isNull()).drop("skip_reason")


def distribution_gss(resp: DataFrame, options: DataFrame, group_codes: DataFrame,
                     attribute_columns: Mapping[str, str], k: int | Sequence[int] = 1, with_report: bool = False) -> DataFrame:
    """A2: option index = code - min(code) of the question over the whole
    population; only integral codes and non-NaN weights count; the
    refusal rate is the share of the option labelled ``Refused`` (else 0);
    ``responses`` = all options but the last, renormalised.  ``options``:
    ``(var, options ARRAY<STRING>, ordinal ARRAY<DOUBLE>)``.  Pairs with a
    zero total are skipped; ``with_report`` keeps them, with a ``skip_reason``.
    """
    from quorum.functions.metrics import normalize
    from quorum.operators import codes as C
    rows = resp.where(C.answered("code"))
    mins = rows.groupBy("qkey").agg(F.min("code").alias("min_code"))  # one row per question
    cnt = weighted_counts(rows.where(F.col("code") == F.floor("code")), attribute_columns,
                          group_codes, "gss", True, k=k)
    cnt = cnt.join(bounded_broadcast(mins), "qkey").withColumn("idx", (F.col("code") - F.col("min_code")).cast("int"))
    agg = (cnt.groupBy("qkey", "var", "attribute", "grp")
              .agg(F.map_from_entries(F.collect_list(F.struct("idx", "w"))).alias("wmap")))
    d = (agg.join(bounded_broadcast(options), "var")
            .withColumn("wv", F.transform("options", lambda o, i: F.coalesce(F.try_element_at("wmap", i), F.lit(0.0))))
            .withColumn("tot", F.aggregate("wv", F.lit(0.0), lambda a, x: a + x))
            .withColumn("skip_reason", F.when(F.col("tot") == 0, F.lit("no_weight")))
            .withColumn("p", F.transform("wv", lambda x: F.try_divide(x, F.col("tot"))))
            .withColumn("_ri", F.array_position("options", F.lit("Refused"))))
    out = d.select(
        "qkey", "attribute", "grp", "skip_reason",
        normalize(F.slice("p", 1, F.size("p") - 1)).alias("responses"),
        F.when(F.col("_ri") > 0, F.try_element_at("p", F.col("_ri").cast("int"))).otherwise(F.lit(0.0))
         .alias("refusal_rate"),
        "ordinal", "options")
    return out if with_report else out.where(F.col("skip_reason").isNull()).drop("skip_reason")


def n_respondent(resp: DataFrame, codebook: DataFrame) -> DataFrame:
    """A5: per question, respondents with an answer, with and without the
    refusal (last label) counted."""
    from quorum.operators import codes as C
    ref = _refusal_codes(codebook)
    r = resp.where(C.answered("code")).join(bounded_broadcast(ref), "var", "left")
    return r.groupBy("qkey").agg(
        F.count(F.lit(1)).alias("n_with_refusal"),
        F.count_if(F.col("refusal_code").isNull() | (F.col("code") != F.col("refusal_code")))
         .alias("n_without_refusal"))


def skip_report(report: DataFrame) -> DataFrame:
    """Rows produced and pairs skipped, by reason."""
    return (report.select(F.coalesce("skip_reason", F.lit("ok")).alias("reason"))
                  .groupBy("reason").agg(F.count(F.lit(1)).alias("n")))
