"""Sub-population predicates and group tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorum.functions.text import parse_literal
from quorum.operators.distribution import OVERALL
from quorum.operators.joins import bounded_broadcast


def subpop_filter(attribute_columns: Mapping[str, str], group_codes: Mapping[tuple[str, str], Sequence],
                  attributes, traits) -> Column:
    """AND over (attribute, trait) of ``column IN codes``.

    ``attributes``/``traits`` are both str or both equal-length lists
    (arity errors as in the reference); ``Overall/Overall`` is everyone;
    an unknown attribute or group raises ``KeyError``.
    """
    if isinstance(attributes, str):
        if not isinstance(traits, str):
            raise TypeError("attribute and trait must be both str or both list")
        attributes, traits = [attributes], [traits]
    elif isinstance(attributes, list):
        if not isinstance(traits, list):
            raise TypeError("attribute and trait must be both str or both list")
        if len(attributes) != len(traits):
            raise ValueError("attribute and trait must have the same length")
    else:
        raise TypeError("attribute and trait must be str or list")
    preds = []
    for a, t in zip(attributes, traits):
        if a.lower() == "overall" and t.lower() == "overall":
            continue
        if a not in attribute_columns:
            raise KeyError(f"no column for attribute {a}")
        codes = group_codes.get((a, t))
        if codes is None:
            raise KeyError(f"no code list for ({a}, {t})")
        preds.append(F.col(attribute_columns[a]).cast("string").isin([str(c) for c in codes]))
    return reduce(lambda x, y: x & y, preds, F.lit(True))


def indicator_any(columns: Sequence[str], value=1) -> Column:
    """Member when any of the 0/1 indicator columns equals ``value``
    (a person may be in several such groups)."""
    return reduce(lambda x, y: x | y, [F.coalesce(F.col(c) == value, F.lit(False)) for c in columns])


def code_map(group_code_rows: Sequence[tuple[str, str, str]]) -> dict[tuple[str, str], list[str]]:
    out: dict[tuple[str, str], list[str]] = {}
    for a, g, c in group_code_rows:
        out.setdefault((a, g), []).append(c)
    return out


def choose_column(columns: Sequence[str], candidates: Sequence[str]) -> str:
    """P8 (column part): the first candidate name the table has (decided on
    the driver from the schema — metadata, not data)."""
    for c in candidates:
        if c in columns:
            return c
    raise KeyError(f"none of {list(candidates)} present")


def wave_membership(people: DataFrame, resolution: DataFrame) -> DataFrame:
    """The groups of people ``(…, wave, attribute, var, code)`` by a
    resolution table ``(wave, attribute, var, grp, code)`` of each wave's own column
    and codes (metadata): one membership, however waves name and code an attribute."""
    return people.join(bounded_broadcast(resolution.distinct()), ["wave", "attribute", "var", "code"]).drop("var", "code")


def convert_traits(traits: DataFrame, codebook: DataFrame) -> DataFrame:
    """P8 (code part): ``traits(attribute, var, trait, mode)`` against a
    codebook ``(var, pos, code, label)``.

    mode ``prefix``: the first label (by ``pos``) whose lower case starts
    with the trait; mode ``list``: every label equal (case-insensitive) to
    one of the ``|``-separated traits.  Unmatched traits yield no row.
    """
    cb = codebook.select("var", "pos", "code", F.lower("label").alias("_l"))
    j = traits.join(bounded_broadcast(cb), "var")
    pre = (j.where((F.col("mode") == "prefix") & F.col("_l").startswith(F.lower("trait")))
             .groupBy("attribute", "var", "trait", "mode")
             .agg(F.min_by("code", "pos").alias("code")))
    lst = (j.where((F.col("mode") == "list")
                   & F.array_contains(F.split(F.lower("trait"), r"\|"), F.col("_l")))
             .select("attribute", "var", "trait", "mode", "code"))
    return pre.unionByName(lst)


def recode_group(attribute, group, mapping: Mapping[tuple[str, str], str] | Callable[[Column, Column], Column] | None = None
                 ) -> Column:
    """User recode of (attribute, group) -> group label; identity when
    no rule matches.  ``mapping`` is small metadata, compiled into CASE, or a
    function from the two columns to the new one."""
    a, g = (F.col(attribute) if isinstance(attribute, str) else attribute,
            F.col(group) if isinstance(group, str) else group)
    if callable(mapping):
        return F.coalesce(mapping(a, g), g)
    out = None
    for (ma, mg), new in (mapping or {}).items():
        cond = (a == ma) & (g == mg)
        out = F.when(cond, F.lit(new)) if out is None else out.when(cond, F.lit(new))
    return g if out is None else out.otherwise(g)


def recode_groups(df: DataFrame, mapping: DataFrame, name: str = "grp") -> DataFrame:
    """X1 with the recode as a table ``(attribute, grp, recoded)``: ``name`` is
    replaced where the table lists it.  A pair listed twice takes the smaller label."""
    m = mapping.groupBy(F.col("attribute").alias("_ma"), F.col("grp").alias("_mg")).agg(F.min("recoded").alias("_mr"))
    out = df.join(bounded_broadcast(m), df["attribute"].eqNullSafe(F.col("_ma")) & df[name].eqNullSafe(F.col("_mg")), "left")
    return out.withColumn(name, F.coalesce("_mr", name)).select(*df.columns)


def exclude_listed(df: DataFrame, listed: DataFrame, key: str = "qkey") -> DataFrame:
    """Rows whose ``key`` is not in the list (of near-duplicate or refused
    questions).  A NULL key is in no list and stays."""
    keys = listed.select(F.col(key).alias("_x")).where(F.col("_x").isNotNull()).distinct()
    return df.join(bounded_broadcast(keys), df[key] == F.col("_x"), "left_anti")


def groups_explode(catalogue: DataFrame) -> DataFrame:
    """``(attribute, group)`` with ``group`` a list literal -> one row per group."""
    arr = parse_literal("group", "string")  # either quote character, so an apostrophe inside a label stays
    return catalogue.select("attribute", F.explode(arr).alias("grp"))


def group_grid(keys: DataFrame, group_rows: Sequence[tuple[str, str]], overall: bool = True) -> DataFrame:
    """Every key × every (attribute, group) of the catalogue.

    The catalogue is metadata (bounded by the codebook), so it is inlined
    as an array and exploded per key row — no join and no shuffle."""
    rows = ([(OVERALL, OVERALL)] if overall else []) + list(dict.fromkeys(group_rows))
    arr = F.array(*[F.struct(F.lit(a).alias("attribute"), F.lit(g).alias("grp")) for a, g in rows])
    return keys.select("*", F.explode(arr).alias("_g")).select(
        *keys.columns, F.col("_g.attribute").alias("attribute"), F.col("_g.grp").alias("grp"))
