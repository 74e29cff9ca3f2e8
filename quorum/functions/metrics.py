"""Distribution metrics as native Column expressions.

All of these compile to JVM higher-order functions (whole-stage codegen,
no Python round trip), so they run wherever the rows already are.
Arrays are ``ARRAY<DOUBLE>``; ordinals use -1 for "no order".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_TOL = 1e-8   # the list normaliser refuses sums within this of zero
LOG_EPS = 1e-8    # smoothing inside the KL logarithms


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value, fn) -> Column:
    """Evaluate ``value`` once per row and hand it to ``fn``.

    Spark does not share sub-expressions across lambda boundaries, so an
    array referenced inside ``transform``/``aggregate`` would be recomputed
    for every element.  Binding it as the single element of a one-element
    ``transform`` evaluates it exactly once."""
    return F.transform(F.array(_c(value)), fn)[0]


def _dsum(arr: Column, field: str | None = None) -> Column:
    if field is None:
        return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x[field])


def _scale(arr: Column, s: Column) -> Column:
    return F.transform(arr, lambda v: F.try_divide(v, s))


def normalize(arr) -> Column:
    """Scale to sum 1; NULL when the sum is (close to) zero."""
    return let(arr, lambda a: let(_dsum(a), lambda s: F.when(F.abs(s) > ZERO_TOL, _scale(a, s))))


def _cum_distance(z: Column, sp: Column, sq: Column) -> Column:
    """sum_i |CDF_p(i) - CDF_q(i)| * (o[i+1] - o[i]) over consecutive pairs."""
    n = F.size(z)
    pairs = F.zip_with(F.slice(z, 1, n - 1), F.slice(z, 2, n - 1),
                       lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    init = F.struct(F.lit(0.0).alias("cp"), F.lit(0.0).alias("cq"), F.lit(0.0).alias("w"))

    def step(acc, pr):
        cp = acc["cp"] + F.try_divide(pr["a"]["p"], sp)
        cq = acc["cq"] + F.try_divide(pr["a"]["q"], sq)
        return F.struct(cp.alias("cp"), cq.alias("cq"),
                        (acc["w"] + F.abs(cp - cq) * (pr["b"]["o"] - pr["a"]["o"])).alias("w"))

    return F.aggregate(pairs, init, step, lambda acc: acc["w"])


def _inputs(p, q, o) -> Column:
    return F.struct(_c(p).cast("array<double>").alias("p"), _c(q).cast("array<double>").alias("q"),
                    _c(o).cast("array<double>").alias("o"))


def emd(p, q, ordinal) -> Column:
    """Ordinal Wasserstein distance, list semantics.

    Sort by (ordinal, p, q); drop options with a negative ordinal (all kept
    when every ordinal is negative); renormalise; sum |CDF gap| times the
    ordinal step; divide by the ordinal range.  NULL when the ordinal is
    constant, a side has no mass, or one ordered option is left.
    """
    def body(inp):
        o = inp["o"]
        z = F.array_sort(F.transform(o, lambda x, i: F.struct(
            x.alias("o"), inp["p"][i].alias("p"), inp["q"][i].alias("q"))))

        def on_sorted(z):
            zf = F.when(F.exists(z, lambda x: x["o"] >= 0),
                        F.filter(z, lambda x: x["o"] >= 0)).otherwise(z)

            def on_filtered(zf):
                st = F.struct(_dsum(zf, "p").alias("sp"), _dsum(zf, "q").alias("sq"),
                              (F.try_element_at(zf, F.lit(-1))["o"]
                               - F.try_element_at(zf, F.lit(1))["o"]).alias("rng"))
                return let(st, lambda s: F.when(
                    (F.array_max(o) != F.array_min(o)) & (F.abs(s["sp"]) > ZERO_TOL)
                    & (F.abs(s["sq"]) > ZERO_TOL) & (s["rng"] != 0),
                    F.try_divide(_cum_distance(zf, s["sp"], s["sq"]), s["rng"])))
            return let(zf, on_filtered)
        return let(z, on_sorted)
    return let(_inputs(p, q, ordinal), body)


def emd_zero(p, q, ordinal) -> Column:
    """Ordinal Wasserstein distance, training semantics.

    Truncate the three arrays to the shortest, normalise first, 0.0 for a
    constant order / no ordered option / zero mass after dropping the
    negative ordinals; stable sort by ordinal.
    """
    def body(inp):
        n = F.least(F.size(inp["p"]), F.size(inp["q"]), F.size(inp["o"]))
        cut = F.struct(F.slice(inp["p"], 1, n).alias("p"), F.slice(inp["q"], 1, n).alias("q"),
                       F.slice(inp["o"], 1, n).alias("o"))

        def on_cut(c):
            sums = F.struct(_dsum(c["p"]).alias("a"), _dsum(c["q"]).alias("b"))

            def on_sums(s):
                z = F.array_sort(F.transform(c["o"], lambda x, i: F.struct(
                    x.alias("o"), i.alias("i"), F.try_divide(c["p"][i], s["a"]).alias("p"),
                    F.try_divide(c["q"][i], s["b"]).alias("q"))))  # (o, index): stable on ties

                def on_z(z):
                    zf = F.filter(z, lambda x: x["o"] >= 0)

                    def on_zf(zf):
                        dropped = F.size(zf) < F.size(z)
                        st = F.struct(F.when(dropped, _dsum(zf, "p")).otherwise(F.lit(1.0)).alias("sp"),
                                      F.when(dropped, _dsum(zf, "q")).otherwise(F.lit(1.0)).alias("sq"),
                                      (F.try_element_at(zf, F.lit(-1))["o"]
                                       - F.try_element_at(zf, F.lit(1))["o"]).alias("rng"),
                                      dropped.alias("dropped"))
                        return let(st, lambda t: (
                            F.when(F.array_max(c["o"]) == F.array_min(c["o"]), F.lit(0.0))
                             .when(F.size(zf) == 0, F.lit(0.0))
                             .when(t["dropped"] & ((t["sp"] == 0) | (t["sq"] == 0)), F.lit(0.0))
                             .otherwise(F.try_divide(_cum_distance(zf, t["sp"], t["sq"]), t["rng"]))))
                    return let(zf, on_zf)
                return let(z, on_z)
            return let(sums, on_sums)
        return let(cut, on_cut)
    return let(_inputs(p, q, ordinal), body)


def kl(p, q) -> Column:
    """Forward KL(p || q) = sum p*ln(p+eps) - sum p*ln(q+eps)."""
    def body(inp):
        terms = F.zip_with(inp["p"], inp["q"], lambda a, b: a * (F.log(a + LOG_EPS) - F.log(b + LOG_EPS)))
        return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)
    return let(F.struct(_c(p).cast("array<double>").alias("p"), _c(q).cast("array<double>").alias("q")), body)


def softmax(logits) -> Column:
    """exp(x - max) / sum, as an array."""
    def body(x):
        return let(F.array_max(x), lambda m: let(
            F.transform(x, lambda v: F.exp(v - m)),
            lambda e: let(_dsum(e), lambda s: _scale(e, s))))
    return let(_c(logits).cast("array<double>"), body)


def uniform_over_valid(ordinal) -> Column:
    """1/k on options with ordinal >= 0, 0 elsewhere; 1/size when none is valid."""
    def body(o):
        k = F.size(F.filter(o, lambda x: x >= 0))
        return F.when(k > 0, F.transform(o, lambda x: F.when(x >= 0, F.lit(1.0) / k).otherwise(F.lit(0.0)))) \
            .otherwise(F.transform(o, lambda x: F.lit(1.0) / F.size(o)))
    return let(ordinal, body)


def entropy_terms(p) -> Column:
    """-sum p*log2(p + 1e-9) over an array of shares."""
    return -F.aggregate(_c(p), F.lit(0.0), lambda acc, x: acc + x * F.log2(x + 1e-9))


def option_softmax(logits, k) -> Column:
    """softmax over the whole vocabulary, gather the first ``k`` option
    tokens (letters A..), renormalise."""
    return normalize(F.slice(softmax(logits), 1, _c(k) if not isinstance(k, int) else F.lit(k)))


def option_probs(logprobs, k) -> Column:
    """per option letter, exp(logprob of "L") + exp(logprob of " L")
    (a missing token counts 0).  Returns the raw probabilities; see
    :func:`normalize` for the renormalised form and ``_dsum`` for the sum."""
    kk = _c(k) if not isinstance(k, int) else F.lit(k)

    def body(m):
        def prob(i):
            letter = F.char(F.lit(64) + i)
            return (F.coalesce(F.exp(F.try_element_at(m, letter)), F.lit(0.0))
                    + F.coalesce(F.exp(F.try_element_at(m, F.concat(F.lit(" "), letter))), F.lit(0.0)))
        return F.transform(F.sequence(F.lit(1), kk), prob)
    return let(logprobs, body)


def array_sum(arr) -> Column:
    return _dsum(_c(arr))


def pad_target(dist, ordinal, n: int = 26, always_renormalize: bool = False):
    """Cut to ``n`` (renormalise only when cut, or always), pad with
    zeros; ordinal cut to ``n`` and padded with its max.  Returns (dist, ordinal)."""
    def on_dist(d):
        def on_cut(cut):
            cut2 = let(_dsum(cut), lambda s: F.when((F.size(d) > n) & (s > 0), _scale(cut, s)).otherwise(cut))
            padded = F.concat(cut2, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(n) - F.size(cut))))
            if not always_renormalize:
                return padded
            return let(padded, lambda pd: let(_dsum(pd), lambda s2: F.when(s2 > 0, _scale(pd, s2)).otherwise(pd)))
        return let(F.slice(d, 1, n), on_cut)

    def on_ord(o):
        def on_cut(oc):
            pad_o = F.coalesce(F.array_max(oc), F.lit(0.0))
            return F.concat(oc, F.array_repeat(pad_o, F.greatest(F.lit(0), F.lit(n) - F.size(oc))))
        return let(F.slice(o, 1, n), on_cut)
    return (let(_c(dist).cast("array<double>"), on_dist),
            let(_c(ordinal).cast("array<double>"), on_ord))


def uniform_over_real(ordinal, k) -> Column:
    """F10 (default): 1/m on the first ``k`` (real) options with ordinal >= 0,
    0 elsewhere; 1/size when none is valid."""
    kk = _c(k) if not isinstance(k, int) else F.lit(k)

    def body(o):
        def valid(x, i):
            return (x >= 0) & (i < kk)
        m = F.size(F.filter(o, valid))
        return let(m, lambda m: F.when(m > 0, F.transform(
            o, lambda x, i: F.when(valid(x, i), F.lit(1.0) / m).otherwise(F.lit(0.0))))
            .otherwise(F.transform(o, lambda x: F.lit(1.0) / F.size(o))))
    return let(ordinal, body)
