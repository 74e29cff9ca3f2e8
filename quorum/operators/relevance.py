"""Question relevance: contingency tables, adjusted mutual information,
pairwise and greedy top-k, near-duplicate questions (J2, J11, A10, A11, P14,
T3, T4, X2).

Counting is Spark's job: each respondent row emits its (target, other)
answer pairs in place (two explodes, no self-join) and a partial aggregation
reduces them to one contingency table per question pair.  Scores are aggregates
too: margins, a histogram of equal margins per pair, and the terms of the
expected mutual information as rows, so that no pair's cells enter one group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorum.functions import rng
from quorum.operators import codes as C
from quorum.operators.joins import bounded_broadcast
from quorum.operators.positions import scan
from quorum.sources.io import kept

NEG_INF = -1e9            # relevance when too few joint answers
N_SAMPLE_THRESHOLD = 100  # joint answers needed for an estimate
LOG2_E = 1.0 / math.log(2.0)
OVERALL = "Overall"


# ------------------------------------------------------------------ counting

def question_pairs(keys: DataFrame, ordered: bool = True) -> DataFrame:
    """(target, qkey) pairs of distinct questions.  The key list is
    metadata-sized, so it is gathered into one row and paired in place."""
    allk = keys.select("qkey").distinct().agg(F.sort_array(F.collect_set("qkey")).alias("_k"))
    p = (allk.select(F.explode("_k").alias("target"), "_k")
             .select("target", F.explode("_k").alias("qkey"))
             .where(F.col("target") != F.col("qkey")))
    return p if ordered else p.where(F.col("target") < F.col("qkey"))


def _answers(wide: DataFrame, questions: Sequence[str]):
    """The answered questions of a row, as an array of (qkey, code)."""
    qa = F.array(*[F.struct(F.lit(q).alias("qkey"), F.col(q).cast("double").alias("code")) for q in questions])
    return F.filter(qa, lambda x: C.answered(x["code"]))


def contingency(wide: DataFrame, targets: Sequence[str], bank: Sequence[str] | None = None) -> DataFrame:
    """``(target, other, a, b, n)`` over respondents who answered both.

    With a ``bank``, every target meets every other question of the bank; with
    one list only, every unordered pair of it (target < other).  A row carries
    its answers once, as two arrays that are exploded one after the other, so
    the plan grows with the number of questions and not with that of pairs;
    the cells are summed before the shuffle."""
    pairs = bank is None
    t = wide.select(_answers(wide, sorted(set(targets))).alias("_t"), _answers(wide, sorted(set(bank or targets))).alias("_b"))
    # explode_outer: explode would repeat its array in a filter below it
    t = t.select(F.explode_outer("_t").alias("t"), "_b").select("t.*", F.explode_outer("_b").alias("o"))
    x = t.where(F.col("qkey") < F.col("o.qkey") if pairs else F.col("qkey") != F.col("o.qkey"))
    return (x.groupBy(F.col("qkey").alias("target"), F.col("o.qkey").alias("other"), F.col("code").alias("a"),
                      F.col("o.code").alias("b")).agg(F.count(F.lit(1)).alias("n")))


def contingency_long(answers: DataFrame, targets: DataFrame, bank: DataFrame, key: str = "human_id") -> DataFrame:
    """A11 on long answers ``(key, qkey, code)``, with targets and bank as
    tables of ``qkey``: one self-join by person, cells summed before the shuffle."""
    a = answers.where(C.answered("code")).select(key, "qkey", F.col("code").cast("double").alias("code"))
    t = a.join(bounded_broadcast(targets.select("qkey").distinct()), "qkey", "left_semi")
    o = (a.join(bounded_broadcast(bank.select("qkey").distinct()), "qkey", "left_semi")
          .select(key, F.col("qkey").alias("other"), F.col("code").alias("b")))
    return (t.join(o, key).where(F.col("qkey") != F.col("other"))
             .groupBy(F.col("qkey").alias("target"), "other", F.col("code").alias("a"), "b").agg(F.count(F.lit(1)).alias("n")))


# ------------------------------------------------------------------ expected mutual information

PAIR = ["target", "other"]
SALTS = 8   # a pair's margins meet in so many tasks
_EXACT = [0.0] + [math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) for n in range(1, 16)]


def stirling_rest(n: Column) -> Column:
    """ln n! less Stirling's (n + 1/2) ln n - n + ln(2 pi) / 2: exact values for
    small n, the asymptotic series from 16 on (its error is below 1e-18)."""
    q = 1.0 / (n * n)
    series = (1 / 12 - q * (1 / 360 - q * (1 / 1260 - q * (1 / 1680 - q / 1188)))) / n
    return F.when(n < 16, F.get(F.array(*[F.lit(x) for x in _EXACT]), n.cast("int"))).otherwise(series)


def _deviance(x: Column, mean: Column) -> Column:
    """x ln(x / mean) + mean - x, without the cancellation of its parts."""
    d = (x - mean) / mean
    return mean * ((1 + d) * F.log1p(d) - d)


def _log_binomial(x: Column, n: Column, b: Column, whole: Column) -> Column:
    """ln of the binomial probability of x among n at the rate b / whole, by
    Stirling rests and deviances, all of the size of the result."""
    rate = b / whole
    inner = (stirling_rest(n) - stirling_rest(x) - stirling_rest(n - x) - _deviance(x, n * rate)
             - _deviance(n - x, n * (1 - rate)) + 0.5 * F.ln(n / (2 * math.pi * x * (n - x))))
    return F.when(n == 0, 0.0).when(x == 0, n * F.log1p(-rate)).when(x == n, n * F.ln(rate)).otherwise(inner)


def log_hypergeometric(x: Column, a: Column, b: Column, n: Column) -> Column:
    """ln of the probability that random sets of a and b among n share x."""
    return F.when(F.least(a, b) == F.greatest(F.lit(0.0), a + b - n), 0.0).otherwise(
        _log_binomial(x, a, b, n) + _log_binomial(b - x, n - a, b, n) - _log_binomial(b, n, b, n))


def margins(cont: DataFrame) -> DataFrame:
    """``(target, other, side, m, c)``: of every pair, how many codes of the
    target (side 0), of the other (1), and how many cells (2) count m."""
    a, b = F.col("a"), F.col("b")
    none = [F.when(F.lit(False), x) for x in (a, b)]
    sides = F.array(F.struct(F.lit(0).alias("side"), a.alias("a"), none[1].alias("b")), F.struct(F.lit(1).alias("side"), none[0].alias("a"), b.alias("b")),
                    F.struct(F.lit(2).alias("side"), a.alias("a"), b.alias("b")))
    sums = (cont.select(*PAIR, "n", F.explode(sides).alias("s")).groupBy(*PAIR, "s.side", "s.a", "s.b").agg(F.sum("n").alias("m")))
    return sums.where("m > 0").groupBy(*PAIR, "side", "m").agg(F.count(F.lit(1)).alias("c"))


def expected_mi(hist: DataFrame) -> DataFrame:
    """``(target, other, emi)``: E[MI] of independent answers with the margins of
    ``hist`` (nats).  Equal margins have equal terms, so a pair has one cell per
    two different margins (at most 2 n of them), dealt over ``SALTS`` tasks; a cell's
    terms run over the overlaps within 9.5 deviations and 30 of the mode, beyond
    which Bernstein's bound leaves less than rounding."""
    total = F.sum(F.when(F.col("side") == 0, F.col("m") * F.col("c"))).alias("n")
    salted = F.pmod(F.xxhash64("m"), F.lit(SALTS)).cast("int").alias("salt")
    x = hist.where("side = 0").select(*PAIR, salted, F.col("m").cast("double").alias("a"), F.col("c").alias("i"))
    y = hist.where("side = 1").select(*PAIR, F.col("m").cast("double").alias("b"), F.col("c").alias("j"),
                                      F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    n = hist.groupBy(*PAIR).agg(total).select(*PAIR, F.col("n").cast("double").alias("n"))
    a, b, n_, k = F.col("a"), F.col("b"), F.col("n"), F.col("x")
    mode = F.floor((a + 1) * (b + 1) / (n_ + 2))
    reach = F.ceil(30 + 9.5 * F.sqrt(a * (b / n_) * (1 - a / n_) * (1 - b / n_)))
    first = F.greatest(F.lit(1.0), a + b - n_, mode - reach).cast("long")
    last = F.least(a, b, mode + reach).cast("long")
    cells = x.join(y, [*PAIR, "salt"]).join(bounded_broadcast(n), PAIR)
    terms = (cells.select(*PAIR, "a", "b", "n", (F.col("i") * F.col("j")).alias("ij"), first.alias("first"), last.alias("last"))
             .where("first <= last").select("*", F.explode(F.sequence("first", "last")).alias("x")).withColumn("x", k.cast("double")))
    value = F.col("ij") * (k / n_) * F.ln(n_ * k / (a * b)) * F.exp(log_hypergeometric(k, a, b, n_))
    return terms.groupBy(*PAIR).agg(F.sum(value).alias("emi"))


def ami_pairs(cont: DataFrame, threshold: int = N_SAMPLE_THRESHOLD, symmetric: bool = True) -> DataFrame:
    """A10: relevance = max(AMI * log2(e), 0) per question pair (AMI with the
    arithmetic mean of the entropies); NEG_INF with fewer than ``threshold``
    joint answers.  With ``symmetric`` both orders are emitted from one score."""
    hist = kept(margins(cont), "margins")
    m, c, side = F.col("m").cast("double"), F.col("c"), F.col("side")

    def over(k: int, x: Column) -> Column:
        return F.sum(F.when(side == k, x))
    facts = hist.groupBy(*PAIR).agg(over(0, F.col("m") * c).alias("n_joint"), over(0, c).alias("ka"), over(1, c).alias("kb"),
                                    *[over(k, c * m * F.ln(m)).alias(f"s{k}") for k in range(3)])
    n = F.col("n_joint").cast("double")
    single = (F.col("ka") == 1) | (F.col("kb") == 1)
    mi = F.when(single, 0.0).otherwise(F.greatest((F.col("s2") - F.col("s0") - F.col("s1")) / n + F.ln(n), F.lit(0.0)))
    h = [F.when(F.col(k) == 1, 0.0).otherwise(F.ln(n) - F.col(s) / n) for k, s in (("ka", "s0"), ("kb", "s1"))]
    emi = F.when(single, 0.0).otherwise(F.coalesce("emi", F.lit(0.0)))
    eps = F.lit(2.0 ** -52)
    gap = 0.5 * (h[0] + h[1]) - emi
    ami = (mi - emi) / F.when(gap < 0, F.least(gap, -eps)).otherwise(F.greatest(gap, eps))
    score = F.when((F.col("ka") == 1) & (F.col("kb") == 1), 1.0).otherwise(ami)
    scores = facts.join(expected_mi(hist), PAIR, "left").select(
        *PAIR, "n_joint", F.when(F.col("n_joint") < threshold, NEG_INF).otherwise(F.greatest(score * LOG2_E, F.lit(0.0))).alias("relevance"))
    orders = [F.struct(F.col("target").alias("target"), F.col("other").alias("qkey"))]
    if symmetric:
        orders.append(F.struct(F.col("other").alias("target"), F.col("target").alias("qkey")))
    return scores.select(F.explode(F.array(*orders)).alias("p"), "n_joint", "relevance").select("p.target", "p.qkey", "n_joint", "relevance")


def pairwise_relevance(wide: DataFrame, targets: Sequence[str], bank: Sequence[str],
                       strategy: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Relevance of every bank question for every target.  ``strategy``
    turns a contingency table into ``(target, qkey, n_joint, relevance)``;
    the default is adjusted mutual information."""
    return (strategy or (lambda c: ami_pairs(c, symmetric=False)))(contingency(wide, targets, bank))


def topk_pairwise(rel: DataFrame, k: int) -> DataFrame:
    """Per target the k most relevant questions with relevance >= 0
    (k < 0 = all); ``rank`` 1 = most relevant."""
    w = Window.partitionBy("target").orderBy(F.col("relevance").desc(), F.col("qkey"))
    r = rel.where(F.col("relevance") >= 0).withColumn("rank", F.row_number().over(w))
    return r if k < 0 else r.where(F.col("rank") <= k)


def topk_greedy(wide: DataFrame, target: str, bank: Sequence[str], k: int,
                threshold: int = N_SAMPLE_THRESHOLD,
                relevance: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """T4: add, k times, the bank question whose joint code with the chosen
    set gains the most relevance; stop with an error when no gain is left.

    The distinct answer combinations are written once, with a code of the chosen
    set's answers: one integer, which every round refines by the question that it
    adds (numbers of the distinct pairs of old code and answer).  Each round is one
    job that scores every remaining candidate at once; the chosen set is a
    handful of names kept on the driver."""
    bank = [q for q in dict.fromkeys(bank) if q != target]
    cols = [F.col(q).cast("double").alias(q) for q in [target, *bank]]
    # one row per combination of answers; the rounds read this table and never the answers again
    tuples = kept(wide.where(C.answered(target)).select(*cols).groupBy(target, *bank).agg(F.count(F.lit(1)).alias("_n"))
                  .withColumn("_set", F.lit(0).cast("long")), "combinations")
    chosen: list[str] = []
    gains: list[float] = []
    current = 0.0
    spark = wide.sparkSession
    for step in range(k):
        cands = [q for q in bank if q not in chosen]
        if not cands:
            break
        x = tuples.select(F.col(target).alias("a"), "_set", F.explode(_answers(tuples, cands)).alias("c"), "_n")
        cont = (x.groupBy(F.lit(target).alias("target"), F.col("c.qkey").alias("other"), "a", F.struct("_set", "c.code").alias("b"))
                 .agg(F.sum("_n").alias("n")))
        scores = (relevance or (lambda c: ami_pairs(c, threshold, symmetric=False)))(cont)
        best = scores.orderBy(F.col("relevance").desc(), F.col("qkey")).first()  # one row per round
        gain = best["relevance"] - current if best is not None else 0.0
        if not gain > 0:
            raise ValueError("No more gain in relevance.")
        chosen.append(best["qkey"])
        gains.append(gain)
        current += gain
        if step < k - 1:
            tuples = refined(tuples.where(C.answered(chosen[-1])), chosen[-1])
    rows = [(target, q, i + 1, g) for i, (q, g) in enumerate(zip(chosen, gains))]
    return spark.createDataFrame(rows, "target string, qkey string, step int, gain double")


def refined(tuples: DataFrame, question: str) -> DataFrame:
    """``tuples`` with the code ``_set`` refined by the answers to ``question``:
    dense numbers of the distinct (code, answer), written."""
    pairs = scan(tuples.select("_set", question).distinct(), ["_set", question], name="_new").rows
    pairs = pairs.select(F.col("_set").alias("_old"), F.col(question).alias("_answer"), "_new")
    both = (F.col("_set") == F.col("_old")) & (F.col(question) == F.col("_answer"))
    return kept(tuples.join(bounded_broadcast(pairs), both).withColumn("_set", F.col("_new")).drop("_old", "_answer", "_new"), "combinations")


# ------------------------------------------------------------------ X2: a memo of pair scores

SCORES = "target string, qkey string, n_joint long, relevance double, attribute string, trait string, bucket int"
BUCKETS = 16


def contingency_of_pairs(answers: DataFrame, pairs: DataFrame, key: str = "human_id") -> DataFrame:
    """A11 for listed pairs ``(target, qkey)`` of long answers: a person's answers to
    listed questions are gathered once and people with equal answers counted; the
    answers of each such sheet meet in place, so pairs of answers are never shuffled
    but summed."""
    own, code = F.struct("qkey", F.col("code").cast("double").alias("code")), C.answered("code")
    wanted = bounded_broadcast(pairs.select("target", F.col("qkey").alias("other")))
    listed = pairs.select(F.explode(F.array("target", "qkey")).alias("qkey")).distinct()
    sheets = (answers.where(code & F.col(key).isNotNull()).join(bounded_broadcast(listed), "qkey", "left_semi")
              .groupBy(key).agg(F.array_sort(F.collect_list(own)).alias("_all")).groupBy("_all").agg(F.count(F.lit(1)).alias("_n")))
    met = sheets.select(F.explode_outer("_all").alias("_t"), "_all", "_n").select("_t", F.explode_outer("_all").alias("_o"), "_n")
    met = met.select(F.col("_t.qkey").alias("target"), F.col("_o.qkey").alias("other"), F.col("_t.code").alias("a"), F.col("_o.code").alias("b"), "_n")
    return met.join(wanted, ["target", "other"]).groupBy("target", "other", "a", "b").agg(F.sum("_n").alias("n"))


def remembered_relevance(path: str, answers: DataFrame, pairs: DataFrame, attribute: str = OVERALL, trait: str = OVERALL,
                         strategy: Callable[[DataFrame], DataFrame] | None = None, key: str = "human_id") -> DataFrame:
    """``(target, qkey, n_joint, relevance)`` of the pairs within a
    sub-population (``trait`` in the column ``attribute`` of the answers), from a
    table of scores at ``path`` that later calls share.

    Only pairs that it does not hold for this sub-population are scored; they
    are added by overwriting the partitions (attribute, trait, bucket of the target) that
    they fall into, and no others.  A pair without joint answers is remembered, too."""
    from quorum.sources.io import path_exists
    spark = pairs.sparkSession
    here = (F.col("attribute") == attribute) & (F.col("trait") == trait)

    def read():
        table = spark.read.schema(SCORES).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], SCORES)
        return table.where(here)
    wanted = pairs.select("target", "qkey").distinct()
    missing = kept(wanted.join(read().select("target", "qkey"), ["target", "qkey"], "left_anti"), "missing")
    if not missing.isEmpty():
        people = answers if attribute == OVERALL else answers.where(F.col(attribute) == trait)
        scored = (strategy or (lambda c: ami_pairs(c, symmetric=False)))(contingency_of_pairs(people, missing, key))
        new = (missing.join(scored, ["target", "qkey"], "left").fillna({"n_joint": 0, "relevance": NEG_INF})
               .select("target", "qkey", "n_joint", "relevance", F.lit(attribute).alias("attribute"), F.lit(trait).alias("trait"),
                       F.pmod(F.xxhash64("target"), F.lit(BUCKETS)).cast("int").alias("bucket")))
        new = kept(new, "scores")
        touched = F.broadcast(new.select("bucket").distinct())  # at most BUCKETS rows
        rows = kept(read().join(touched, "bucket", "left_semi").unionByName(new), "scores")  # the partitions are read before they go
        (rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("attribute", "trait", "bucket").parquet(path))
    return read().join(wanted, ["target", "qkey"], "left_semi").select("target", "qkey", "n_joint", "relevance")


# ------------------------------------------------------------------ P14: near-duplicate questions

def independent_set(vertices: DataFrame, edges: DataFrame, seed: int = 42, key: str = "qkey") -> DataFrame:
    """The maximal independent set that a walk in hash order of the keys would
    find, by rounds: a vertex whose hash is least among its undecided neighbours
    stays, and its neighbours go.  A handful of rounds in expectation (each halves the
    edges), each written.  ``edges`` are (a, b), in either order."""
    order = rng.hash_order(seed, F.col(key))
    left = kept(vertices.select(key, order.alias("_o")).distinct(), "vertices")
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    named = left.select(F.col(key).alias("b"), F.col("_o").alias("_ob"))
    open_edges = kept(both.join(left.select(F.col(key).alias("a"), F.col("_o").alias("_oa")), "a").join(named, "b"), "edges")
    stay = None
    while True:
        beaten = open_edges.where((F.col("_ob") < F.col("_oa")) | ((F.col("_ob") == F.col("_oa")) & (F.col("b") < F.col("a")))).select(F.col("a").alias(key))
        chosen = kept(left.join(beaten.distinct(), key, "left_anti"), "chosen")
        stay = chosen if stay is None else stay.union(chosen)
        gone = open_edges.join(chosen.select(F.col(key).alias("a")), "a", "left_semi").select(F.col("b").alias(key))
        left = kept(left.join(chosen.select(key).union(gone).distinct(), key, "left_anti"), "vertices")
        if left.isEmpty():
            return stay.select(key)
        alive = left.select(key)
        open_edges = kept(open_edges.join(alive.select(F.col(key).alias("a")), "a", "left_semi")
                          .join(alive.select(F.col(key).alias("b")), "b", "left_semi"), "edges")


def near_duplicates(relevance: DataFrame, threshold: float, seed: int = 42) -> DataFrame:
    """P14 list ``(qkey)``: the questions to leave out so that no two of the
    others are ``threshold`` relevant for each other."""
    questions = relevance.select("qkey").union(relevance.select("target")).distinct()
    edges = relevance.where(F.col("relevance") >= threshold).select(F.col("target").alias("a"), F.col("qkey").alias("b"))
    return questions.join(independent_set(questions, edges, seed), "qkey", "left_anti")
