"""Relevance of many questions, and exact expected mutual information."""
import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

from pyspark.sql import functions as F

from quorum.operators import relevance as RL


def brute_emi(a, b, n):
    total = 0.0
    for x in a:
        for y in b:
            for k in range(max(1, x + y - n), min(x, y) + 1):
                big, small = max(x, y), min(x, y)
                p = float(Fraction(math.comb(big, k) * math.comb(n - big, small - k), math.comb(n, small)))
                total += k / n * math.log(n * k / (x * y)) * p
    return total


def table(spark, margins):
    """A histogram of margins for (target, other, a margins, b margins)."""
    rows = [(t, o, side, m, n) for t, o, *sides in margins for side, xs in enumerate(sides) for m, n in Counter(xs).items()]
    return spark.createDataFrame(rows, "target string, other string, side int, m long, c long")


def test_expected_mi_sums_all_terms(spark):
    rng, pairs, want = random.Random(2), [], {}
    for k in range(40):
        a = [rng.randint(1, 60) for _ in range(rng.randint(2, 5))]
        n = sum(a)
        cut = sorted(rng.sample(range(1, n), min(3, n - 1)))
        b = [y - x for x, y in zip([0, *cut], [*cut, n])]
        pairs.append((f"t{k}", "o", a, b))
        want[f"t{k}"] = brute_emi(a, b, n)
    rare = [24] * 30 + [1_000_000 - 720]
    pairs.append(("rare", "o", rare, rare))
    got = {r.target: r.emi for r in RL.expected_mi(table(spark, pairs)).collect()}
    for k, value in want.items():
        assert abs(got[k] - value) <= 1e-11 * max(1.0, abs(value))
    # the overlap of the two large margins, from the complements: it misses n - a of n, and so on
    n, big = 1_000_000, 1_000_000 - 720
    both = sum(float(Fraction(math.comb(720, k) * math.comb(n - 720, 720 - k), math.comb(n, 720)))
               * (n - 1440 + k) / n * math.log(n * (n - 1440 + k) / (big * big)) for k in range(0, 60))
    small = 900 * brute_emi([24], [24], n) + 60 * brute_emi([24], [big], n)
    assert abs(got["rare"] - (small + both)) <= 1e-9 * abs(small + both)


def test_hypergeometric_probabilities(spark):
    def exact(x, a, b, n):
        if n < 10**6:
            return math.log(math.comb(a, x) * math.comb(n - a, b - x)) - math.log(math.comb(n, b))
        out = Fraction(math.comb(a, x))                                  # few of a: falling factorials
        for i in range(x):
            out *= Fraction(b - i, n - i)
        for i in range(a - x):
            out *= Fraction(n - b - i, n - x - i)
        return math.log(out.numerator) - math.log(out.denominator)
    cases = [(x, a, b, n) for a, b, n in [(5, 7, 20), (1, 1, 2), (300, 20, 1000), (50_000, 40_000, 100_000), (3, 10**9, 10**10)]
             for x in sorted({max(0, a + b - n), min(a, b), a * b // n, a * b // n + 1}) if max(0, a + b - n) <= x <= min(a, b)]
    df = spark.createDataFrame([tuple(map(float, c)) for c in cases], "x double, a double, b double, n double")
    got = {(r.x, r.a, r.b, r.n): r.p for r in df.select("*", RL.log_hypergeometric(*map(F.col, "xabn")).alias("p")).collect()}
    for c in cases:
        assert abs(got[tuple(map(float, c))] - exact(*c)) <= 1e-10 * max(1.0, abs(exact(*c)))


def test_many_codes_are_spread(spark):
    """A pair with 20,000 codes a side: no Python, and its margins meet in several tasks."""
    answers = spark.range(0, 200_000, 1, 8).select(F.lit("t").alias("target"), F.lit("o").alias("other"), (F.col("id") % 20_000).alias("a"),
                                                   F.pmod(F.xxhash64("id"), F.lit(20_000)).alias("b"), F.lit(1).alias("n"))
    cont = answers.groupBy("target", "other", "a", "b").agg(F.sum("n").alias("n"))
    scores = RL.ami_pairs(cont, symmetric=False)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    r = scores.first()
    assert r.n_joint == 200_000 and 0 <= r.relevance < 0.02
    hist = RL.margins(cont)
    x = hist.where("side = 1").select(F.countDistinct("m")).first()[0]
    assert x > 10  # several margins


def test_refined_codes_are_dense(spark):
    df = spark.createDataFrame([(0, 1.0, 5), (0, 2.0, 6), (1, 1.0, 7), (1, 1.0, 8)], "_set long, q double, v int")
    got = sorted((r._set, r.v) for r in RL.refined(df, "q").collect())
    assert got == [(0, 5), (1, 6), (2, 7), (2, 8)]


def test_remembered_relevance(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, q, float(rng.randint(1, 3)), rng.choice(["x", "y"])) for i in range(300) for q in "abcd"]
    answers = spark.createDataFrame(rows, "human_id long, qkey string, code double, grp string")
    path, calls = str(tmp_path / "scores"), []

    def strategy(cont):
        calls.append(cont.select("target", "other").distinct().count())
        return RL.ami_pairs(cont, symmetric=False)
    pairs = RL.question_pairs(answers)
    first = RL.remembered_relevance(path, answers, pairs.where("target = 'a'"), strategy=strategy)
    assert first.count() == 3 and calls == [3]
    every = RL.remembered_relevance(path, answers, pairs, strategy=strategy)
    assert every.count() == 12 and calls == [3, 9]
    assert RL.remembered_relevance(path, answers, pairs.where("qkey = 'b'"), strategy=strategy).count() == 3 and calls == [3, 9]
    own = {(r.target, r.qkey): r.n_joint for r in RL.remembered_relevance(path, answers, pairs, "grp", "x", strategy).collect()}
    assert calls == [3, 9, 12] and len(own) == 12 and max(own.values()) < 300     # sub-populations share no entries
    again = {(r.target, r.qkey): r.n_joint for r in RL.remembered_relevance(path, answers, pairs, strategy=strategy).collect()}
    assert set(again.values()) == {300} and calls == [3, 9, 12]
    lone = spark.createDataFrame([("a", "none")], "target string, qkey string")
    assert RL.remembered_relevance(path, answers, lone, strategy=strategy).first().relevance == RL.NEG_INF
    assert RL.remembered_relevance(path, answers, lone, strategy=strategy).count() == 1 and len(calls) == 4


def test_independent_set_is_the_greedy_one(spark):
    rng = random.Random(3)
    names = [f"q{i}" for i in range(60)]
    edges = {tuple(sorted(rng.sample(names, 2))) for _ in range(120)} | {(names[i], names[i + 1]) for i in range(20)}
    near = {n: set() for n in names}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    stay = set()
    for n in sorted(names, key=lambda n: hashlib.md5(f"42:{n}".encode()).hexdigest()):
        if not near[n] & stay:
            stay.add(n)
    got = RL.independent_set(spark.createDataFrame([(n,) for n in names], "qkey string"), spark.createDataFrame(list(edges), "a string, b string"))
    assert sorted(r.qkey for r in got.collect()) == sorted(stay)
    rel = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.2), ("c", "d", 0.9)], "target string, qkey string, relevance double")
    assert RL.near_duplicates(rel, 0.5).count() == 2


def test_many_questions(spark):
    rng = random.Random(4)
    names = [f"q{i:03d}" for i in range(200)]
    data = [[float(rng.randint(1, 3)) if rng.random() < 0.9 else None for _ in names] for _ in range(12)]
    wide = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "human_id long, " + ", ".join(f"{q} double" for q in names))
    want = {}
    for row in data:
        for t in range(3):
            for o in range(200):
                if o != t and row[t] is not None and row[o] is not None:
                    key = (names[t], names[o], row[t], row[o])
                    want[key] = want.get(key, 0) + 1
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        got = {(r.target, r.other, r.a, r.b): r.n for r in RL.contingency(wide, names[:3], names).collect()}
        assert got == want
        assert RL.contingency(wide, names).groupBy("target").count().count() == 199
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    long = spark.createDataFrame([(i, q, v) for i, r in enumerate(data) for q, v in zip(names, r)], "human_id long, qkey string, code double")
    keys = spark.createDataFrame([(q,) for q in names], "qkey string")
    again = {(r.target, r.other, r.a, r.b): r.n for r in RL.contingency_long(long, keys.limit(3), keys).collect()}
    assert again == want


def test_strategy_parameter(spark):
    wide = spark.createDataFrame([(1.0, 1.0, 2.0), (2.0, 2.0, 1.0), (1.0, None, 1.0)], "a double, b double, c double")

    def joint(cont):
        from pyspark.sql import functions as F
        return (cont.groupBy("target", "other").agg(F.sum("n").alias("n_joint"))
                .select("target", F.col("other").alias("qkey"), "n_joint", F.col("n_joint").cast("double").alias("relevance")))
    got = {(r.target, r.qkey): r.relevance for r in RL.pairwise_relevance(wide, ["a"], ["a", "b", "c"], joint).collect()}
    assert got == {("a", "b"): 2.0, ("a", "c"): 3.0}


def test_pairs_of_a_person_meet_without_a_join_of_answers(spark):
    """Repeated answers count each with each, NULL persons and NULL answers not; answers are shuffled once."""
    rng = random.Random(6)
    rows = [(rng.choice([None, *range(12)]), rng.choice("abcd"), rng.choice([None, 1.0, 2.0, 3.0])) for _ in range(300)]
    listed = [("a", "b"), ("b", "a"), ("c", "c"), ("a", "d"), ("d", "none"), ("none", "a")]
    answers = spark.createDataFrame(rows, "human_id long, qkey string, code double")
    pairs = spark.createDataFrame(listed, "target string, qkey string")
    out = RL.contingency_of_pairs(answers, pairs)
    want = {}
    for h, q, v in rows:
        for g, o, w in rows:
            if h is not None and h == g and v is not None and w is not None and (q, o) in listed:
                want[q, o, v, w] = want.get((q, o, v, w), 0) + 1
    assert {(r.target, r.other, r.a, r.b): r.n for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("human_id") and not any("human_id" in line for line in plan.splitlines() if "Join Inner" in line)
