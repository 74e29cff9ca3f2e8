"""Golden values and properties of the Column builders."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quorum.functions import metrics as M
from quorum.functions import rng, text


def one(spark, col, schema="x int", rows=((1,),)):
    return spark.createDataFrame(list(rows), schema).select(col.alias("v")).first()["v"]


def arr(xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_emd_golden(spark):
    assert one(spark, M.emd(arr([.1, .5, .4]), arr([.2, .3, .5]), arr([1, 2, 1.5])))== pytest.approx(0.15)
    # the reference's code renormalises after dropping the -1 option: 1/7
    assert one(spark, M.emd(arr([.2, .5, .3]), arr([.3, .4, .3]), arr([1, 2, -1]))) == pytest.approx(1 / 7)


def test_emd_undefined(spark):
    assert one(spark, M.emd(arr([.5, .5]), arr([.2, .8]), arr([1, 1]))) is None
    assert one(spark, M.emd_zero(arr([.5, .5]), arr([.2, .8]), arr([1, 1]))) == 0.0
    assert one(spark, M.emd_zero(arr([.5, .5]), arr([.2, .8]), arr([-1, -1]))) == 0.0
    assert one(spark, M.emd(arr([0, 0]), arr([.2, .8]), arr([1, 2]))) is None


def test_normalize_and_kl(spark):
    assert one(spark, M.normalize(arr([2, 1, 1]))) == pytest.approx([.5, .25, .25])
    assert one(spark, M.normalize(arr([0, 0]))) is None
    assert one(spark, M.kl(arr([.5, .5]), arr([.5, .5]))) == pytest.approx(0.0, abs=1e-12)
    p, q = [.2, .8], [.5, .5]
    exp = sum(a * (math.log(a + 1e-8) - math.log(b + 1e-8)) for a, b in zip(p, q))
    assert one(spark, M.kl(arr(p), arr(q))) == pytest.approx(exp)


def test_softmax(spark):
    v = one(spark, M.softmax(arr([0, math.log(3)])))
    assert v == pytest.approx([.25, .75])


def test_hash_uniform_golden(spark):
    got = [one(spark, rng.hash_uniform(42, i)) for i in range(3)]
    assert got == pytest.approx([0.66052864654921, 0.34786711167544127, 0.46810244559310377])


def test_mcq_golden(spark):
    opts = F.array(F.lit("Yes"), F.lit("No"))
    assert one(spark, text.mcq(F.lit("Q?"), opts, add_answer_forcing=True)) == \
        "Question: Q?\nA. Yes\nB. No\nAnswer as a choice between A.,B.\n\nAnswer:"
    assert one(spark, text.mcq(F.lit("Q?"), opts)) == "Question: Q?\nA. Yes\nB. No\n\nAnswer:"


def test_qa_steering_tail(spark):
    opts = F.array(*[F.lit(x) for x in ("Northeast", "South", "West")])
    s = one(spark, text.steer_qa(F.lit("Where?"), opts, F.lit("South")))
    assert s.endswith("\n\nAnswer: B. South\n\nAnswer the following question keeping in mind your previous answers.\n")


def test_entropy_golden(spark):
    from quorum.operators.entropy import entropy
    cells = spark.createDataFrame([("a", 2), ("a", 2), ("b", 7)], "k string, n long")
    got = {r.k: r.entropy for r in entropy(cells, ["k"]).collect()}
    assert got["a"] == pytest.approx(1.0, abs=1e-8) and got["b"] == pytest.approx(0.0, abs=1e-8)


def test_ami_golden(spark):
    from quorum.operators.relevance import LOG2_E, ami_pairs
    rows = [("same", c, c, 50) for c in ("x", "y")] + [("single", "u", c, 5) for c in "abcd"] + [("both", "u", "u", 9)]
    cont = spark.createDataFrame(rows, "target string, a string, b string, n long").selectExpr("target", "'o' AS other", "a", "b", "n")
    got = {r.target: r.relevance for r in ami_pairs(cont, threshold=0, symmetric=False).collect()}
    assert got["same"] == pytest.approx(LOG2_E) and got["single"] == pytest.approx(0.0, abs=1e-12) and got["both"] == pytest.approx(LOG2_E)


probs = st.lists(st.floats(0.01, 1.0), min_size=2, max_size=8)


@settings(max_examples=15, deadline=None)
@given(probs, st.data())
def test_emd_properties(spark, p, data):
    q = data.draw(st.lists(st.floats(0.01, 1.0), min_size=len(p), max_size=len(p)))
    o = list(range(1, len(p) + 1))
    row = spark.createDataFrame([(p, q, [float(x) for x in o])], "p array<double>, q array<double>, o array<double>")
    r = row.select(M.emd("p", "q", "o").alias("pq"), M.emd("q", "p", "o").alias("qp"),
                   M.emd("p", "p", "o").alias("pp"),
                   M.emd("p", "q", F.transform("o", lambda x: x * 3)).alias("scaled")).first()
    assert r["pp"] == pytest.approx(0.0, abs=1e-12)
    assert r["pq"] == pytest.approx(r["qp"])
    assert 0.0 <= r["pq"] <= 1.0 + 1e-12
    assert r["scaled"] == pytest.approx(r["pq"])


def test_more_than_26_options_raises(spark):
    opts = F.array(*[F.lit(f"o{i}") for i in range(27)])
    with pytest.raises(Exception):
        one(spark, text.mcq(F.lit("Q?"), opts))
    assert one(spark, text.mcq(F.lit("Q?"), F.array(*[F.lit(f"o{i}") for i in range(26)]))).count("\n") == 28


def test_no_order_codes(spark):
    from quorum.operators import codes as C
    cb = spark.createDataFrame([("Q", 1, -2.0, "Don't know"), ("Q", 2, 1.0, "Low"), ("Q", 3, 2.0, "High")],
                               "var string, pos int, code double, label string")
    pol = C.resolve_policy(spark.createDataFrame([("Q", [], None, None, "train")],
                                                 "var string, invalid_codes array<double>, "
                                                 "refusal_codes array<double>, question_text string, split string"),
                           [-8.0], [99.0])
    assert C.build_options(cb, pol).first()["ordinal"] == [1.0, 2.0, 3.0]       # faithful default
    assert C.build_options(cb, pol, [-2.0]).first()["ordinal"] == [-1.0, 2.0, 3.0]


def test_option_probs_adds_both_tokenisations(spark):
    import math as m
    lp = F.create_map(F.lit("A"), F.lit(m.log(0.2)), F.lit(" A"), F.lit(m.log(0.1)), F.lit("B"), F.lit(m.log(0.3)))
    raw = one(spark, M.option_probs(lp, 3))           # C is absent -> 0
    assert raw == pytest.approx([0.3, 0.3, 0.0])
    assert one(spark, M.normalize(M.option_probs(lp, 3))) == pytest.approx([0.5, 0.5, 0.0])


def test_pad_target(spark):
    d, o = M.pad_target(arr([0.5, 0.5]), arr([1, 2]), n=4)
    assert one(spark, d) == pytest.approx([0.5, 0.5, 0.0, 0.0]) and one(spark, o) == [1.0, 2.0, 2.0, 2.0]
    d2, _ = M.pad_target(arr([1, 1, 2]), arr([1, 2, 3]), n=2)   # cut -> renormalised
    assert one(spark, d2) == pytest.approx([0.5, 0.5])


def test_sample_tokens_deterministic(spark):
    from quorum.operators.prompts import sample_tokens
    col = sample_tokens(arr([0.0, 1.0, 0.0]), 42, F.lit("k"), n=20)
    assert one(spark, col) == [" B"] * 20
    mixed = sample_tokens(arr([0.5, 0.5]), 42, F.lit("k"), n=200)
    a, b = one(spark, mixed), one(spark, mixed)
    assert a == b and 60 < a.count(" A") < 140
