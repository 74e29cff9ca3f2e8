"""Predicates, codes and groups on inline fixtures."""

import pytest
from pyspark.sql import functions as F

from quorum.operators import codes as C
from quorum.operators import distribution as D
from quorum.operators import groups as G
from quorum.operators import prompts as P


def test_wave_number_and_filter(spark):
    keys = spark.createDataFrame([("A_W26",), ("partyln_W3",), ("B_W5",), ("C_W2",), ("C_W26x_W7",)], "qkey string")
    err = spark.createDataFrame([("C_W2",)], "qkey string")
    got = sorted(r[0] for r in C.filter_qkeys(keys, err).collect())
    assert got == ["B_W5", "C_W26x_W7"]  # wave 26 prohibited, prefix prohibited, error key removed
    w = {r[0]: r[1] for r in keys.select("qkey", C.wave_number("qkey")).collect()}
    assert w["C_W26x_W7"] == 7 and w["B_W5"] == 5


def test_coerce_and_status(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,), ("NaN",), ("99",), ("-8",)], "s string")
    vals = [r[0] for r in df.select(C.coerce_numeric(F.col("s"))).collect()]
    assert vals[0] == 1.0 and vals[1] is None and vals[2] is None and vals[3] is None
    st = df.select(C.code_status(C.coerce_numeric(F.col("s")), F.array(F.lit(99.0)), F.array(F.lit(-8.0), F.lit(99.0))))
    assert [r[0] for r in st.collect()] == ["valid", "missing", "missing", "missing", "refused", "invalid"]


def test_weight_policies(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (-1.0,), (None,), (float("nan"),), (float("inf"),)], "w double")
    cgss = [r[0] for r in df.select(C.weight_ok("w", "cgss")).collect()]
    assert cgss == [True, False, False, False, False, False]
    atp = [r[0] for r in df.select(C.weight_value("w", "atp")).collect()]
    assert atp[:5] == [1.0, 0.0, -1.0, 0.0, 0.0]


def test_subpop_filter_arity(spark):
    codes = {("A", "x"): ["1"], ("B", "y"): ["2", "3"]}
    with pytest.raises(TypeError):
        G.subpop_filter({"A": "a"}, codes, "A", ["x"])
    with pytest.raises(ValueError):
        G.subpop_filter({"A": "a"}, codes, ["A"], ["x", "y"])
    with pytest.raises(KeyError):
        G.subpop_filter({"A": "a"}, codes, "A", "nope")
    df = spark.createDataFrame([(1, 1, 2), (2, 1, 4), (3, 2, 3)], "id int, a int, b int")
    pred = G.subpop_filter({"A": "a", "B": "b"}, codes, ["A", "B"], ["x", "y"])
    assert [r[0] for r in df.where(pred).collect()] == [1]
    assert df.where(G.subpop_filter({}, codes, "Overall", "Overall")).count() == 3


def test_overlapping_membership(spark):
    # one person in two race-like groups, one in none
    df = spark.createDataFrame([(1, "r1"), (2, "r2"), (3, "zz")], "id int, race string")
    groups = spark.createDataFrame([("RACE", "G1", "r1"), ("RACE", "G1", "r2"), ("RACE", "G2", "r2")],
                                   "attribute string, grp string, code string")
    m = D.membership(df, {"RACE": "race"}, groups, overall=True)
    got = sorted((r["id"], r["attribute"], r["grp"]) for r in m.collect())
    assert (2, "RACE", "G1") in got and (2, "RACE", "G2") in got
    assert [g for g in got if g[0] == 3] == [(3, "Overall", "Overall")]


def test_convert_traits(spark):
    cb = spark.createDataFrame([("V", 1, 1.0, "Northeast"), ("V", 2, 2.0, "North Central"), ("V", 3, 3.0, "South")],
                               "var string, pos int, code double, label string")
    tr = spark.createDataFrame([("REG", "V", "north", "prefix"), ("REG", "V", "south|northeast", "list")],
                               "attribute string, var string, trait string, mode string")
    got = sorted((r["trait"], r["code"]) for r in G.convert_traits(tr, cb).collect())
    assert got == [("north", 1.0), ("south|northeast", 1.0), ("south|northeast", 3.0)]


def test_split_questions(spark):
    keys = spark.createDataFrame([(f"Q{i}_W{1 + i % 3}",) for i in range(20)], "qkey string")
    s = {r["qkey"]: r["split"] for r in P.split_questions(keys, 0.7, 0.2, 0.1, test_waves=[3]).collect()}
    assert len(s) == 20
    assert all(v == "test" for k, v in s.items() if k.endswith("_W3"))
    rest = [v for k, v in s.items() if not k.endswith("_W3")]
    n = len(rest)
    assert rest.count("train") == round(0.7 * n) and rest.count("val") == round(0.2 * n)
    with pytest.raises(ValueError):
        P.split_questions(keys, 0.5, 0.2, 0.2)


def test_questions_for_split_legacy(spark):
    pol = spark.createDataFrame([("a", "eval"), ("__REPLACE_x", "train")], "var string, split string")
    legacy = spark.createDataFrame([("l1",), ("l2",)], "var string")
    train = sorted(r["var"] for r in C.questions_for_split(pol, "train", legacy).collect())
    assert train == ["l1", "l2"]  # no train question configured -> legacy list
    assert [r["var"] for r in C.questions_for_split(pol, "eval", legacy).collect()] == ["a"]
    assert [r["var"] for r in C.questions_for_split(pol, "all", legacy).collect()] == ["a"]
    with pytest.raises(ValueError):
        C.questions_for_split(pol, "bogus")
