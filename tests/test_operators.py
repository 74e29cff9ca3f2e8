"""Operators on small inline fixtures (edge rows of the blueprint)."""

import pytest
from pyspark.sql import functions as F

from quorum.operators import distribution as D
from quorum.operators import sequences as S


def test_packing_counts(spark):
    for total, chunks in ((10, 1), (11, 2), (5, 0)):
        toks = [str(i) for i in range(total)]
        # split over three rows of uneven length, order kept
        rows = [(0, toks[:3]), (1, toks[3:4]), (2, toks[4:])]
        df = spark.createDataFrame(rows, "id long, tokens array<string>")
        out = S.pack_sequences(df, "tokens", ["id"], 5).orderBy("chunk").collect()
        assert len(out) == chunks
        flat = [t for r in out for t in r["tokens"]]
        assert flat == toks[:5 * chunks]


def test_global_row_index_dense(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k"))
    idx = S.global_row_index(df, ["k"]).orderBy("k").collect()
    assert [r["row_idx"] for r in idx] == list(range(1000))


def test_cgss_distribution_edges(spark):
    # answers: NULL, NaN, refusal (99), invalid (-8), unlabelled (7), bad weights
    resp = spark.createDataFrame([
        (1, "Q_W1", "Q", 1.0, 1.0, "a"), (2, "Q_W1", "Q", 2.0, 3.0, "a"),
        (3, "Q_W1", "Q", None, 1.0, "a"), (4, "Q_W1", "Q", float("nan"), 1.0, "a"),
        (5, "Q_W1", "Q", 99.0, 1.0, "a"), (6, "Q_W1", "Q", -8.0, 1.0, "a"),
        (7, "Q_W1", "Q", 7.0, 1.0, "a"), (8, "Q_W1", "Q", 1.0, 0.0, "a"),
        (9, "Q_W1", "Q", 1.0, None, "b"), (10, "Q_W1", "Q", 99.0, 2.0, "c"),
    ], "human_id long, qkey string, var string, code double, weight double, g string")
    codebook = spark.createDataFrame([("Q", 1, 1.0, " Yes "), ("Q", 2, 2.0, "No"), ("Q", 3, 99.0, "Refused")],
                                     "var string, pos int, code double, label string")
    policy = spark.createDataFrame([("Q", [], None, None, "train")],
                                   "var string, invalid_codes array<double>, refusal_codes array<double>, "
                                   "question_text string, split string")
    variables = spark.createDataFrame([("Q", "Do you agree?")], "var string, label string")
    groups = spark.createDataFrame([("G", "A", "a"), ("G", "B", "b"), ("G", "C", "c")],
                                   "attribute string, grp string, code string")
    d = D.distribution_cgss(resp, codebook, policy, variables, groups, {"G": "g"},
                            [-8.0, 0.0], [98.0, 99.0], with_report=True)
    rows = {(r["attribute"], r["grp"]): r for r in d.collect()}
    a = rows[("G", "A")]
    assert a["options"] == ["Yes", "No"] and a["ordinal"] == [1.0, 2.0]
    assert a["responses"] == pytest.approx([0.25, 0.75])
    assert a["refusal_rate"] == pytest.approx(1 / 5)
    assert ("G", "B") not in rows                 # only a NULL weight: nothing counted
    assert rows[("G", "C")]["skip_reason"] == "all_refused"
    assert rows[("Overall", "Overall")]["refusal_rate"] == pytest.approx(3 / 7)
