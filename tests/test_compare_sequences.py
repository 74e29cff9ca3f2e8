"""Comparison, sequence and relevance operators on inline fixtures."""

import pytest
from pyspark.sql import functions as F

from quorum.operators import compare as CP
from quorum.operators import relevance as RL
from quorum.operators import sequences as S


def test_paired_join_and_summary(spark):
    b = spark.createDataFrame([(0, 1.0, 0.5, 1.0), (1, 2.0, 0.4, 2.0)], "row_idx long, kl double, wd double, loss double")
    f = spark.createDataFrame([(0, 0.5, 0.6, 0.5), (1, 2.5, 0.2, 2.5)], "row_idx long, kl double, wd double, loss double")
    s = CP.paired_summary(CP.paired_join(b, f)).first()
    assert s["rows"] == 2 and s["kl_delta_mean"] == pytest.approx(0.0)
    assert s["kl_improved_pct"] == pytest.approx(50.0) and s["wd_improved_pct"] == pytest.approx(50.0)
    with pytest.raises(ValueError):
        CP.paired_join(b, f.where("row_idx = 0"))


def test_eval_batch_mean_zero_rule(spark):
    rows = [(0, 1.0, 0.0), (1, 3.0, 0.4), (2, 2.0, 0.0), (3, 2.0, 0.0)]
    m = CP.eval_batch_mean(spark.createDataFrame(rows, "row_idx long, kl double, wd double"), 2).first()
    # batch 0: WD mean over non-zero rows = 0.4; batch 1: all zero -> plain mean 0
    assert m["mean_wd"] == pytest.approx(0.2) and m["mean_kl"] == pytest.approx(2.0)


def test_hist_and_run_matrix(spark):
    df = spark.createDataFrame([(float(i),) for i in range(41)], "x double")
    h = {r["bin"]: r["n"] for r in CP.hist_bins(df, ["x"], 40).collect()}
    assert sum(h.values()) == 41 and h[39] == 2 and max(h) == 39
    m = spark.createDataFrame([("m", "QA", "baseline", 1.0, 0.2), ("m", "QA", "ft", 0.5, 0.1)],
                              "model string, prompt string, run string, kl double, wd double")
    r = CP.run_matrix(m).first()
    assert r["delta_kl_ft_minus_baseline"] == pytest.approx(-0.5) and r["delta_wd_ft_minus_baseline"] == pytest.approx(-0.1)


def test_dedupe_and_series(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, o int, v string")
    got = sorted((r["k"], r["v"]) for r in CP.dedupe_first(df, ["k"], ["o"]).collect())
    assert got == [("a", "y"), ("b", "z")]
    s = spark.createDataFrame([(1, i, l) for i, l in enumerate([3.0, 2.0, 2.5, 1.0], start=1)],
                              "run int, step int, loss double")
    b = {r["step"]: (r["best_before"], r["is_best"]) for r in CP.running_best(s).collect()}
    assert b[1] == (None, True) and b[2] == (3.0, True) and b[3] == (2.0, False) and b[4] == (2.0, True)
    assert sorted(r["step"] for r in CP.step_cap(s, 2).collect()) == [1, 2]


def test_left_pad_and_label_mask(spark):
    df = spark.createDataFrame([(0, [1, 2, 3], 3), (0, [4], 1)], "batch long, ids array<int>, target int")
    rows = {len(r["input_ids"]) - r["pad_len"]: r for r in S.left_pad(df, "ids", "target").collect()}
    short = rows[1]
    assert short["input_ids"] == [0, 0, 4] and short["attention_mask"] == [0, 0, 1]
    assert short["target_token_position"] == 3
    ids, labels, mask = S.label_mask(F.array(F.lit(7), F.lit(8)), F.array(F.lit(9)))
    r = spark.range(1).select(ids.alias("i"), labels.alias("l"), mask.alias("m")).first()
    assert r["i"] == [7, 8, 9] and r["l"] == [-100, -100, 9] and r["m"] == [1, 1, 1]


def test_length_batches_and_stripes(spark):
    df = spark.createDataFrame([(i, (i * 7) % 5) for i in range(10)], "id long, n int")
    b = S.length_batches(df, "n", "id", 3, drop_last=True)
    assert b.count() == 9 and b.select("batch").distinct().count() == 3
    full = S.length_batches(df, "n", "id", 3, drop_last=False)
    st = S.batch_stripes(full, 2).collect()  # 4 batches -> 2 per replica
    assert {r["replica"] for r in st} == {0, 1} and len({r["batch"] for r in st}) == 4


def test_topk_and_greedy(spark):
    rows = [(i, float(i % 2), float((i // 2) % 2), float(i % 2)) for i in range(400)]
    wide = spark.createDataFrame(rows, "human_id long, A double, B double, C double")
    rel = RL.ami_pairs(RL.contingency(wide, ["A", "B", "C"]))
    top = {(r["target"], r["rank"]): r["qkey"] for r in RL.topk_pairwise(rel, 1).collect()}
    assert top[("A", 1)] == "C"            # C copies A
    g = RL.topk_greedy(wide, "A", ["A", "B", "C"], 1).first()
    assert g["qkey"] == "C" and g["gain"] == pytest.approx(1 / __import__("math").log(2), rel=1e-6)
