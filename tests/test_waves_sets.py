"""Drifting waves, sets of prompts and scores, filters ahead of joins."""
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quorum.operators import joins, responses
from quorum.sources import io as IO


def wave(root, n, columns):
    os.makedirs(f"{root}/wave={n}")
    pq.write_table(pa.table(columns), f"{root}/wave={n}/part-0.parquet")


def test_a_hundred_drifting_waves(spark, tmp_path):
    """100 waves of 100 questions, each with its own column names, without falling back from generated code."""
    root = str(tmp_path / "waves")
    for w in range(1, 101):
        wave(root, w, {"QKEY": [w * 10, w * 10 + 1], f"WEIGHT_W{w}": [1.0, 0.5], **{f"Q{w + i}_W{w}": [float(i), None] for i in range(100)}})
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        long = IO.scan_wave_answers(spark, root, range(1, 101))
        got = long.agg(F.count("*"), F.count("code"), F.sum("code"), F.countDistinct("qkey"), F.sum("weight")).first()
        assert tuple(got) == (20_000, 10_000, 100 * 4950.0, 10_000, 15_000.0)
        weights = IO.scan_wave_weights(spark, root, range(1, 101, 9)).agg(F.count("*"), F.sum("weight"), F.countDistinct("wave")).first()
        assert tuple(weights) == (24, 18.0, 12)
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    assert "CASE" not in long._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(FileNotFoundError):
        IO.scan_wave_answers(spark, root, [1, 999])


def test_waves_with_equal_columns_are_one_scan(spark, tmp_path):
    root = str(tmp_path / "waves")
    for w in (1, 2, 3):
        wave(root, w, {"QKEY": [w], "WEIGHT": [2.0], "A": [float(w)], "B": [None if w == 2 else 1.0]})
    wave(root, 4, {"QKEY": [4], "WEIGHT": [2.0], "A": [9.0]})
    assert [ws for ws, _ in IO.wave_layouts(spark, root, [1, 2, 3, 4])] in ([[1, 2, 3], [4]], [[1, 3], [2], [4]])
    got = sorted((r.human_id, r.qkey, r.code) for r in IO.scan_wave_answers(spark, root, [1, 2, 3, 4]).where("code is not null").collect())
    assert got == [(1, "A_W1", 1.0), (1, "B_W1", 1.0), (2, "A_W2", 2.0), (3, "A_W3", 3.0), (3, "B_W3", 1.0), (4, "A_W4", 9.0)]


def test_columns_by_wave(spark, tmp_path):
    root = str(tmp_path / "waves")
    wave(root, 1, {"QKEY": [1], "F_SEX": [1]})
    wave(root, 2, {"QKEY": [2], "F_GENDER_W2": [7]})
    names = {"SEX": ["F_SEX", "F_GENDER"]}
    assert sorted(IO.resolved_columns(spark, root, [1, 2], names)) == [(1, "SEX", "F_SEX"), (2, "SEX", "F_GENDER_W2")]
    assert sorted((r.QKEY, r.var, r.code) for r in IO.scan_wave_attributes(spark, root, [1, 2], names).collect()) == [(1, "F_SEX", "1"), (2, "F_GENDER", "7")]
    with pytest.raises(KeyError):
        IO.resolved_columns(spark, root, [1, 2], {"AGE": ["F_AGE"]})


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(root) for f in fs if f.startswith("part-")}


def test_one_set_is_replaced(spark, tmp_path):
    path = str(tmp_path / "scored")
    every = spark.createDataFrame([(i, m, k) for i in "ab" for m in "xy" for k in range(3)], "input string, model string, v int")
    IO.replace_sets(every, path, ["input", "model"])
    before = files(path)
    IO.replace_sets(spark.createDataFrame([("a", "y", 99)], "input string, model string, v int"), path, ["input", "model"])
    after = files(path)
    assert {f: t for f, t in before.items() if "input=a/model=y" not in f} == {f: t for f, t in after.items() if "input=a/model=y" not in f}
    got = sorted((r.input, r.model, r.v) for r in spark.read.parquet(path).collect())
    assert got == sorted([(i, m, k) for i in "ab" for m in "xy" if (i, m) != ("a", "y") for k in range(3)] + [("a", "y", 99)])


def test_work_list_prunes_folders(spark, tmp_path):
    path, work = str(tmp_path / "sets"), str(tmp_path / "work")
    rows = [(a, g, s, p, f"{a}{g}{s}{p}{k}") for a in "AB" for g in "uvw" for s in ("qa", "bio") for p in ("train", "test") for k in range(4)]
    IO.write_prompt_sets(spark.createDataFrame(rows, "attribute string, grp string, steering_type string, split string, text string"), path, "d")
    spark.createDataFrame([("d", "A", "u", "qa", "train"), ("d", "B", "w", "bio", "test")], ", ".join(f"{c} string" for c in IO.PROMPT_SET)).write.parquet(work)
    out = IO.select_sets(spark.read.parquet(path), spark.read.parquet(work), IO.PROMPT_SET)
    assert "dynamicpruning" in out._jdf.queryExecution().toString().lower()
    assert sorted(r.text for r in out.collect()) == sorted([f"Auqatrain{k}" for k in range(4)] + [f"Bwbiotest{k}" for k in range(4)])


def test_filters_ahead_of_joins(spark):
    df = spark.range(0, 100_000).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    keys = spark.range(0, 100_000, 100).select(F.col("id").alias("k"))
    exact = joins.with_keys_of(df, keys, "k")
    assert exact.count() == 1000
    by_bits = joins.with_keys_of(df, keys, "k", bits=1 << 20, limit=0)
    got = {r.k for r in by_bits.collect()}
    assert {r.k for r in keys.collect()} <= got and len(got) < 1500 and by_bits.columns == df.columns
    assert "SortMergeJoin" not in by_bits._jdf.queryExecution().executedPlan().toString()
    assert joins.with_keys_of(df, keys.limit(0), "k", limit=0).count() == 0


def test_lookups_of_few_people(spark):
    resp = spark.createDataFrame([(1, "A_W1", "A", 1.0), (1, "B_W1", "B", 9.0), (2, "A_W1", "A", None)], "human_id long, qkey string, var string, code double")
    book = spark.createDataFrame([("A", 1, 1.0, "yes"), ("A", 2, 2.0, "Refused"), ("B", 1, 9.0, "Refused")], "var string, pos int, code double, label string")
    look = spark.createDataFrame([(1, "A_W1"), (1, "B_W1"), (2, "A_W1"), (3, "A_W1"), (1, "A_W1")], "human_id long, qkey string")
    got = sorted(tuple(r) for r in responses.lookup_responses(look, resp, book).collect())
    assert got == [(1, "A_W1", 0, "yes")] * 2 + [(1, "B_W1", -1, "Refused"), (2, "A_W1", -2, "Nan response"), (3, "A_W1", -3, "Not participated for wave")]


def test_many_runs_in_a_file(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"run": 1, "part": 0, "train_step_loss": [1.0, 2.0]}\n{"run": 2, "part": 0, "val_step_loss": [3.0]}\n{not json\n')
    good, bad = IO.read_train_metric_rows(spark, str(tmp_path / "m.json"))
    assert sorted((r.run, r.series, r.idx, r.value) for r in good.collect()) == [(1, "train_step_loss", 0, 1.0), (1, "train_step_loss", 1, 2.0), (2, "val_step_loss", 0, 3.0)]
    assert [r.record for r in bad.collect()] == ["{not json"]
