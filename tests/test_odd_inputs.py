"""Inputs that once lost rows or text without an error."""
import math

import pytest
from pyspark.sql import functions as F

from quorum.functions import text
from quorum.operators import compare, distribution, groups, relevance, responses, safety, sequences
from quorum.sources import io as IO


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_group_lists_with_apostrophes(spark):
    cat = spark.createDataFrame([("EDUCATION", """['High school', "Associate's degree", 'it\\'s']"""), ("SEX", "['Male', 'Female']")],
                                "attribute string, group string")
    assert rows(groups.groups_explode(cat), "attribute", "grp") == sorted(
        [("EDUCATION", "High school"), ("EDUCATION", "Associate's degree"), ("EDUCATION", "it's"), ("SEX", "Male"), ("SEX", "Female")], key=str)


def test_primary_category_with_apostrophe(spark):
    df = spark.createDataFrame([("""[["x's", 0.1], ['self-harm/instructions', 0.9]]""",)], "m string")
    assert df.select(safety.primary_category("m").alias("c")).first()["c"] == "011"


def test_literals_keep_quoted_text(spark):
    df = spark.createDataFrame([("['5 - 10 years', 'nan', '1 000 yuan', \"it's\"]",), ("['a' 'b c']",)], "s string")
    got = [r.a for r in df.select(text.parse_literal("s", "string").alias("a")).collect()]
    assert got == [["5 - 10 years", "nan", "1 000 yuan", "it's"], ["a", "b c"]]
    num = spark.createDataFrame([("[0.1 0.2  -3. nan]",), ("[1, 2.5]",)], "s string").select(text.parse_literal("s").alias("a")).collect()
    assert num[0].a[:3] == [0.1, 0.2, -3.0] and math.isnan(num[0].a[3]) and num[1].a == [1.0, 2.5]


def test_templates_are_filled_once(spark):
    df = spark.createDataFrame([("Use {input} here", "data {instruction}")], "instruction string, input string")
    got = df.select(safety.instruction_prompt("instruction", "input").alias("p")).first()["p"]
    assert "Use {input} here" in got and "data {instruction}" in got


def test_null_partition_key_keeps_rows(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2)], "run string, step int")
    assert rows(sequences.global_row_index(df, ["step"], ["run"]), "run", "step", "row_idx") == [("a", 2, 0), (None, 1, 0), (None, 3, 1)]
    out = sequences.global_prefix(df, "step", ["step"], ["run"], name="before", how="min")
    assert rows(out, "run", "step", "before") == [("a", 2, None), (None, 1, None), (None, 3, 1)]


def test_joint_long_with_repeated_answers(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 0), (1, "a", 0.0, 1), (1, "b", 5.0, 0), (2, "a", 1.0, 0)],
                               "human_id long, qkey string, code double, at int")
    assert rows(responses.joint_responses_long(df, ["a", "b"], order="at"), "human_id", "codes") == [(1, [0.0, 5.0])]
    assert rows(responses.joint_responses_long(df, ["a", "b"]), "human_id", "codes") == [(1, [1.0, 5.0])]


def test_joint_groups_with_null_attribute(spark):
    resp = spark.createDataFrame([("Q", "Q", 1.0, 1.0, "a", "b", "c"), ("Q", "Q", 1.0, 1.0, None, "b", "c")],
                                 "qkey string, var string, code double, weight double, A string, B string, C string")
    codes = spark.createDataFrame([(x.upper(), f"g{x}", x) for x in "abc"], "attribute string, grp string, code string")
    got = distribution.weighted_counts(resp, {"A": "A", "B": "B", "C": "C"}, codes, k=2)
    assert rows(got, "attribute", "n") == [("['A', 'B']", 1), ("['A', 'C']", 1), ("['B', 'C']", 2)]


def test_assemble_with_wave_mark_in_variable(spark):
    resp = spark.createDataFrame([("SAFE_WORK_W41", "SAFE_WORK", c, 1.0, "a") for c in (1.0, 2.0, 99.0)],
                                 "qkey string, var string, code double, weight double, A string")
    book = spark.createDataFrame([("SAFE_WORK", 1, 1.0, "yes"), ("SAFE_WORK", 2, 2.0, "no"), ("SAFE_WORK", 3, 99.0, "Refused")],
                                 "var string, pos int, code double, label string")
    variables = spark.createDataFrame([("SAFE_WORK", "S. Is it safe?")], "var string, label string")
    codes = spark.createDataFrame([("A", "ga", "a")], "attribute string, grp string, code string")
    got = distribution.assemble_atp(resp, book, variables, codes, {"A": "A"})
    assert rows(got, "qkey", "grp", "responses") == [("SAFE_WORK_W41", "Overall", [0.5, 0.5]), ("SAFE_WORK_W41", "ga", [0.5, 0.5])]


def test_pairs_by_position(spark):
    def scored(index):
        return spark.createDataFrame([(i, float(n), 1.0, 1.0) for n, i in enumerate(index)], "row_idx long, kl double, wd double, loss double")
    same = compare.paired_join(scored([1, 2]), scored([1, 2]))
    other = compare.paired_join(scored([1, 2]), scored([1, 5]))
    for p in (same, other):
        assert rows(p, "row_idx", "kl_baseline", "kl_ft") == [(1, 0.0, 0.0), (2, 1.0, 1.0)]
    with pytest.raises(ValueError):
        compare.paired_join(scored([1]), scored([1, 2])).count()


def test_last_row_wins(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 2, "c"), (1, 1, "b"), (None, 0, "n")], "k int, at int, v string")
    assert rows(compare.dedupe_last(df, ["k"], ["at"]), "k", "v") == [(1, "c"), (None, "n")]


def test_cache_by_full_path(spark, tmp_path):
    def build(n):
        return IO.cached(spark, str(tmp_path), n, "tok", lambda: spark.range(3 if n.startswith("a") else 7)).count()
    assert [build(n) for n in ("a/train.csv", "b/train.csv", "a/train.csv")] == [3, 7, 3]


def test_unreadable_metric_files_are_listed(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"train_step_loss": [1.0, 2.0]}')
    (tmp_path / "bad.json").write_text("{not json")
    assert IO.read_train_metrics(spark, f"{tmp_path}/*.json").where("value is not null").count() == 2
    assert [r.source_file.endswith("bad.json") for r in IO.unreadable_train_metrics(spark, f"{tmp_path}/*.json").collect()] == [True]


def test_skip_reasons_of_all_schemes(spark):
    resp = spark.createDataFrame([("Q_W1", "Q", 1.0, 1.0, "a"), ("Q_W1", "Q", 2.0, 0.0, "b"), ("Q_W1", "Q", 99.0, 1.0, "c")],
                                 "qkey string, var string, code double, weight double, A string")
    book = spark.createDataFrame([("Q", 1, 1.0, "yes"), ("Q", 2, 2.0, "no"), ("Q", 3, 99.0, "Refused")],
                                 "var string, pos int, code double, label string")
    variables = spark.createDataFrame([("Q", "S. Is it?")], "var string, label string")
    codes = spark.createDataFrame([("A", x, x) for x in "abc"], "attribute string, grp string, code string")

    def reasons(df):
        return sorted((r.grp, r.skip_reason) for r in df.where("attribute = 'A'").collect())
    waves = distribution.assemble_atp(resp, book, variables, codes, {"A": "A"}, with_report=True)
    assert reasons(waves) == [("a", None), ("b", "no_weight"), ("c", "all_refused")]
    assert rows(distribution.skip_report(waves.where("attribute = 'A'")), "reason", "n") == [("all_refused", 1), ("no_weight", 1), ("ok", 1)]
    assert reasons(distribution.distribution_atp(resp, book, codes, {"A": "A"}, with_report=True)) == [("a", None), ("b", "no_weight")]
    options = spark.createDataFrame([("Q", ["yes", "no", "Refused"], [1.0, 2.0, 3.0])], "var string, options array<string>, ordinal array<double>")
    gss = distribution.distribution_gss(resp.where("code < 9"), options, codes, {"A": "A"}, with_report=True)
    assert reasons(gss) == [("a", None), ("b", "no_weight")]


def test_recode_hooks_and_exclusion(spark):
    df = spark.createDataFrame([("A", "x", "q1"), ("A", "y", "q2"), (None, "z", None)], "attribute string, grp string, qkey string")
    table = spark.createDataFrame([("A", "x", "X"), ("A", "x", "XX"), (None, "z", "Z")], "attribute string, grp string, recoded string")
    assert rows(groups.recode_groups(df, table), "attribute", "grp") == [("A", "X"), ("A", "y"), (None, "Z")]
    assert rows(df.select(groups.recode_group("attribute", "grp", lambda a, g: F.upper(g)).alias("g")), "g") == [("X",), ("Y",), ("Z",)]
    assert rows(groups.exclude_listed(df, df.where("qkey = 'q1' or qkey is null")), "qkey") == [("q2",), (None,)]


def test_token_ids_with_ends(spark):
    df = spark.createDataFrame([("a b a",)], "t string")
    ids = df.select(sequences.token_ids("t", bos=1, eos=2).alias("i")).first().i
    assert ids[0] == 1 and ids[-1] == 2 and ids[1] == ids[3] != ids[2]
    assert df.select(sequences.token_ids("t", lambda c: F.array(F.lit(7).cast("bigint"))).alias("i")).first().i == [7]
