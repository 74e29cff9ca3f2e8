"""Positions and running values on repeated, NULL and hot keys."""
import random

import pytest
from pyspark.sql import functions as F

from quorum.operators import compare as CP
from quorum.operators import sequences as S
from quorum.operators.positions import scan
from quorum.sources import io as IO


def table(n, seed=1, runs=("a", "b", None, "c"), hot=0.5):
    rng = random.Random(seed)
    return [("hot" if rng.random() < hot else rng.choice(runs), rng.choice([None, 1, 1, 2, 3, 7]), rng.choice([None, 1.0, 2.0, -3.0, 0.5]), rng.randrange(50))
            for _ in range(n)]


SCHEMA = "run string, step int, loss double, n int"


@pytest.mark.parametrize("batch", [3, 10_000])
def test_repeated_keys_keep_one_place_each(spark, batch):
    rows = table(400)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        order = lambda r: (r.step is not None, r.step or 0)
        placed = scan(df, ["step"], ["run"])
        assert placed.count == 400
        summed = scan(df, ["step"], ["run"], "before", "n", "sum")
        assert summed.total == sum(r[3] for r in rows)
        least = scan(df, ["step"], ["run"], "best", "loss", "min")
        assert least.total == -3.0
        found = placed.rows.collect(), summed.rows.collect(), least.rows.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for rs in found:
        assert sorted([tuple(r)[:4] for r in rs], key=str) == sorted(rows, key=str)
    for run in {r[0] for r in rows}:
        own = sorted((r for r in found[0] if r.run == run), key=lambda r: r.row_idx)
        assert [r.row_idx for r in own] == list(range(len(own))) and [order(r) for r in own] == sorted(order(r) for r in own)
        # equal keys come in any order of the input, so the running values are those of one such order
        own = sorted((r for r in found[1] if r.run == run), key=lambda r: (order(r), r.before))
        total = 0
        for step in sorted({order(r) for r in own}):
            same = [r for r in own if order(r) == step]
            left = {}
            for r in same:
                left.setdefault(r.before, []).append(r.n)
            while left:  # zeros keep the sum, so they come first
                here = sorted(left.pop(total))
                assert all(x == 0 for x in here[:-1])
                total += here[-1]
        own = [r for r in found[2] if r.run == run]
        for step in {order(r) for r in own}:
            earlier = [r.loss for r in own if order(r) < step and r.loss is not None]
            bests = [r.best for r in own if order(r) == step]
            assert all(b is not None and b <= min(earlier) for b in bests) if earlier else None in bests


def test_whole_repeated_rows(spark):
    df = spark.createDataFrame([(1, "x")] * 700 + [(2, "y")] * 30, "k int, v string")
    found = S.global_row_index(df, ["k"]).collect()
    assert sorted(r.row_idx for r in found) == list(range(730)) and all((r.k == 1) == (r.row_idx < 700) for r in found)


def test_order_of_the_input_breaks_ties(spark):
    df = spark.range(0, 300, 1, 7).select((F.col("id") % 3).alias("k"), F.col("id").alias("at"))
    got = [r.at for r in S.global_row_index(df, ["k"]).orderBy("row_idx").collect()]
    assert got == sorted(range(300), key=lambda i: i % 3)


def test_operators_on_repeated_keys(spark):
    df = spark.createDataFrame([(1, 4), (1, 4), (1, 4), (2, 4), (3, 9)], "id int, n int")
    assert sorted(r["rank"] for r in S.length_batches(df, "n", "id", 2, drop_last=False).collect()) == [0, 1, 2, 3, 4]
    tokens = spark.createDataFrame([(1, [1, 2]), (1, [3]), (2, [4, 5, 6])], "id int, t array<int>")
    assert sorted(tuple(r) for r in S.pack_sequences(tokens, "t", ["id"], 2).collect()) == [(0, [1, 2]), (1, [3, 4])]
    made = S.pack_sequences(tokens.withColumnRenamed("t", "u"), "t", ["id"], 2, made=F.col("u"))
    assert sorted(tuple(r) for r in made.collect()) == [(0, [1, 2]), (1, [3, 4])]
    steps = spark.createDataFrame([(1, 1, 2.0), (1, 1, 2.0), (1, 2, 1.0)], "run int, step int, loss double")
    got = CP.running_best(steps).collect()
    assert len(got) == 3 and {(r.step, r.best_before) for r in got} == {(1, None), (1, 2.0), (2, 2.0)}
    assert sorted(r.step for r in CP.step_cap(steps, 2).collect()) == [1, 1]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    found = scan(empty, ["step"], ["run"], "s", "n")
    assert found.rows.count() == 0 and found.count == 0 and S.pack_sequences(spark.createDataFrame([], "id int, t array<int>"), "t", ["id"], 4).count() == 0


def test_pairs_of_files_by_place(spark, tmp_path):
    def write(name, values):
        (tmp_path / name).mkdir()
        for part, at in enumerate(range(0, len(values), 1000)):
            lines = "".join(f"{v},{v / 2},{v % 7}\n" for v in values[at:at + 1000])
            (tmp_path / name / f"part-{part:03}.csv").write_text("kl,wd,loss\n" + lines)
        return str(tmp_path / name)
    base, ft = list(range(5000)), [x * 3 for x in range(5000)]
    paths, before = [write("b", base), write("f", ft)], spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # several splits a file
    try:
        got = IO.read_paired_eval_csv(spark, *paths, CP.METRICS, "kl double, wd double, loss double").collect()
        assert sorted((r.row_idx, r.kl_baseline, r.kl_ft) for r in got) == [(i, float(i), 3.0 * i) for i in range(5000)]
        with pytest.raises(ValueError):
            IO.read_paired_eval_csv(spark, paths[0], write("g", ft[:4999]), CP.METRICS, "kl double, wd double, loss double")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_repeated_index_pairs_by_rank(spark):
    def scored(index):
        return spark.createDataFrame([(i, float(n), 1.0, 1.0) for n, i in enumerate(index)], "row_idx long, kl double, wd double, loss double")
    got = CP.paired_join(scored([1, 1, 2]), scored([1, 2, 2])).collect()
    assert sorted((r.row_idx, r.kl_baseline, r.kl_ft) for r in got) == [(1, 0.0, 0.0), (1, 1.0, 1.0), (2, 2.0, 2.0)]
