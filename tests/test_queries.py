"""Spark queries against their DuckDB oracle (small scale), plan checks,
and partition-count determinism."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from conftest import SF_SMALL  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from oracle_check import canon  # noqa: E402
from quorum.sources.driver import TABLES  # noqa: E402

KEYS = ["dist_cgss", "dist_atp", "emd", "dist_joint_k2", "ami_pairs", "prompts", "pack_sequences",
        "length_batches", "paired_summary", "run_matrix", "guard_format", "wd_upper", "entropy",
        "bounds_summary", "paired_files", "relevance_remembered", "exclude_relevant", "entropy_subsets", "dist_joint_k3",
        "scan_waves", "convert_field_waves", "select_split", "write_scored", "get_response", "joint_responses_long",
        "scan_train_metrics", "batch_score", "refine_clean"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", KEYS)
def test_oracle(spark, duck, key):
    got = canon(E.queries()[key](spark, SF_SMALL).toPandas())
    want = canon(duck.execute(E.oracle_sql()[key]).fetchdf())
    assert got == want


def test_every_query_has_an_oracle():
    from quorum.plans import registry
    registry.load_all()
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert set(registry.QUERIES) <= set(E.queries()) and set(registry.ORACLES) <= set(E.oracle_sql())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"qkey", "attribute", "grp", "refusal_rate", "emd"} <= set(df.columns)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_distribution_plan_is_jvm_only(spark):
    from quorum.plans.distribution_queries import cgss_distribution
    p = _plan(cgss_distribution(spark, SF_SMALL))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    assert "BroadcastHashJoin" in p  # metadata joins are broadcast


def test_metric_plan_has_no_python(spark):
    from quorum.plans.metrics_queries import scored
    from quorum.functions import metrics as M
    p = _plan(scored(spark, SF_SMALL).select(M.emd("gold", "q", "ordinal")))
    assert "Python" not in p


@pytest.mark.parametrize("key,parts", [("dist_cgss", 1), ("dist_cgss", 4), ("dist_cgss", 37),
                                       ("sample_tokens", 1), ("sample_tokens", 37),
                                       ("length_batches", 1), ("length_batches", 37),
                                       ("pack_sequences", 3)])
def test_partition_count_does_not_change_rows(spark, key, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = canon(E.queries()[key](spark, SF_SMALL).toPandas())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    base = canon(E.queries()[key](spark, SF_SMALL).toPandas())
    assert got == base


def test_bounded_broadcast(spark):
    from quorum.operators.joins import bounded_broadcast
    from quorum.sources import views as V
    small = V.group_codes(spark)
    plan = small.join(bounded_broadcast(small), "code")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan.lower()
    big = spark.range(10 ** 9)
    plan2 = big.join(bounded_broadcast(big, limit=1024), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan2.lower()
