"""The registered corpus queries, and those with SQL against DuckDB."""
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import canon  # noqa: E402

SF = "/root/testdata/sf0.001"
WITHOUT_SQL = {"op3_language_id", "op5_html_extraction", "op6_packing", "op9_quality_cnn", "op11_token_align", "pipeline"}


def test_names():
    names = [q for q in E.queries() if q[:2] == "op" and q[2].isdigit()]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, len(names) + 1))
    assert {q for q in [*names, "pipeline"] if q not in E.oracle_sql()} == WITHOUT_SQL


@pytest.mark.parametrize("key", ["op1_decontamination", "op2_url_filter", "op4_quality_rules", "op7_chat_format", "op8_near_dedup", "op10_wacz", "op12_jaccard_join", "op13_hard_negatives"])
def test_against_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert canon(E.queries()[key](spark, SF).toPandas()) == canon(con.execute(E.oracle_sql()[key]).fetchdf())
