"""The survey-shaped views agree with their oracle text (counts and codes)."""

import duckdb
import pytest

from conftest import SF_SMALL
from quorum.plans.oracle_views import with_views
from quorum.sources import views as V
from quorum.sources.driver import TABLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("view,cols", [
    ("respondents", ["human_id", "wave", "segment", "region", "balance_code"]),
    ("responses", ["human_id", "qkey", "code"]),
    ("line_answers", ["human_id", "RETURNFLAG", "LINESTATUS", "QTY", "DISCOUNT"]),
])
def test_view_matches_oracle(spark, duck, view, cols):
    got = sorted(tuple(r) for r in getattr(V, view)(spark, SF_SMALL).select(*cols).collect())
    sql = with_views(view) + f"SELECT {', '.join(cols)} FROM {view}"
    want = sorted(tuple(r) for r in duck.execute(sql).fetchall())
    norm = lambda rows: [tuple("∅" if v is None else (float(v) if isinstance(v, (int, float)) else v) for v in r)
                         for r in rows]
    assert norm(got) == norm(want) and len(got) > 0


def test_metadata_tables(spark):
    assert V.codebook(spark).count() == len(V.CODEBOOK_ROWS)
    assert V.group_codes(spark).count() == len(V.GROUP_CODE_ROWS)
    pol = {r["var"]: r for r in V.question_policy(spark).collect()}
    assert pol["PRIORITY"]["refusal_codes"] == [4.0] and pol["STATUS"]["refusal_codes"] is None
    st = {r["attribute"]: r["options"] for r in V.steering(spark).collect()}
    assert st["BALANCE"] == ["negative", "low", "middle", "high"]
