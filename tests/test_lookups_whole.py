"""Lookups of every respondent in every question, on tables that the test builds."""
import datetime

import __spark_entry__ as E


def tables(spark, root):
    day = datetime.date
    orders = [(1, 10, "O", 5.0, day(1996, 1, 2), "1-URGENT"), (2, 10, "F", 6.0, day(1997, 3, 4), "4-NOT SPECIFIED"), (34, 11, "P", 7.0, day(1998, 5, 6), "5-LOW")]
    for name, rows, schema in (
            ("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string"),
            ("customer", [(10, 1, "BUILDING", 100.0), (11, 1, "MACHINERY", 200.0)], "c_custkey long, c_nationkey long, c_mktsegment string, c_acctbal double"),
            ("nation", [(1, "CHINA", 2)], "n_nationkey long, n_name string, n_regionkey long"), ("region", [(2, "ASIA")], "r_regionkey long, r_name string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}.parquet")


def test_every_question_is_looked_up_for_everybody(spark, tmp_path):
    tables(spark, tmp_path)
    rows = E.queries()["get_response"](spark, str(tmp_path)).collect()
    keys = [f"{v}_W{w}" for v in ("PRIORITY", "STATUS") for w in (1996, 1997, 1998)]
    got = {(r.human_id, r.qkey): (r.idx, r.label) for r in rows}
    assert len(rows) == 18 and set(got) == {(h, k) for h in (1, 2, 34) for k in keys}
    asked = {(1, "PRIORITY_W1996"): (0, "1-URGENT"), (1, "STATUS_W1996"): (1, "Open"), (2, "PRIORITY_W1997"): (-1, "4-NOT SPECIFIED"),
             (2, "STATUS_W1997"): (0, "Fulfilled"), (34, "PRIORITY_W1998"): (-2, "Nan response"), (34, "STATUS_W1998"): (-2, "Nan response")}
    assert got == {k: asked.get(k, (-3, "Not participated for wave")) for k in got}
