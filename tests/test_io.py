"""Scans and sinks on small files written by the test."""

import os
import tempfile

from pyspark.sql import functions as F

from quorum.sources import io as IO
from quorum.streaming.waves import run_to_end
from quorum.operators.distribution import weighted_counts


def _tmp():
    return tempfile.mkdtemp(prefix="quorum-test-", dir="/tmp")


def test_stata_round_trip(spark):
    root = _tmp()
    df = spark.createDataFrame([(1, 10, 1.0), (1, 11, 2.0), (2, 12, None)], "wave int, QKEY long, Q double")
    IO.write_stata(df, root, "wave", {"Q": {1: "Yes", 2: "No's"}}, {"Q": "A question?"}).collect()
    back = IO.scan_stata(spark, os.path.join(root, "*", "*.dta"), "QKEY long, Q double, source_file string")
    rows = sorted((r["QKEY"], r["Q"]) for r in back.collect())
    assert rows == [(10, 1.0), (11, 2.0), (12, None)]
    cb = IO.scan_codebook(spark, os.path.join(root, "wave=1", "*.dta")).where("var = 'Q'").orderBy("pos").collect()
    cb = [r for r in cb if r["source_file"] == cb[0]["source_file"]]
    assert [(r["code"], r["label"]) for r in cb] == [(1.0, "Yes"), (2.0, "No's")]
    assert cb[0]["var_label"] == "A question?"


def test_encoding_detection(spark):
    root = _tmp()
    text = "id,name\n1,北京\n"
    for name, enc in (("a.csv", "utf-8"), ("b.csv", "utf-8-sig"), ("c.csv", "gbk")):
        with open(os.path.join(root, name), "w", encoding=enc) as f:
            f.write(text)
    enc = {os.path.basename(r["path"]): r["encoding"] for r in IO.detect_encodings(spark, root + "/*.csv").collect()}
    assert enc == {"a.csv": "utf-8", "b.csv": "utf-8-sig", "c.csv": "gbk"}
    names = {r["name"] for r in IO.read_csv_auto(spark, root + "/*.csv").collect()}
    assert names == {"北京"}


def test_publish_suffix(spark):
    p = os.path.join(_tmp(), "out.csv")
    assert IO.publish_path(spark, p) == p
    spark.range(3).write.csv(p)
    q = IO.publish_path(spark, p)
    assert q != p and q.endswith(".csv") and q.startswith(p[:-4] + "_")


def test_stream_matches_batch(spark):
    root = _tmp()
    src = os.path.join(root, "in")
    rows = [(i, f"Q_W{w}", "Q", float(i % 3 + 1), float(i % 5 + 1), "a" if i % 2 else "b", w)
            for i in range(60) for w in (1, 2)]
    df = spark.createDataFrame(rows, "human_id long, qkey string, var string, code double, weight double, g string, wave int")
    df.write.partitionBy("wave").parquet(src)
    groups = spark.createDataFrame([("G", "A", "a"), ("G", "B", "b")], "attribute string, grp string, code string")
    schema = spark.read.parquet(src).schema
    got = run_to_end(spark, src, schema, {"G": "g"}, groups, root)
    want = weighted_counts(spark.read.parquet(src), {"G": "g"}, groups)
    key = ["qkey", "attribute", "grp", "code"]
    a = sorted(tuple(r) for r in got.select(*key, F.round("w", 6), "n").collect())
    b = sorted(tuple(r) for r in want.select(*key, F.round("w", 6), "n").collect())
    assert a == b and len(a) > 0


def test_stata_files_are_as_many_as_rows_ask_for(spark, monkeypatch):
    """A task's rows of a key make one file, over Arrow batches, up to STATA_ROWS rows each; types and NULLs survive."""
    rows = [(i % 3, i, None if i % 5 == 0 else float(i), "t" * (i % 4), None if i % 7 == 0 else i % 100) for i in range(600)]
    df = spark.createDataFrame(rows, "wave int, QKEY long, Q double, S string, N int").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for most, files in ((10_000, 3), (70, 9)):
            monkeypatch.setattr(IO, "STATA_ROWS", most)
            root = _tmp()
            assert len(IO.write_stata(df, root, "wave").collect()) == files
            back = IO.scan_stata(spark, os.path.join(root, "*", "*.dta"), "QKEY long, Q double, S string, N int, source_file string")
            got = sorted((int(r.source_file.split("wave=")[1].split("/")[0]), r.QKEY, r.Q, r.S, r.N) for r in back.collect())
            assert [g[:2] for g in got] == sorted(r[:2] for r in rows)
            assert {g[1]: g[2:] for g in got} == {r[1]: r[2:] for r in rows}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
