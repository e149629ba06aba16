"""Reports, the index, archives, ground truth, streams."""

import io
import json
import zipfile

import pytest
from helpers import rows
from pyspark.sql import functions as F

from lexdelta.operators import validation as V
from lexdelta.sources import index as I
from lexdelta.sources import reports as R
from lexdelta.streaming import ingest

REPORT = """<html><pre>
TITLE I

DEPARTMENT OF ROADS &amp; RAILS

      Bureau of Bridges

BRIDGE REPAIRS
(INCLUDING TRANSFER OF FUNDS)

Appropriations, 2023.............   $9,000
Committee recommendation.........   $10,500

prose stands between
Committee recommendation.........   $77

TITLE II
      Office of Ferries
FERRY STAFF
Committee recommendation.........   20,000

COMPARATIVE STATEMENT OF NEW BUDGET
TITLE I--ROADS
Bureau Of Bridges Total
      Bureau of Bridges
Bridge repairs........   9,000  9,500  10,500  +1,500  +1,000
Blank third...........   1  2  .....  4
Memo..................   1  2  (5)  4
Negative..............   1  .....  -3  4
</pre></html>"""


def test_reports(spark, tmp_path):
    (tmp_path / "CRPT-1.htm").write_text(REPORT)
    lines = R.report_lines(R.read_reports(spark, str(tmp_path)))
    assert rows(R.summary_accounts(lines).select("heading", "committee_recommendation", "title", "bureau")) == {("BRIDGE REPAIRS", 10500, "DEPARTMENT OF ROADS & RAILS", "Bureau of Bridges"), ("FERRY STAFF", 20000, "DEPARTMENT OF ROADS & RAILS", "Office of Ferries")}
    got = R.comparative_rows(lines)
    assert rows(got.select("item", "committee_recommendation_thousands", "title", "bureau")) == {("Bridge repairs", 10500, "ROADS", "Bureau of Bridges"), ("Negative", -3, "ROADS", "Bureau of Bridges")}


def index(spark):
    return spark.createDataFrame([("119-hr-1", "One", "007"), ("119-hr-10", "Ten", ""), ("118-s-1", "Old", "x")], "id string, title string, n string")


def test_upsert_with_repeated_ids(spark):
    batch = spark.createDataFrame([("119-hr-1", "first"), ("9-hr-9", "a"), ("119-hr-1", "last"), ("9-hr-9", "b")], "id string, title string").coalesce(1)
    got = [tuple(r) for r in I.upsert(index(spark), batch).select("id", "title").collect()]
    assert sorted(t for i, t in got if i == "119-hr-1") == ["last"] and sorted(t for i, t in got if i == "9-hr-9") == ["a", "b"]
    assert [r["title"] for r in I.upsert(index(spark), batch, order="title").where("id = '119-hr-1'").collect()] == ["last"]
    assert [r["title"] for r in I.upsert(index(spark), batch, "skip").where("id = '119-hr-1'").collect()] == ["One"]


def test_upsert(spark):
    batch = spark.createDataFrame([("119-hr-1", "", "new"), ("119-s-2", "Two", None)], "id string, title string, extra string")
    assert rows(I.upsert(index(spark), batch)) == {("119-hr-1", "", "new", "007"), ("119-hr-10", "Ten", "", ""), ("118-s-1", "Old", "", "x"), ("119-s-2", "Two", "", "")}
    assert rows(I.upsert(index(spark), batch, "skip")) == {("119-hr-1", "One", "", "007"), ("119-hr-10", "Ten", "", ""), ("118-s-1", "Old", "", "x"), ("119-s-2", "Two", "", "")}
    assert I.upsert(index(spark).where("false"), batch).columns == ["id", "title", "extra", "n"]
    with pytest.raises(Exception, match="no id"):
        I.upsert(index(spark), spark.createDataFrame([("", "x")], "id string, title string")).collect()
    with pytest.raises(ValueError):
        I.upsert(index(spark), batch, "append")


def test_lookups_and_columns(spark, tmp_path):
    i = index(spark)
    assert rows(I.by_prefix(i, 119, "hr", 1).select("id")) == {("119-hr-1",), ("119-hr-10",)} and rows(I.by_id(i, 119, "hr", 1).select("id")) == {("119-hr-1",)}
    assert rows(I.rename(i.withColumn("old", F.lit("o")), {"old": "n", "none": "n"}).select("id", "n")) == {("119-hr-1", "007"), ("119-hr-10", "o"), ("118-s-1", "x")}
    quoted = spark.createDataFrame([("a", 'say "x", y\nz')], "id string, t string")
    I.write_csv(quoted, str(tmp_path / "ix"))
    assert rows(I.read_csv(spark, str(tmp_path / "ix"))) == rows(quoted)
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="no column 'id'"):
        I.read_csv(spark, str(tmp_path / "bad.csv"))


STATUS = "<billStatus><bill><congress>119</congress><type>HR</type><number>7</number><title>Roads</title><introducedDate>2025-01-03</introducedDate><latestAction><actionDate>2025-01-13</actionDate><text>Done.</text></latestAction><policyArea><name>Transport</name></policyArea><actions><item/><item/></actions><summaries><summary><text>Short.</text></summary></summaries><sponsors><item/></sponsors></bill></billStatus>"


def test_archives(spark, tmp_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("BILLSTATUS-119hr7.xml", STATUS)
        z.writestr("BILLSTATUS-119hr8.xml", STATUS.replace("<number>7", "<number>8"))
    (tmp_path / "a.zip").write_bytes(buf.getvalue())
    (tmp_path / "b.zip").write_bytes(b"broken")
    members = I.read_archives(spark, str(tmp_path))
    assert members.where("error is not null").count() == 1
    known = spark.createDataFrame([("119-hr-7", "Kept")], "id string, title string")
    got = {r["id"]: r.asDict() for r in I.ingest(known, members, "skip").collect()}
    assert got["119-hr-7"]["title"] == "Kept" and got["119-hr-8"]["title"] == "Roads"
    r = got["119-hr-8"]
    assert (r["daysActive"], r["actionCount"], r["summaryLength"], r["sponsorCount"], r["policyArea"]) == ("10", "2", "6", "1", "Transport")
    assert set(I.STATUS_COLUMNS) <= set(r)
    files = spark.createDataFrame([("a", 10, bytearray(b"%PDF-1.7")), ("b", 10, bytearray(b"  <bill/>")), ("c", 10, bytearray(b"zip")), ("d", 10**9, bytearray(b"<x/>"))], "path string, length bigint, content binary")
    assert rows(I.valid_uploads(files).select("path", "kind", "error")) == {("a", "pdf", None), ("b", "xml", None), ("c", None, "unknown kind"), ("d", "xml", "too large")}


def test_versions(spark):
    v = spark.createDataFrame([("b", "2024-02-01", "y"), ("b", None, "a"), ("b", "2024-01-01", "z")], "bill_id string, date string, type string").withColumn("date", F.to_date("date"))
    assert {r["type"]: r["chrono"] for r in I.version_order(v).collect()} == {"z": 1, "a": 2, "y": 3}
    n = spark.createDataFrame([("b", 1), ("b", 10), ("b", 2), ("c", 1)], "bill_id string, version_no int")
    assert rows(I.adjacent_versions(n)) == {("b", 1, 2), ("b", 2, 10)}


def test_ground_truth(spark, tmp_path):
    acc = lambda i, title, path, amount: {"bill": "b", "version": "1", "fy": "2024", "chamber": "house", "title": title, "bureau": None, "excel_name": f"a{i}", "match_path": path, "expected_amount": amount}
    (tmp_path / "t.json").write_text(json.dumps({"source": "s", "note": "", "accounts": [acc(1, "Dept. of Roads", None, 5), acc(2, "X", ["roads", "a"], 35), acc(3, "X", ["roads", "a"], 36), acc(4, None, None, 5)]}))
    truth = I.read_ground_truth(spark, str(tmp_path / "t.json")).withColumn("validation_id", F.substring("excel_name", 2, 9).cast("bigint"))
    nodes = spark.createDataFrame([("b", 1, ["dept of roads"], "$5"), ("b", 2, ["roads", "a"], "$10 $20 $5 $100 $20"), ("b", 3, [], "$36")], "bill_id string, node_id int, match_path array<string>, body_text string")
    got = V.validate(truth, nodes)
    assert rows(got.select("validation_id", "method")) == {(1, "agency"), (2, "component-sum"), (3, "unvalidated"), (4, "unvalidated")}
    r = [x.asDict() for x in V.recall(got).collect()]
    assert {(x["bill"], x["n"], x["n_validated"]) for x in r} == {("b", 4, 2), (None, 4, 2)}
    assert V.markdown(r).splitlines()[-1] == "| all | 2 / 4 | 50.0 % |"
    a = spark.createDataFrame([(1, "b", None, None, "Dept of Roads!"), (2, "b", "roads", None, "A"), (3, "b", None, None, "zzz"), (4, "b", None, None, None)], "key int, bill_id string, title string, bureau string, name string")
    assert rows(V.account_paths(a, nodes).select("key", "path")) == {(1, ("dept of roads",)), (2, ("roads", "a")), (3, None), (4, None)}


def test_streams(spark, tmp_path):
    d = str(tmp_path)
    v = spark.createDataFrame([("a", 1, "x", "2024-01-01"), ("a", 2, "y", "2024-01-02"), ("b", 1, "x", "2024-01-01"), (None, 1, "x", "2024-01-01")], "bill_id string, version_no int, version_label string, t string").withColumn("delivered_at", F.to_timestamp("t")).drop("t")
    v.repartition(3).write.parquet(f"{d}/bill_versions.parquet")
    got = ingest.latest_versions(ingest.read_stream(spark, d, "bill_versions", files_per_trigger=1))
    assert rows(got.select("bill_id", "version_no")) == {("a", 2), ("b", 1)}
    e = spark.createDataFrame([(f"2024-01-01 0{h}:10:00", "t", 1.5) for h in (1, 1, 2, 3)], "s string, event_type string, value double").withColumn("ts", F.to_timestamp("s"))
    e.repartition(2).write.parquet(f"{d}/events.parquet")
    s = ingest.read_stream(spark, d, "events", files_per_trigger=1)
    assert sorted((r["window_start"].hour, r["n"], r["cents"]) for r in ingest.complete_counts(s, late="1 day").collect()) == [(1, 2, 300), (2, 1, 150), (3, 1, 150)]
    closed = ingest.run_once(ingest.windowed_counts(s, late="10 minutes"), "closed")
    assert {r["window_start"].hour for r in closed.collect()} <= {1, 2, 3}
