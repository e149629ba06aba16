"""Full texts, trees, published documents, reports, the call interface."""

import json

import pytest
from helpers import rows

from lexdelta import api, contract
from lexdelta.operators import spans as S
from lexdelta.operators import tree as T

NODE = "doc_id string, node_ord int, display_path array<string>, tag string, header_text string, body_text string, display_text string, section_number string, element_id string"
DOC = [
    ("d", 0, [], "front-matter", "", "Mast", "", "", "fm"), ("d", 1, ["TITLE I", "Roads", "Bridges"], "appropriations-small", "Bridges", "For $5 and $6.", "", "", "e1"), ("d", 2, ["TITLE I", "Roads", "sec. 1"], "section", "", "Body é $5.", "(a) Body é $5.\n    (1) x", "Sec. 1", "e2"),
    ("d", 3, ["TITLE I", "Rails"], "appropriations-intermediate", "Rails", "", "", "", "e3"), ("d", 4, ["TITLE I", "Roads"], "appropriations-major", "Roads", "Own text $7.", "", "", "e4"), ("d", 5, ["TITLE I", "Roads"], "appropriations-major", "Roads", "Again $7.", "", "", "e5"),
]


def nodes(spark, data=DOC):
    return spark.createDataFrame(data, NODE)


def test_full_text(spark):
    lines = S.serialise(nodes(spark))
    text = S.full_text(lines).first()["full_text"]
    assert text == "Mast\n\nTITLE I\n\nRoads\n\nBridges\n\nFor $5 and $6.\n\nSEC. 1.  (a) Body é $5.\n    (1) x\n\nRails\n\nRoads\n\nOwn text $7.\n\nAgain $7."
    want = {"fm": "Mast", "e1": "For $5 and $6.", "e2": "(a) Body é $5.\n    (1) x", "e4": "Own text $7.", "e5": "Again $7."}
    assert {r["element_id"]: text[r["start_char"] : r["end_char"]] for r in S.body_spans(lines).collect()} == want
    for r in lines.collect():
        assert text[r["start_char"] :].startswith(r["text"])
    secs = [tuple(r) for r in S.sections(lines).orderBy("start_char").select("label", "kind", "descriptor").collect()]
    assert secs == [("TITLE I", "title", "Roads"), ("Roads", "account", None), ("Bridges", "account", None), ("Sec. 1", "section", None), ("Rails", "account", None), ("Roads", "account", None)]


def test_tree(spark):
    items = T.items_of(nodes(spark))
    t = T.build(items)
    got = {(tuple(r["path"]), r["level"], r["item_ord"]) for r in t.collect()}
    assert got == {((), "preamble", 0), (("TITLE I",), "title", None), (("TITLE I", "Roads"), "major", 4), (("TITLE I", "Roads"), "major", 5), (("TITLE I", "Roads", "Bridges"), "account", 1), (("TITLE I", "Roads", "sec. 1"), "section", 2), (("TITLE I", "Rails"), "agency", 3)}
    assert T.conservation(t, items).count() == 0
    (j,) = T.nested_json(T.group_front_matter(t, items)).collect()
    top = json.loads(j["tree"])
    assert [n["label"] for n in top] == ["Front Matter", "TITLE I"]
    assert [n["label"] for n in top[1]["children"]] == ["Roads", "Rails", "Roads"] and [n["label"] for n in top[1]["children"][0]["children"]] == ["Bridges", "sec. 1"]
    assert T.conservation(T.group_front_matter(t, items), items).count() == 0
    bodies = spark.createDataFrame([("d", "e1", 10, 20), ("d", "e2", 30, 45), ("d", "fm", 0, 4)], "doc_id string, element_id string, start_char int, end_char int")
    headings = spark.createDataFrame([("d", ["TITLE I"], 6)], "doc_id string, path array<string>, start_char int")
    spans = T.placed(T.group_front_matter(t, items), items, bodies, headings)
    got = {(tuple(r["path"]), r["start_char"], r["end_char"]) for r in spans.where("coalesce(item_ord, 9) not in (3, 5)").collect()}
    # a body, a heading, what stands below, and the opening around its parts
    assert got == {(("TITLE I", "Roads", "Bridges"), 10, 20), (("TITLE I", "Roads", "sec. 1"), 30, 45), (("TITLE I",), 6, 13), (("TITLE I", "Roads"), 10, 45), (("Front Matter",), 0, 4), (("Front Matter", ""), 0, 4)}
    assert [r["walk_no"] for r in T.walk(t).collect() if r["item_ord"] == 0] == [1]


def test_marks(spark):
    m = spark.createDataFrame([("d", 0, 10, 1), ("d", 5, 8, 2), ("d", 9, 20, 3), ("d", 10, 12, 4), ("d", 12, 13, 5), ("d", None, 3, 6), ("e", 3, 4, 7)], "doc_id string, start_char int, end_char int, mark_id int")
    assert rows(S.accept_marks(m).select("doc_id", "mark_id")) == {("d", 1), ("d", 4), ("d", 5), ("e", 7)}
    r = spark.createDataFrame([("d", i, i * 10, i * 10 + 9) for i in range(30)], "doc_id string, row_id int, row_start int, row_end int")
    k = spark.createDataFrame([("d", 1, 5, 42), ("d", 2, 9, 10), ("d", 3, 250, 5000), ("x", 4, 0, 9)], "doc_id string, mark_id int, start_char int, end_char int")
    want = {("d", i, m, max(i * 10, a), min(i * 10 + 9, z)) for i in range(30) for m, a, z in ((1, 5, 42), (2, 9, 10), (3, 250, 5000)) if a < i * 10 + 9 and z > i * 10}
    for bucket in (7, 4096):
        assert rows(S.marks_on_rows(r, k, bucket)) == want


def test_ranges_and_own_blocks(spark):
    shown = spark.createDataFrame([("d", 1, 0, 1, 0, 9), ("d", 1, 1, None, 10, 19), ("d", 2, 0, 1, 21, 30)], "doc_id string, page int, line_ord int, line_number int, start_char int, end_char int")
    rg = spark.createDataFrame([("d", "a", 1, 1, 2, 1), ("d", "b", 1, -1, 2, 1), ("d", "c", 1, 1, 9, 9)], "doc_id string, k string, start_page int, start_line int, end_page int, end_line int")
    assert rows(S.range_spans(rg, shown).select("k", "start_char", "end_char")) == {("a", 0, 30), ("b", None, None), ("c", None, None)}
    from pyspark.sql import functions as F

    a = spark.createDataFrame([("d", 1, 0), ("d", 2, None), ("d", 3, 50), ("d", 4, 40)], "doc_id string, anchor_no int, start_char int")
    assert rows(S.own_blocks(a, F.lit(99)).select("anchor_no", "block_start", "block_end")) == {(1, 0, 50), (2, None, None), (3, 50, 50), (4, 40, 99)}


OLD = '<bill><form><congress>118th CONGRESS</congress><legis-num>H. R. 7</legis-num></form><legis-body><title><enum>I</enum><header>Roads</header><section id="a"><enum>1.</enum><text>Build for $5,000 the roads.</text></section><section id="b"><enum>2.</enum><text>Gone.</text></section></title></legis-body></bill>'
NEW = OLD.replace("$5,000", "$6,000").replace('<section id="b"><enum>2.</enum><text>Gone.</text></section>', '<section id="c"><enum>3.</enum><text>Fresh &lt;text&gt; here.</text></section>')


def test_compare_xml(spark):
    doc = json.loads(api.compare_xml(spark, OLD, NEW, labels=("introduced", "engrossed")))
    assert doc["schema_version"] == "1.3" and doc["bill"] == {"type": "hr", "number": "7", "congress": "118"}
    assert doc["versions"]["v2"] == {"label": "engrossed", "version_number": None, "source": "xml"}
    assert doc["summary"] == {"added": 1, "removed": 1, "modified": 1, "unchanged": 2, "moved": 0}
    assert [(c["id"], c["change_type"], c["amounts"]) for c in doc["changes"]] == [("c-0001", "modified", [{"old": 5000, "new": 6000}]), ("c-0002", "removed", []), ("c-0003", "added", [])]
    for c in doc["changes"]:
        assert set(c) == {"id", "change_type", "section_number", "path", "location", "anchor_resolution", "text", "amounts", "move", "full_text_span"} and c["location"] is None and c["move"] is None
        for side, text in (("v1", c["text"]["old"]), ("v2", c["text"]["new"])):
            span = c["full_text_span"][side]
            assert (span is None) == (text is None)
            assert span is None or doc["full_text"][side][span["start"] : span["end"]] == text
    assert [n["label"] for n in doc["tree"]["v2"]] == ["Front Matter", "TITLE I—Roads"]
    page = api.compare_xml(spark, OLD.encode(), NEW.encode(), output="html")
    assert page.startswith("<!doctype html>") and "<del>$5,000</del> <ins>$6,000</ins>" in page and "Fresh &lt;text&gt; here." in page
    with pytest.raises(ValueError, match="no body"):
        api.compare_xml(spark, "<bill/>", NEW)


def test_command_line(spark, tmp_path, capsys):
    a, b = tmp_path / "1_a.xml", tmp_path / "2_b.xml"
    a.write_text(OLD), b.write_text(NEW)
    assert api.main(["compare", str(a), str(b), "--format", "json", "-o", str(tmp_path / "o.json")]) == 0
    assert json.loads((tmp_path / "o.json").read_text())["summary"]["modified"] == 1


def test_plain_record(spark):
    doc = json.loads(api.compare_xml(spark, OLD, NEW, output="diff", labels=("a", "b"), include_unchanged=True))
    assert list(doc) == ["old_version", "new_version", "congress", "bill_type", "bill_number", "summary", "changes"]
    assert (doc["old_version"], doc["congress"], doc["bill_number"]) == ("a", 118, 7) and doc["summary"] == {"added": 1, "removed": 1, "modified": 1, "unchanged": 2, "moved": 0}
    assert [c["change_type"] for c in doc["changes"]].count("unchanged") == 2 and all("financial" not in c for c in doc["changes"])
    doc = json.loads(api.compare_xml(spark, OLD, NEW, output="diff", financial=True, include_unchanged=False, needle="SEC. 1"))
    (c,) = doc["changes"]
    assert c["financial"]["old_amounts"] == [5000] and c["financial"]["paired_amounts"] == [[5000, 6000]] and c["financial"]["amounts_changed"] and doc["financial_summary"] == {"sections_with_financial_changes": 1}
    assert doc["summary"]["modified"] == 1 and doc["summary"]["added"] == 0


COVER = "118TH CONGRESS\n1 A BILL\n2 To pay for roads.\n"
PAGE = COVER + "3 TITLE I\n4 SEC. 1. For roads, $5,000, to remain\n5 available.\n6 SEC. 2. Gone with the wind and rain for all.\n"


def test_compare_printed(spark):
    doc = json.loads(api.compare_printed(spark, [PAGE], [PAGE.replace("$5,000", "$6,000")]))
    assert doc["bill"]["congress"] == "118" and doc["versions"]["v1"]["source"] == "pdf" and doc["summary"] == {"modified": 1}
    (c,) = doc["changes"]
    assert c["path"] == {"v1": ["TITLE I", "SEC. 1"], "v2": ["TITLE I", "SEC. 1"]} and c["amounts"] == [{"old": 5000, "new": 6000}]
    for v, amount in (("v1", 5000), ("v2", 6000)):
        text, span = doc["full_text"][v], c["full_text_span"][v]
        assert text[span["start"] : span["end"]].lstrip().startswith("4  SEC. 1. For roads") and text[span["start"] : span["end"]].endswith("available.")
        front, title = doc["tree"][v]
        assert front["label"] == "Front Matter" and front["full_text_span"]["start"] == 0 and front["children"] == []
        assert title["label"] == "TITLE I" and [n["label"] for n in title["children"]] == ["SEC. 1", "SEC. 2"]
        assert title["children"][0]["own_amounts"] == [amount] and title["own_amounts"] == title["children"][1]["own_amounts"] == []
        # own texts follow on each other and cover the whole
        parts = [front["full_text_span"], title["full_text_span"], *(n["full_text_span"] for n in title["children"])]
        assert all(a["end"] == b["start"] for a, b in zip(parts, parts[1:])) and parts[-1]["end"] == len(text)
    page = api.compare_printed(spark, [PAGE], [PAGE.replace("$5,000", "$6,000")], "html")
    assert "<del>$5,000,</del> <ins>$6,000,</ins>" in page


def test_report_parts(spark):
    page = api.compare_xml(spark, OLD, NEW, output="html")
    assert page.count("<article ") == 3 and page.count('<section class="group"') == 1 and "TITLE I—Roads</a> (3)" in page
    assert page.count("<mark>") == 2 and 'name="find"' in page and page.count('name="mode"') == 3 and "<summary>Outline</summary>" in page
    from lexdelta import report

    change = lambda i, path, span: {"id": i, "change_type": "added", "path": {"v1": None, "v2": path}, "text": {"old": None, "new": "x"}, "amounts": [], "full_text_span": {"v1": None, "v2": span}}
    doc = {"changes": [change("a", None, {"start": 1, "end": 3}), change("b", ["T"], {"start": 2, "end": 4}), change("c", ["T"], {"start": 3, "end": 4})], "full_text": {"v1": "", "v2": "a<bcd"}}
    assert list(report._groups(doc["changes"])) == ["T", "Uncategorized"]
    assert report._full_bill(doc) == '<h2>Full text</h2><pre>a<mark><a href="#a" title="a">&lt;b</a></mark><mark><a href="#c" title="c">c</a></mark>d</pre>'


def test_functions_in_sql(spark):
    from lexdelta.functions import udfs

    udfs.register(spark)
    assert spark.sql("select seq_ratio('a b', 'a c') r, word_diff_html('a b c', 'a b d') w").first() == (0.5, "a b <del>c</del> <ins>d</ins>")
    spark.createDataFrame([("1_x.xml", OLD), ("2_y.xml", "<bill/>")], "path string, content string").createOrReplaceTempView("delivered_bills")
    got = spark.sql("select n.doc_id, n.section_number, n.error from delivered_bills b, lateral parse_bill(b.path, b.content) n where tag = 'section' or error is not null").collect()
    assert {(r["doc_id"], r["section_number"], r["error"]) for r in got} == {("1_x.xml", "Sec. 1", None), ("1_x.xml", "Sec. 2", None), ("2_y.xml", None, "ValueError: no body in the document")}


def test_changes_without_element_are_looked_up(spark):
    changes = spark.createDataFrame([("p", 1, "modified", "e1", "x", "one two", "one 2"), ("p", 2, "modified", "", "", "one", "one"), ("p", 3, "added", "", "", None, "nowhere"), ("p", 4, "unchanged", "", "", "one", "one"), ("q", 1, "removed", "e9", "", "z", None)], "pair_id string, change_no int, change_type string, element_id_old string, element_id_new string, old_text string, new_text string")
    bodies = spark.createDataFrame([("p", "v1", "e1", 4, 11), ("q", "v1", "e9", 0, 1)], "pair_id string, side string, element_id string, start_char int, end_char int")
    texts = spark.createDataFrame([("p", "v1", "one one two one"), ("p", "v2", "one 2 one"), ("q", "v1", "z")], "pair_id string, side string, full_text string")
    assert rows(S.change_spans(changes, bodies, texts)) == {("p", "v1", 1, 4, 11), ("p", "v1", 2, 12, 15), ("p", "v2", 1, 0, 5), ("p", "v2", 2, 6, 9), ("p", "v2", 3, None, None), ("q", "v1", 1, 0, 1)}


def test_documents_without_changes(spark):
    h = spark.createDataFrame([("p", "hr", 1, 118, "a", "b")], "pair_id string, bill_type string, number int, congress int, v1_label string, v2_label string")
    empty = contract.print_changes(spark.createDataFrame([], "pair_id string, hunk_no int, change_type string, v1_anchor string, v2_anchor string, v1_range struct<start_page:int,start_line:int,end_page:int,end_line:int>, v2_range struct<start_page:int,start_line:int,end_page:int,end_line:int>, v1_text string, v2_text string, amount_pairs array<struct<old:bigint,new:bigint>>"))
    doc = json.loads(contract.documents(empty, h, "pdf").first()["canonical"])
    assert doc["changes"] == [] and doc["summary"] == {} and doc["tree"] is None and doc["full_text"] is None


def test_searched_spans(spark):
    c = spark.createDataFrame([("p", 1, "x"), ("p", 2, "x"), ("p", 3, "b"), ("p", 4, "none"), ("p", 5, None), ("p", 6, "x"), ("q", 1, "x")], "pair_id string, change_no int, target string")
    t = spark.createDataFrame([("p", "x b x"), ("q", None)], "pair_id string, full_text string")
    assert rows(S.search_spans(c, t)) == {("p", 1, 0, 1), ("p", 2, 4, 5), ("p", 3, 2, 3), ("p", 4, None, None), ("p", 5, None, None), ("p", 6, 4, 5), ("q", 1, None, None)}
