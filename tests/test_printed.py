"""Printed pages: lines, headings, blocks, comparison."""

from pyspark.sql import functions as F

from lexdelta import api
from lexdelta.operators import anchors as A
from lexdelta.operators import blocks as B
from lexdelta.sources import print_lines as P

SOFT = P.SOFT


def pages(spark, *texts, doc="d"):
    return spark.createDataFrame([(doc, i, t) for i, t in enumerate(texts, 1)], "doc_id string, page int, text string")


def test_raw_text_to_lines(spark):
    raw = "5 \n•HR 42 RH\r\n1 For equip" + SOFT + "2 ment and sup-\n3 plies  \nHR 42 PCS\nunnumbered te" + SOFT + "xt\n4 end wel" + SOFT + "VerDate Mar 15\nVerDate below\n9 gone"
    got = [tuple(r) for r in P.print_lines(pages(spark, raw)).orderBy("line_ord").select("line_number", "text").collect()]
    assert got == [(1, "For equip-"), (2, "ment and sup-"), (3, "plies"), (None, "unnumbered text"), (4, "end wel-")]
    merged = [tuple(r) for r in P.page_lines(P.print_lines(pages(spark, raw))).orderBy("line_ord").select("line_number", "text", "src_start", "src_end").collect()]
    assert merged == [(1, "For equipment and supplies", 0, 3), (None, "unnumbered text", 3, 4), (4, "end wel-", 4, 5)]


def test_hyphens_across_pages_and_compounds(spark):
    lines = P.print_lines(pages(spark, "1 the Child-\n2 Rescue Act includ-", "1 ing roads"))
    flat = [tuple(r) for r in P.flat_lines(P.page_lines(lines)).orderBy("flat_ix").select("page", "line_number", "text", "flat_ix").collect()]
    assert flat == [(1, 1, "the Child-", 0), (1, 2, "Rescue Act including roads", 1)]


def test_offsets_point_into_the_full_text(spark):
    shown = P.rendered(P.print_lines(pages(spark, "1 one\nno number", "12 three")))
    text = P.full_text(shown).first()["full_text"]
    assert text == "    1  one\n       no number\n\n   12  three"
    for r in shown.collect():
        assert text[r["start_char"] : r["end_char"]] == r["row_text"]


def sized(spark, rows, doc="d"):
    """rows: (text, size) or (text, size, left, right, first word's right)."""
    data = [(doc, 1, i, i + 1, r[0], r[1], *(float(x) for x in (r[2:] if len(r) > 2 else (0, 100, 10)))) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id string, page int, line_ord int, line_number int, text string, glyph_size double, content_left double, content_right double, first_word_right double")


BODY, HEAD = 14.0, 11.0
DOC = [
    ("TITLE I", BODY), ("DEPARTMENT OF ROADS AND INTEL-", BODY, 0, 100, 40), ("LIGENCE", BODY, 0, 30, 30), ("OFFICE OF THE", HEAD), ("SECRETARY", HEAD), ("BRIDGES", HEAD), ("(INCLUDING TRANSFER OF FUNDS)", HEAD), ("For bridges, $5,000.", BODY), ("TUNNELS", HEAD), ("For tunnels, $6,000.", BODY),
    ("ADMINISTRATIVE PROVISIONS", HEAD), ("SEC. 101. Funds may be used.", BODY), ("SEC. 102. ACTIONS TO BUILD", BODY), ("MORE ROADS", HEAD), ("prose follows here.", BODY), ("DOCKS", HEAD), ("For docks.", BODY),
    ("TITLE II—GENERAL", BODY), ("PROVISIONS", BODY), ("SEC. 201. Short.", BODY),
]


def found(spark, lines):
    flat = P.flat_lines(lines)
    return A.extract_anchors(lines, flat)


def test_sized_anchors_and_breadcrumbs(spark):
    lines = sized(spark, DOC)
    assert [tuple(r)[1:] for r in A.size_bands(lines).collect()] == [(14.0, 11.0, 11.0)]
    got = [(r["kind"], r["text"], r["line_number"]) for r in found(spark, lines).orderBy("anchor_no").collect()]
    assert got == [
        ("title", "TITLE I", 1), ("major", "DEPARTMENT OF ROADS AND INTELLIGENCE", 2), ("agency", "OFFICE OF THE SECRETARY", 4), ("account", "BRIDGES", 6), ("account", "TUNNELS", 9), ("grouping", "ADMINISTRATIVE PROVISIONS", 11),
        ("section", "SEC. 101", 12), ("section", "SEC. 102", 13), ("account", "DOCKS", 16), ("title", "TITLE II", 18), ("section", "SEC. 201", 20),
    ]
    paths = {r["text"]: r["path"] for r in A.breadcrumbs(found(spark, lines)).collect()}
    major = "DEPARTMENT OF ROADS AND INTELLIGENCE"
    assert paths["BRIDGES"] == ["TITLE I", major, "OFFICE OF THE SECRETARY", "BRIDGES"] and paths["TUNNELS"] == ["TITLE I", major, "OFFICE OF THE SECRETARY", "TUNNELS"]
    assert paths["SEC. 102"] == ["TITLE I", major, "ADMINISTRATIVE PROVISIONS", "SEC. 102"] and paths["DOCKS"] == ["TITLE I", major, "DOCKS"]
    assert paths["SEC. 201"] == ["TITLE II", "SEC. 201"] and paths["TITLE II"] == ["TITLE II"]


def test_no_clear_bands(spark):
    flat_sizes = sized(spark, [("HEAD", 14.0), ("prose here", 14.0)], "flat")
    three = sized(spark, [("prose here", 14.0)] + [("HEAD A", 11.2), ("HEAD B", 10.0)] * 3, "three")
    none = sized(spark, [("ALL CAPS", 14.0), ("CAPS", 11.0)], "none")
    near = sized(spark, [("prose", 14.0), ("HEAD", 13.5)], "near")
    assert A.size_bands(flat_sizes.unionByName(three).unionByName(none).unionByName(near)).count() == 0


def test_legacy_accounts(spark):
    lines = P.print_lines(pages(spark, "1 BRIDGES\n2 (INCLUDING TRANSFERS)\n3 For necessary expenses of bridges, $5.\n4 plain\n5 lower\n6 lower\n7 For necessary expenses of nothing.\n8 TITLE I—X"))
    got = [(r["kind"], r["text"], r["line_number"]) for r in found(spark, lines).orderBy("anchor_no").collect()]
    assert got == [("account", "BRIDGES", 1), ("title", "TITLE I", 8)]


def test_divisions(spark):
    text = "1 DIVISION A—ROADS\n2 DIVISION B—RAILS\n3 prose\n4 DIVISION A—ROADS AND APPROPRIA-\n5 TIONS ACT,\n6 2024\n7 TITLE I\n8 SEC. 1. x\n9 DIVISION B—RAILS\n10 SEC. 2. y"
    lines = P.print_lines(pages(spark, text))
    got = {r["text"]: r["division"] for r in found(spark, lines).collect()}
    assert got == {"TITLE I": "Division A: ROADS AND APPROPRIATIONS ACT, 2024", "SEC. 1": "Division A: ROADS AND APPROPRIATIONS ACT, 2024", "SEC. 2": "Division B: RAILS"}


def test_blocks(spark):
    lines = P.print_lines(pages(spark, "1 A BILL\n2 To build.\n3 TITLE I—ROADS\n4 SEC. 1. Build $5.\n5 NEXT HEADING\n6 SEC. 2. More.\n7 TOTAL, $9"))
    flat = P.flat_lines(lines)
    got = B.blocks(flat, A.extract_anchors(lines, flat)).orderBy("block_no").collect()
    assert [(r["anchor"]["kind"], r["anchor"]["text"], r["start_line"], r["end_line"], r["text"]) for r in got] == [
        ("preamble", "Front Matter", 1, 2, "A BILL\nTo build."), ("title", "TITLE I", 3, 3, "TITLE I—ROADS"), ("section", "SEC. 1", 4, 4, "SEC. 1. Build $5."), ("section", "SEC. 2", 6, 7, "SEC. 2. More.\nTOTAL, $9"),
    ]
    bare = P.flat_lines(P.print_lines(pages(spark, "only prose\nhere", doc="x")))
    assert [r["anchor"] for r in B.blocks(bare, A.extract_anchors(bare, bare)).collect()] == [None]


def test_hunks(spark):
    long_ = "the Secretary shall build and keep all of the roads of the district in good order for use"
    old = f"1 SEC. 1. {long_} $5.\n2 SEC. 2. {long_} and rails.\n3 SEC. 3. Removed text entirely.\n4 SEC. 4. Same."
    new = f"1 SEC. 1. {long_} $6.\n2 SEC. 5. {long_} and rails.\n3 SEC. 6. Quite another thing is said.\n4 SEC. 4. Same."
    lines = P.print_lines(pages(spark, old, doc="o")).unionByName(P.print_lines(pages(spark, new, doc="n")))
    pairs = spark.createDataFrame([("p", "o", "n")], "pair_id string, old_doc string, new_doc string")
    got = api.printed_hunks(lines, pairs).orderBy("hunk_no").collect()
    assert [(r["change_type"], r["v1_anchor"], r["v2_anchor"]) for r in got] == [("modified", "SEC. 1", "SEC. 1"), ("moved", "SEC. 2", "SEC. 5"), ("removed", "SEC. 3", None), ("added", None, "SEC. 6")]
    assert [tuple(p) for p in got[0]["amount_pairs"]] == [(5, 6)] and got[2]["amount_pairs"] == []
    doc = api.printed_documents(lines, pairs).first()["canonical"]
    assert '"kind":"renumbered","old_label":"SEC. 2","new_label":"SEC. 5"' in doc and '"summary":{"added":1,"removed":1,"modified":1,"moved":1}' in doc


def test_glyphs(spark):
    g = [("d", 1, 100.0, float(x), float(x + 5), ord(c), 10.0) for x, c in ((0, "7"), (9, "a"), (14, "b"))] + [("d", 1, 80.0, float(x), float(x + 5), ord(c), 9.0) for x, c in ((0, "8"), (9, "c"))]
    df = spark.createDataFrame(g, "doc_id string, page int, bottom double, left double, right double, cp int, size double")
    assert [(r["text"], r["glyph_size"]) for r in P.glyph_lines(df).orderBy("line_ord").collect()] == [("7 ab", 10.0), ("8 c", 9.0)]
    assert {(r["line_number"], r["glyph_size"]) for r in P.margin_sizes(df).collect()} == {(7, 10.0), (8, 9.0)}
    assert P.glyph_lines(df.where(F.lit(False))).count() == 0


def test_title_descriptors(spark):
    lines = P.print_lines(pages(spark, "1 TITLE I\n2 DEPARTMENT OF ROADS\n3 TITLE II\n4 prose\n5 TITLE III\n6 SEC. 1. X\n7 TITLE IV"))
    assert {r["line_number"]: r["descriptor"] for r in A.title_descriptors(lines).collect()} == {1: "DEPARTMENT OF ROADS", 3: "", 5: "", 7: ""}
