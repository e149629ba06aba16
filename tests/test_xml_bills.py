"""The XML source on small documents of every shape."""

from lexdelta.sources import xml_bills as X


def nodes(body, root="bill", extra=""):
    return X.parse_bill(f"<{root}>{extra}{body}</{root}>", "3_reported-in-house")[1]


def brief(ns):
    return [(n["match_path"], n["display_path"], n["body_text"]) for n in ns]


def test_bare_sections():
    got = nodes('<legis-body><section id="s1"><enum>1.</enum><header>Short title</header><text>This <quote>Act</quote> may be cited.</text></section><section><enum>2.</enum></section></legis-body>')
    assert brief(got) == [(["sec. 1"], ["Sec. 1"], "This Act may be cited.")]
    assert (got[0]["element_id"], got[0]["header_text"], got[0]["section_number"], got[0]["tag"]) == ("s1", "Short title", "Sec. 1", "section")


def test_titles_and_accounts_carry_forward():
    body = (
        "<legis-body><title><enum>I</enum><header>Roads</header><appropriations-major><header>Highways</header></appropriations-major>"
        "<appropriations-intermediate><header>Bridges</header><text>For bridges, $5.</text></appropriations-intermediate>"
        "<appropriations-small><header>(including transfer)</header><text>Of which $2.</text></appropriations-small>"
        "<appropriations-small><header>Bridges</header><text>Same name.</text></appropriations-small>"
        "<section><enum>101.</enum><text>General.</text></section></title></legis-body>"
    )
    assert brief(nodes(body)) == [
        (["roads", "highways", "bridges"], ["TITLE I—Roads", "Highways", "Bridges"], "For bridges, $5."),
        (["roads", "highways", "bridges"], ["TITLE I—Roads", "Highways", "Bridges"], "Of which $2."),
        (["roads", "highways", "bridges"], ["TITLE I—Roads", "Highways", "Bridges"], "Same name."),
        (["roads", "highways", "bridges", "sec. 101"], ["TITLE I—Roads", "Highways", "Bridges", "sec. 101"], "General."),
    ]


def test_parenthetical_intermediate_stays_in_the_path():
    body = (
        "<legis-body><title><header>T</header><appropriations-intermediate><header>Ports</header><text>A.</text></appropriations-intermediate>"
        "<appropriations-intermediate><header>(aside)</header><text>B.</text></appropriations-intermediate>"
        "<appropriations-small><header>Piers</header><text>C.</text></appropriations-small></title></legis-body>"
    )
    assert [n["match_path"] for n in nodes(body)] == [["t", "ports"], ["t", "ports"], ["t", "(aside)", "piers"]]


def test_divisions_and_orphan_titles():
    body = (
        "<legis-body><division><enum>A</enum><header>First</header><title><enum>I</enum><section><enum>1</enum><text>x</text></section></title><section><enum>9</enum><text>not walked</text></section></division>"
        "<title><enum>II</enum><header>Loose</header><section><enum>2</enum><text>y</text></section></title><division><enum>B</enum><title><section><enum>3</enum><text>z</text></section></title></division></legis-body>"
    )
    got = nodes(body)
    assert [(n["division_label"], n["match_path"]) for n in got] == [("Division A: First", ["sec. 1"]), ("Division A: First", ["loose", "sec. 2"]), ("Division B", ["sec. 3"])]
    assert got[0]["display_path"] == ["Division A: First", "TITLE I", "sec. 1"]


def test_containers_nest():
    body = (
        "<legis-body><title><header>T</header><subtitle><header>A</header><part><header>B</header><chapter><header>C</header><section><enum>1</enum><text>x</text></section></chapter></part>"
        "<section><enum>2</enum><text>y</text></section></subtitle><section><enum>3</enum><text>z</text></section></title></legis-body>"
    )
    assert [n["match_path"] for n in nodes(body)] == [["t", "a", "b - c", "sec. 1"], ["t", "a", "sec. 2"], ["t", "sec. 3"]]


def test_section_with_accounts_and_with_levels():
    body = (
        '<legis-body><title><header>T</header><section><enum>5.</enum><text>Lead.</text><appropriations-small><header>Acc</header><text>$1.</text></appropriations-small></section>'
        "<section><enum>6.</enum><subsection><enum>(a)</enum><header>Use</header><text>First <xref>one</xref>.</text></subsection><subsection><enum>(b)</enum><text>Second.</text></subsection></section></title></legis-body>"
    )
    got = nodes(body)
    assert [(n["match_path"], n["body_text"]) for n in got] == [(["t", "sec. 5"], "Lead."), (["t", "acc"], "$1."), (["t", "sec. 6"], "(a)Use First one.(b)Second.")]
    assert got[2]["display_text"] == "(a) Use First one.\n(b) Second."


def test_breaks_quotes_and_marks():
    body = "<legis-body><section><enum>1</enum><text>$5<linebreak/>each (1) x</text><quoted-block><text>Quoted.</text></quoted-block></section></legis-body>"
    assert nodes(body)[0]["body_text"] == "$5 each(1) x Quoted."


def test_amendments_front_matter_and_metadata():
    block = "<engrossed-amendment-body><amendment><amendment-block><section><enum>1</enum><text>x</text></section></amendment-block></amendment></engrossed-amendment-body>"
    assert brief(nodes(block, "amendment-doc")) == [(["sec. 1"], ["Sec. 1"], "x")]
    form = "<form><congress>One Hundred Eighteenth Congress</congress><session>2d Session</session><legis-num>H. R. 42</legis-num><official-title>Making  roads.</official-title></form>"
    meta, ns = X.parse_bill(f"<bill>{form}<legis-body><section><enum>1</enum><text>x</text></section></legis-body></bill>", "3_reported-in-house")
    assert meta == {"congress": 118, "bill_type": "hr", "bill_number": 42, "version_label": "reported-in-house", "official_title": "Making roads."}
    assert [n["element_id"] for n in ns[:3]] == ["front-matter-masthead", "front-matter-official-title", "front-matter-enacting-clause"]
    assert ns[0]["body_text"] == "One Hundred Eighteenth Congress\n2d Session\nH. R. 42"


def test_bad_documents_are_rows(spark):
    docs = spark.createDataFrame([("a/1_x.xml", "<bill><legis-body><section><enum>1</enum><text>t</text></section></legis-body></bill>"), ("2_y.xml", "<bill>"), ("3_z.xml", "<bill/>"), ("4.xml", None)], "path string, content string")
    got = X.parse_documents(docs)
    assert {r["doc_id"] for r in X.errors(got).collect()} == {"2_y.xml", "3_z.xml", "4.xml"}
    (n,) = got.where("error is null").collect()
    assert (n["version_label"], n["node_ord"], n["body_text"]) == ("x", 0, "t")
    assert X.parse_documents(docs.where("false")).count() == 0


class _Local:
    """Documents in this process: gives the batches that the parsing function hands on."""

    def __init__(self, docs):
        import pyarrow as pa

        self.table = pa.table({"k": [k for k, _ in docs], "c": pa.array([c for _, c in docs], pa.binary())})

    def select(self, *_):
        return self

    def mapInPandas(self, f, _):
        return [list(b.itertuples(index=False, name=None)) for b in f(b.to_pandas() for b in self.table.to_batches(700))]

    def mapInArrow(self, f, _):
        return [list(zip(*b.to_pydict().values())) for b in f(iter(self.table.to_batches(700)))]


def test_rows_of_short_documents_share_batches(spark):
    bill = b"<bill><legis-body><section><enum>%d</enum><text>t</text></section><section><enum>x</enum><text>u</text></section></legis-body></bill>"
    docs = [(f"{i}_y.xml", None if i % 50 == 0 else b"<bill>" if i % 50 == 1 else b"<bill><legis-body/></bill>" if i % 50 == 2 else bill % i) for i in range(3_000)]
    got = X.parse_documents(_Local(docs))
    assert [r for b in got for r in b] == [r for k, c in docs for r in X.node_rows(k, c)]
    assert sum(map(len, got)) == 60 + 60 + 2 * 47 * 60
    assert len(got) < 10


def test_batches_of_long_documents_are_bounded(spark):
    docs = [(f"{i}_y.xml", b"<bill><legis-body><section><enum>1</enum><text>" + b"t" * 1_500_000 + b"</text></section></legis-body></bill>") for i in range(7)]
    assert [len(b) for b in X.parse_documents(_Local(docs))] == [3, 3, 1]
    assert X.parse_documents(_Local([])) == []
