"""Which versions the comparison queries read."""

import json

import pytest

from lexdelta.plans import documents, structure, versions


def write(spark, d, nodes):
    kind = "node_id bigint, bill_id string, version_no int, version_label string, node_ord int, match_path array<string>, display_path array<string>, tag string, element_id string, header_text string, body_text string, section_number string, division_label string, display_text string, loaded_at timestamp"
    spark.createDataFrame(nodes, kind).write.parquet(f"{d}/bill_nodes.parquet")
    spark.createDataFrame([("118-hr-1", "z", 3)], "bill_id string, version_label string, version_no int").write.parquet(f"{d}/bill_versions.parquet")
    return d


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """Bill 1 has versions 1, 2, 3 (one by its label), 2 has 1 and 3, 3 has 4 and 6, 4 has one version."""
    at = [("118-hr-1", 1, "x"), ("118-hr-1", 2, "y"), ("118-hr-1", None, "z"), ("118-hr-2", 1, "x"), ("118-hr-2", 3, "z"), ("118-hr-3", 4, "x"), ("118-hr-3", 6, "y"), ("118-hr-4", 1, "x")]
    nodes = [(k, b, v, l, 0, ["sec. 1"], ["Sec. 1"], "section", f"e{k}", "", f"pay ${k + 1} to all of them", "1", "", "", None) for k, (b, v, l) in enumerate(at)]
    return write(spark, str(tmp_path_factory.mktemp("versions")), nodes)


@pytest.fixture(scope="module")
def shown(spark, tmp_path_factory):
    """Two versions of a bill whose nodes have tags, headers and readable texts."""
    nodes = []
    for v in (1, 2):
        nodes.append((10 * v, "118-hr-5", v, "x", 0, ["front"], [], "official-title", f"t{v}", "MASTHEAD", "To pay.", "", "", "", None))
        nodes.append((10 * v + 1, "118-hr-5", v, "x", 1, ["title i", "roads"], ["TITLE I", "ROADS"], "appropriations-intermediate", f"r{v}", "ROADS", "", "", "", "", None))
        nodes.append((10 * v + 2, "118-hr-5", v, "x", 2, ["title i", "roads", "paths"], ["TITLE I", "ROADS", "PATHS"], "appropriations-small", f"p{v}", "PATHS", f"(1) pay ${v}", "", "", f"(1) pay ${v}, of which $7", None))
    return write(spark, str(tmp_path_factory.mktemp("shown")), nodes)


PAIRS = {("118-hr-1:1-2", 1, 2), ("118-hr-1:2-3", 2, 3), ("118-hr-2:1-3", 4, 5), ("118-hr-3:4-6", 6, 7)}


def test_every_neighbouring_pair_is_compared(spark, data):
    assert {(r["pair_id"], r["old_amount"], r["new_amount"]) for r in versions.compare_money(spark, data).collect()} == PAIRS
    got = [(r["pair_id"], r["change_type"]) for r in versions.compare_changes(spark, data).collect()]
    assert sorted(got) == sorted((p, "modified") for p, _, _ in PAIRS)


def test_every_neighbouring_pair_is_published(spark, data):
    got = {r["pair_id"]: json.loads(r["canonical"]) for r in documents.xml_documents(spark, data).collect()}
    assert got.keys() == {p for p, _, _ in PAIRS}
    assert all(len(c["changes"]) == 1 for c in got.values())


def test_trees_have_levels_headers_and_readable_texts_of_every_version(spark, shown):
    got = {r["doc_id"]: json.loads(r["tree"]) for r in structure.tree_json(spark, shown).collect()}
    assert got.keys() == {"118-hr-5:1", "118-hr-5:2"}
    for v in (1, 2):
        front, title = got[f"118-hr-5:{v}"]
        assert [c["label"] for c in front["children"]] == ["MASTHEAD"]
        (roads,) = title["children"]
        (paths,) = roads["children"]
        assert (title["level"], roads["level"], paths["level"], paths["own_amounts"]) == ("title", "agency", "account", [v, 7])


def test_spans_are_those_of_the_readable_text(spark, shown):
    got = {(r["doc_id"], r["element_id"]): r["end_char"] - r["start_char"] for r in structure.body_spans(spark, shown).collect()}
    assert got == {(f"118-hr-5:{v}", f"{e}{v}"): n for v in (1, 2) for e, n in (("t", len("To pay.")), ("p", len("(1) pay $1, of which $7")))}


def test_published_texts_are_the_readable_ones(spark, shown):
    (r,) = documents.xml_documents(spark, shown).collect()
    assert r["pair_id"] == "118-hr-5:1-2"
    assert all(x in r["canonical"] for x in ("MASTHEAD", "(1) pay $1, of which $7", "(1) pay $2, of which $7", '"agency"'))
