from helpers import rows

from lexdelta.llm import linkage as L

A = "account_id bigint, report_pkg string, heading string, title string, bureau string, amount_text string, unit_note string, n string, rid int"
N = "node_id bigint, bill_id string, match_path array<string>, header_text string, body_text string, v string"
V = "validation_id bigint, bill string, title string, bureau string, excel_name string, match_path array<string>, expected_amount bigint, note string, b string"
T1, B1, B2 = "Department of Roads", "Bureau of Bridges", "Office of Ferries"


def node(i, bill, bureau, name, amount):
    return (i, bill, [T1.lower(), bureau.lower(), name.lower()], name, f"For x, ${amount:,}, to remain.", "c")


NODES = [
    node(1, "118-hr-5", B1, "Bridge Repairs and Surveys", 1_000_000), node(2, "118-hr-5", B2, "Staff and Operating Costs", 2_000_000), node(3, "118-hr-5", B1, "Staff and Operating Costs", 3_456_000), node(4, "118-hr-5", B2, "Ferry Construction, Coastal Fleet", 4_000_000),
    node(5, "118-hr-9", B1, "Bridge Repairs and Surveys", 9_000_000), node(6, "118-hr-9", B2, "Harbor Dredging", 8_000_000), node(7, "118-hr-9", B2, "Harbor Lights", 8_500_000), node(8, "118-hr-5", B2, "Ferry Construction, Coastal Fleet", 4_000_000),
    (9, "118-hr-5", None, None, None, "c"), (10, None, [T1], "X", "", "c"),
]
ACCOUNTS = [
    (1, "CRPT-118hrpt1", "BRIDGE REPAIRS & SURVEYS", T1.upper(), B1, "$1,000,000", None), (2, "CRPT-118hrpt1", "STAFF AND OPERATING COSTS [$000]", T1, None, "3,456", None), (3, "CRPT-118hrpt1", "STAFF AND OPERATING COSTS", T1, "Ferries Office", "$2,000,000", None),
    (4, "CRPT-118hrpt1", "COASTAL FLEET FERRY CONSTR.", T1, B2, "such sums", None), (5, "CRPT-118hrpt2", "HARBOR DREDGIING", T1, B2, "$8,000,000", None), (6, "CRPT-118hrpt2", "HARBOR LIGHTS", T1, B2, None, None), (7, "CRPT-118hrpt2", "NOT IN THE BILL", T1, B2, "$1", None),
    (8, "CRPT-118hrpt1", "BRIDGE REPAIRS AND SURVEYS", T1, B1, "$1,000,000", None), (9, None, None, None, None, None, None), (10, "CRPT-118hrpt2", "Quay Works", T1, B1, "$77,000", None),
]
TRUTH = [
    (1, "118-hr-5", T1, B1, "Bridge Repairs and Surveys", [T1.lower(), B1.lower(), "bridge repairs and surveys"], 1_000_000, None), (2, "118-hr-9", T1, None, "Harbor Dredging [000s]", None, 8_000, None), (3, "118-hr-9", None, None, None, None, None, None), (4, "118-hr-9", T1, B1, "Quay Works", None, 77_000, None),
]


def links(spark, accounts=ACCOUNTS, nodes=NODES, truth=TRUTH):
    f = lambda data, s, n: spark.createDataFrame([(*r, *("c" for _ in range(n)))[: len(s.split(", "))] for r in data], s)
    return L.AccountLinks(spark.createDataFrame([(*r, "c", 1) for r in accounts], A), f(nodes, N, 0), spark.createDataFrame([(*r, "c") for r in truth], V))


def test_matches(spark):
    got = rows(links(spark).links().select("account_id", "other_table", "other_id"))
    nodes = {(a, i) for a, t, i in got if t == "bill_nodes"}
    truth = {(a, i) for a, t, i in got if t == "validation_defense"}
    assert nodes == {(1, 1), (8, 1), (2, 3), (3, 2), (4, 4), (4, 8), (5, 6), (6, 7)}
    assert truth == {(1, 1), (8, 1), (5, 2), (10, 4)}


def test_confidence(spark):
    found = links(spark)
    conf = {r["rule"]: r for r in found.confidence().collect()}
    assert (conf["tbn"]["n_labelled"], conf["tbn"]["n_right"]) == (1, 1)
    assert all(0 < r["confidence"] < 1 for r in conf.values())
    assert all(0 < r["confidence"] < 1 for r in found.links().collect())


def test_repeated_rows_and_empty_tables(spark):
    more = NODES + [(i + 100, *r) for i, *r in NODES]
    got = rows(links(spark, nodes=more).links().where("other_table = 'bill_nodes'").select("account_id", "other_id"))
    assert {(1, 1), (1, 101), (4, 4), (4, 8), (4, 104), (4, 108)} <= got
    assert rows(links(spark, nodes=[], truth=[]).links()) == set()
    assert rows(links(spark, accounts=[]).links()) == set()
