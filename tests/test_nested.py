"""Flat tables of nested payloads against a recursive walk."""

import json

from helpers import rows

from lexdelta.operators import nested


def walk(key, payload):
    try:
        tree = json.loads(payload)["tree"]
    except (TypeError, ValueError, KeyError):
        return set()
    out = set()

    def go(side, entries, parent):
        entries = entries if isinstance(entries, list) else [entries]
        for n, e in enumerate((e for e in entries if isinstance(e, dict)), 1):
            pos = f"{parent}.{n}" if parent else str(n)
            out.add((key, side, pos, parent))
            go(side, e.get("children"), pos)

    sided = isinstance(tree, dict) and ("v1" in tree or "v2" in tree)
    for side, entries in (tree.items() if sided else [("v1", tree)]):
        go(side, entries, "")
    return out


def deep(n):
    return {"label": "x", "children": [deep(n - 1)]} if n else {"label": "leaf"}


PAYLOADS = [
    '{"tree": {"v1": [{"label": "a", "children": [null, {"label": "b", "children": {"label": "c"}}]}], "v2": null}}', '{"tree": [{"label": "z"}, null, {"label": "y", "children": null}]}', '{"tree": ', "", None, "{}", '{"tree": null}',
    '{"tree": {"v2": [{"label": "only", "own_amounts": ["$33,000", 5]}]}}', json.dumps({"tree": {"v1": [deep(12)]}}), json.dumps({"tree": [{"label": str(i)} for i in range(3000)]}), '{"tree": {"label": "lone"}}', '{"tree": {"v1": null, "v2": null}}', '{"tree": {"v1": [], "v2": {"label": "one"}}}', '{"tree": "text"}', "[1, 2]",
]


def table(spark, payloads):
    return spark.createDataFrame([(i, p, "clash", "clash") for i, p in enumerate(payloads)], "tree_id bigint, payload string, node_pos string, _key string")


def test_nodes(spark):
    data = PAYLOADS + PAYLOADS[:2]  # repeated deliveries have ids of their own
    got = rows(nested.explode_tree(table(spark, data), "tree_id", "payload").select("tree_id", "tree_side", "node_pos", "parent_pos"))
    assert got == set().union(*(walk(i, p) for i, p in enumerate(data)))


def test_parents_exist_and_amounts(spark):
    nodes = nested.explode_tree(table(spark, PAYLOADS), "tree_id", "payload")
    keys = {r["node_key"] for r in nodes.select("node_key").collect()}
    assert all(r["parent_key"] in keys for r in nodes.where("parent_key is not null").select("parent_key").collect())
    got = rows(nested.amount_table(nodes, "tree_id"))
    assert got == {(7, "v2", "1", "7/v2/1", 1, 33000), (7, "v2", "1", "7/v2/1", 2, 5)}


def test_forms_of_display_path(spark):
    p = ['{"tree": [{"display_path": "A > B"}, {"display_path": ["A", "B"]}, {"label": 3, "source": {"division_label": "D"}}]}']
    got = [tuple(r) for r in nested.node_table(nested.explode_tree(table(spark, p), "tree_id", "payload"), "tree_id").orderBy("ordinal").select("display_path", "division_label").collect()]
    assert got == [(["A", "B"], None), (["A", "B"], None), (None, "D")]


def test_empty_and_schema(spark):
    assert rows(nested.explode_tree(table(spark, []).where("false"), "tree_id", "payload")) == set()
    got = {(r["path"], r["type"]): (r["n"], r["max_depth"]) for r in nested.merged_schema(table(spark, PAYLOADS[:1]), "payload").collect()}
    assert got["$.tree.v1[]", "object"][1] == 2 and ("$.tree.v2", "null") in got
