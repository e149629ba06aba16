"""Snapshot differences against a plain comparison of dictionaries."""

import random
from datetime import datetime, timedelta

from helpers import rows

from lexdelta.operators.snapshots import node_rows, snapshot_diff

SCHEMA = "g string, v int, a string, b string, h bigint, at timestamp_ntz, n bigint"
T0 = datetime(2024, 1, 1)


def diff(spark, data, **kw):
    df = spark.createDataFrame(data, SCHEMA)
    return rows(snapshot_diff(df, "g", "v", ["a", "b"], "h", ["at", "n"], **kw))


def plain(data):
    snap = {}
    for g, v, a, b, h, at, n in data:
        if g is None or v is None:
            continue
        s = snap.setdefault(g, {}).setdefault(v, {})
        order = (at is not None, at or T0, n is not None, n or 0)
        if (a, b) not in s or order >= s[a, b][0]:
            s[a, b] = (order, h)
    out = set()
    for g, vs in snap.items():
        for o, w in zip(sorted(vs), sorted(vs)[1:]):
            x, y = vs[o], vs[w]
            out |= {(g, o, w, *k, "removed") for k in x.keys() - y.keys()} | {(g, o, w, *k, "added") for k in y.keys() - x.keys()}
            out |= {(g, o, w, *k, "changed") for k in x.keys() & y.keys() if x[k][1] != y[k][1]}
    return out


def test_random_snapshots(spark):
    rnd = random.Random(5)
    data = []
    for i in range(3000):
        g = "hot" if rnd.random() < 0.35 else f"g{rnd.randrange(30)}"
        data.append((g, rnd.choice([1, 2, 3, 5]), rnd.choice(["x", "y", None]), f"k{rnd.randrange(60)}", rnd.randrange(3), T0 + timedelta(hours=rnd.randrange(5)), i))
    data += data[:50]  # repeated rows
    for leaves, fan in ((64, 8), (1, 1), (7, 3)):
        assert diff(spark, data, leaves=leaves, fan=fan) == plain(data)


def test_edges(spark):
    assert diff(spark, []) == set()
    assert diff(spark, [("g", 1, "a", "b", 1, T0, 1)]) == set()
    data = [(None, 1, "a", "b", 1, T0, 1), ("g", None, "a", "b", 1, T0, 2), ("g", 1, None, None, 1, None, 3), ("g", 2, None, None, 2, T0, 4), ("g", 2, None, None, 9, None, None)]
    assert diff(spark, data) == {("g", 1, 2, None, None, "changed")}


def test_clashing_columns(spark):
    df = spark.createDataFrame([("g", 1, "a", "b", 1, T0, 1, 7, 8), ("g", 2, "a", "b", 2, T0, 2, 7, 8)], SCHEMA + ", _g int, change_type int")
    assert rows(snapshot_diff(df, "g", "v", ["a", "b"], "h", ["at", "n"])) == {("g", 1, 2, "a", "b", "changed")}


def test_versions_from_labels_and_white_space(spark):
    nodes = "node_id bigint, bill_id string, version_no int, version_label string, match_path array<string>, division_label string, header_text string, body_text string, loaded_at timestamp_ntz, version int"
    long_ = "word " * 50_000
    data = [
        (1, "b", 1, "intro", ["Sec.  1 "], "Division A: Roads", "H", "one\ntwo", T0, 9), (2, "b", None, "final", ["sec. 1"], "Division C:  roads", "H", "one two", T0, 9),
        (3, "b", None, "unknown", ["sec. 2"], "", None, None, T0, 9), (4, "b", 1, "intro", ["sec. 3"], None, "", long_, T0, 9), (5, "b", None, "final", ["sec. 3"], "", "", long_ + "x", T0, 9),
        (6, "b", 1, "intro", None, None, None, None, T0, 9),
    ]
    versions = spark.createDataFrame([("b", "final", 2), ("b", "final", 2), ("b", None, 3), (None, "final", 4)], "bill_id string, version_label string, version_no int")
    r = node_rows(spark.createDataFrame(data, nodes), versions)
    got = rows(snapshot_diff(r, "bill_id", "version", ["division_title", "path_text"], "content", ["loaded_at", "node_id"]))
    assert got == {("b", 1, 2, "", "sec. 3", "changed"), ("b", 1, 2, "", "", "removed")}
