"""The comparison pipeline against a direct one over Python lists, and its invariants."""

import difflib
import random
from collections import Counter

from lexdelta.functions import kernels as K
from lexdelta.functions.text import collapse
from lexdelta.operators import compare as C

SCHEMA = "pair_id string, side string, node_ord int, match_path array<string>, display_path array<string>, element_id string, body_text string, section_number string, division_label string"


def norm(t):
    return " ".join((t or "").split())


def div(label):
    return norm(label.split(":", 1)[1].lower()) if ":" in (label or "") else ""


def ratio(a, b):
    return difflib.SequenceMatcher(None, norm(a).split(), norm(b).split()).ratio()


def claim(lefts, rights, allowed, score):
    """Again and again the best pair that is free; of equal ones the later."""
    made, lefts, rights = [], list(lefts), list(rights)
    while open_ := [(score(x, y), i, j) for i, x in enumerate(lefts) for j, y in enumerate(rights) if x is not None and y is not None and allowed(x, y)]:
        _, i, j = max(open_)
        made.append((lefts[i], rights[j]))
        lefts[i] = rights[j] = None
    return made, [x for x in lefts if x], [y for y in rights if y]


def collide(a, b):
    order = list(dict.fromkeys(div(n[8]) for n in (*a, *b)))
    a, b = (sorted(x, key=lambda n: order.index(div(n[8]))) for x in (a, b))
    score = lambda x, y: ratio(x[6], y[6])
    same, a, b = claim(a, b, lambda x, y: div(x[8]) == div(y[8]), score)
    apart, a, b = claim(a, b, lambda x, y: True, score)
    return [*sorted(same, key=lambda p: order.index(div(p[0][8]))), *apart, *((x, None) for x in a), *((None, y) for y in b)]


def plain(old, new):
    """Changes of one pair as (type, old id, new id) in order, worked out on lists by the standard library alone."""
    paths = dict.fromkeys([tuple(n[3]) for n in old] + [tuple(n[3]) for n in new])
    changes = []
    for p in paths:
        a, b = [n for n in old if tuple(n[3]) == p], [n for n in new if tuple(n[3]) == p]
        for o, n in [((a or [None])[0], (b or [None])[0])] if len(a) <= 1 and len(b) <= 1 else collide(a, b):
            if o and n:
                if norm(o[6]) == norm(n[6]):
                    changes.append(("unchanged", o, n))
                elif ratio(o[6], n[6]) < 0.4:
                    changes += [("removed", o, None), ("added", None, n)]
                else:
                    changes.append(("modified", o, n))
            else:
                changes.append(("removed" if o else "added", o, n))
    gone, come = [c for c in changes if c[0] == "removed"], [c for c in changes if c[0] == "added"]
    moved, _, _ = claim(gone, come, lambda r, x: ratio(r[1][6], x[2][6]) >= 0.6, lambda r, x: ratio(r[1][6], x[2][6]))
    used = {id(c) for pair in moved for c in pair}
    out = [c for c in changes if id(c) not in used] + [("moved", r[1], x[2]) for r, x in moved]
    return [(t, o[5] if o else "", n[5] if n else "") for t, o, n in out]


def version(rnd, pair, side, n, texts):
    out = []
    for i in range(n):
        t = list(rnd.choice(texts))
        if rnd.random() < 0.15:
            t = [" "]  # an empty text
        for _ in range(rnd.choice([0, 0, 1, 3]) if t != [" "] else 0):
            t[rnd.randrange(len(t))] = rnd.choice("uvwxyz")
        path = [rnd.choice(["a", "b"]), f"sec. {rnd.randrange(12)}"][: rnd.randrange(3)]
        out.append((pair, side, i, path, path, f"{side}{i}", (" " if rnd.random() < 0.7 else "\n").join(t), f"Sec. {i}" if rnd.random() < 0.5 else "", rnd.choice(["", "Division A: X", "Division B: X", "Division B: Y"])))
    return out


def test_random_pairs(spark):
    rnd = random.Random(8)
    texts = [[rnd.choice("abcdefghij") for _ in range(rnd.randrange(6, 14))] for _ in range(10)]
    pairs = {f"p{k}": (version(rnd, f"p{k}", "old", rnd.randrange(1, 18), texts), version(rnd, f"p{k}", "new", rnd.randrange(1, 18), texts)) for k in range(12)}
    df = spark.createDataFrame([n for o, w in pairs.values() for n in (*o, *w)], SCHEMA)
    got = C.compare(df).orderBy("pair_id", "change_no").collect()
    # all comparisons large, and some
    for bounds in ({"most_pairs": 0}, {"most_pairs": 9}, {"most_texts": 3}):
        assert C.compare(df, **bounds).orderBy("pair_id", "change_no").collect() == got
    kinds = Counter()
    for p, (old, new) in pairs.items():
        mine = [(r["change_type"], r["element_id_old"], r["element_id_new"]) for r in got if r["pair_id"] == p]
        assert mine == plain(old, new)
        kinds.update(t for t, *_ in mine)
        # every node is in exactly one change of its side
        assert Counter(o for _, o, _ in mine if o) == Counter(n[5] for n in old)
        assert Counter(n for _, _, n in mine if n) == Counter(n[5] for n in new)
    assert min(kinds.values()) > 0 and len(kinds) == 5


def test_any_number_of_partitions(spark):
    rnd = random.Random(3)
    texts = [[rnd.choice("abcdef") for _ in range(8)] for _ in range(5)]
    data = version(rnd, "p", "old", 20, texts) + version(rnd, "p", "new", 20, texts)
    seen = set()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.add(str([tuple(r) for r in C.compare(spark.createDataFrame(data, SCHEMA).repartition(int(n))).orderBy("change_no").collect()]))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.compare(none).count() == 0
    df = spark.createDataFrame([("p", "old", 0, None, None, None, None, None, None), ("p", "new", 0, [], None, None, "", None, None), (None, "old", 0, ["x"], None, "e", "t", "", ""), ("p", "third", 0, ["x"], None, "e", "t", "", "")], SCHEMA)
    (r,) = C.compare(df).collect()
    assert (r["change_type"], r["old_text"], r["new_text"]) == ("unchanged", "", "")


def test_summary_filter_and_money(spark):
    rows = [("p", "old", 0, ["a", "sec. 1"], ["A"], "o0", "pay $5 to all of them", "", ""), ("p", "new", 0, ["a", "sec. 1"], ["A"], "n0", "pay $6 to all of them", "", ""), ("p", "old", 1, ["b"], ["B"], "o1", "same", "", ""), ("p", "new", 1, ["b"], ["B"], "n1", "same", "", "")]
    c = C.compare(spark.createDataFrame(rows, SCHEMA))
    assert {r["change_type"]: r["n"] for r in C.summary(c).collect()} == {"added": 0, "removed": 0, "modified": 1, "unchanged": 1, "moved": 0}
    assert C.filter_changes(c, "SEC. 1", financial=True).count() == 1 and C.filter_changes(c, "zzz").count() == 0 and C.filter_changes(c, include_unchanged=True).count() == 2
    f = {r["change_type"]: r["financial"] for r in C.with_money(c).collect()}
    assert f["unchanged"] is None and f["modified"]["amounts_changed"] and [tuple(p) for p in f["modified"]["paired_amounts"]] == [(5, 6)]
    assert [(r["old_amount"], r["new_amount"], r["delta"]) for r in C.money_rows(C.with_money(c)).collect()] == [(5, 6, 1)]
    assert c.select(collapse("old_text").alias("x")).count() == 2


def test_moves_exactly_on_the_threshold(spark):
    """Texts of which one is wholly in the other, at ratio 0.6, and share only words that are not the rarest."""
    rows = []
    for n, m in ((15, 35), (27, 63), (30, 70), (51, 119), (6, 14)):
        shared = [f"s{i}" for i in range(n)]
        assert K.seq_ratio(" ".join(shared), " ".join(shared + [f"x{i}" for i in range(m - n)])) == 0.6
        rows.append((f"p{m}", "old", 0, ["a"], ["A"], "o", " ".join(shared), "", ""))
        rows.append((f"p{m}", "new", 0, ["b"], ["B"], "n", " ".join(shared + [f"x{i}" for i in range(m - n)]), "", ""))
    got = C.compare(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["pair_id"], r["change_type"]) for r in got} == {(f"p{m}", "moved") for m in (35, 63, 70, 119, 14)}
