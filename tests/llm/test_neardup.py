"""Near-duplicates against brute force."""

import random

import numpy as np
from helpers import rows

from lexdelta.llm import neardup as N
from lexdelta.llm.words import shingle_set, words

SCHEMA = "field string, id bigint, grp string, text string, f int, k string, cls string"


def texts(rnd, n, vocabulary=400):
    out = []
    for _ in range(n):
        base = [f"w{rnd.randrange(vocabulary)}" for _ in range(rnd.randrange(20, 60))]
        out.append(base)
        for _ in range(rnd.randrange(3)):
            t = list(base)
            for _ in range(rnd.randrange(1, 5)):
                t[rnd.randrange(len(t))] = f"w{rnd.randrange(vocabulary)}"
            out.append(t)
    return [" ".join(t) for t in out]


def brute(data, shingle=3, least=25, threshold=0.6):
    out = set()
    kept = [(f, i, g, shingle_set(t, shingle)) for f, i, g, t, *_ in data if t and len(words(t)) >= least]
    for n, (f, i, g, s) in enumerate(kept):
        for f2, i2, g2, s2 in kept[n + 1 :]:
            if f == f2 and g is not None and g2 is not None and g != g2 and len(s & s2) / len(s | s2) >= threshold:
                out.add((f, min(i, i2), max(i, i2)))
    return out


def frame(spark, data):
    return spark.createDataFrame([(*r, 1, "k", "c") for r in data], SCHEMA)


def test_against_brute_force(spark):
    rnd = random.Random(11)
    data = [(rnd.choice(["a", "b"]), i, rnd.choice(["g1", "g2", "g3", None]), t) for i, t in enumerate(texts(rnd, 120))]
    data += [("a", 10_000 + i, f"c{i % 3}", data[0][3]) for i in range(40)]  # a hot group of copies
    data += [("a", 20_000, "g1", None), ("a", 20_001, "g1", ""), ("a", 20_002, "g2", "too short"), ("b", 20_003, None, data[0][3]), ("a", 20_004, "g1", data[0][3].upper() + "!")]
    want = brute(data)
    assert len(want) > 500
    assert rows(N.NearDuplicates(frame(spark, data)).expanded()) == want
    # a sketch that tells nothing, every list and every class of copies split
    assert rows(N.NearDuplicates(frame(spark, data), buckets=1, block=2, copies=7).expanded()) == want


def test_members_and_pairs(spark):
    t = " ".join(f"w{i}" for i in range(40))
    u = t.replace("w3 ", "x ")
    found = N.NearDuplicates(frame(spark, [("a", 1, "g", t), ("a", 2, "g", t), ("a", 3, "h", u), ("a", 4, "h", "short")]))
    assert rows(found.members.select("id", "rep")) == {(1, 1), (2, 1), (3, 3)}
    (pair,) = found.pairs.collect()
    assert (pair["a"], pair["b"]) == (1, 3) and abs(pair["similarity"] - 35 / 41) < 1e-9


def test_empty_and_very_long(spark):
    assert rows(N.NearDuplicates(frame(spark, []).where("false")).expanded()) == set()
    rnd = random.Random(2)
    big = " ".join(f"w{rnd.randrange(5000)}" for _ in range(60_000))
    assert rows(N.NearDuplicates(frame(spark, [("a", 1, "g", big), ("a", 2, "h", big + " end")])).expanded()) == {("a", 1, 2)}


def test_lists_are_merged_whole():
    rng = np.random.default_rng(0)
    for sizes in ([1, 5, 300, 2, 1, 700], [1], [2, 2]):
        n = sum(sizes)
        sig = [rng.integers(0, 2, n).astype(np.uint64) * np.uint64((1 << 60) - 1) for _ in range(2)]
        for split in (False, True):
            side = np.concatenate([np.sort(rng.integers(0, 2 if split else 1, s)) for s in sizes])
            k = np.repeat(np.arange(len(sizes)), sizes) * 2 + side
            got = [(int(x), int(y)) for a, b in N._merge(sig, *N._partners(k), block=97) for x, y in zip(a, b)]
            want, at = set(), 0
            for s in sizes:
                part = range(at, at + s)
                both = len({side[i] for i in part}) > 1
                want |= {(i, j) for i in part for j in part if i < j and (side[i] < side[j] or not both) and sum(15 * int(c[i] == c[j]) for c in sig) >= N.NEED}
                at += s
            assert len(got) == len(set(got))
            # a list whose rows are all of the second side has no pairs of its own
            alone = {p for p in want if side[p[0]] == side[p[1]] == 1}
            assert set(got) | alone == want


def test_lanes_are_counted_alone():
    rng = np.random.default_rng(1)
    lanes = rng.integers(0, 16, (2, 500, 30)).astype(np.uint64)
    lanes[1, :, ::3] = lanes[0, :, ::3]
    pack = lambda v: [np.bitwise_or.reduce(v[:, j : j + 15] << (np.uint64(4) * np.arange(15, dtype=np.uint64)), axis=1) for j in (0, 15)]
    assert (N._collisions(pack(lanes[0]), pack(lanes[1])) == (lanes[0] == lanes[1]).sum(1)).all()


def test_prefixes_lose_no_candidate():
    """Rows with NEED equal coordinates share a key of their prefixes, whatever the sketch says."""
    rng = np.random.default_rng(7)
    for _ in range(200):
        a, b = rng.integers(0, 1 << 62, (2, N.LANES)).astype(np.uint64)
        same = rng.choice(N.LANES, N.NEED, replace=False)
        b[same] = a[same]
        keys = np.stack([a, b])
        at = N._prefix(keys, rng.integers(0, 5, 64))
        assert set(a[at[0]]) & set(b[at[1]])
