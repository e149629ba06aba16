import random

import numpy as np
from helpers import rows

from lexdelta.llm import leakage as L
from lexdelta.llm.words import words


def brute(docs, tests, n):
    out = set()
    for d, t in docs:
        w = words(t)
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i, x in tests:
            v = words(x)
            if any(tuple(v[k : k + n]) in grams for k in range(len(v) - n + 1)):
                out.add((d, i))
    return out


def frames(spark, docs, tests):
    return spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, _text string, _id int"), spark.createDataFrame(tests, "item_id bigint, text string")


def make(seed=4, vocabulary=30):
    rnd = random.Random(seed)
    run = lambda n: " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))
    tests = [(i, run(rnd.randrange(5, 60))) for i in range(25)] + [(25, None), (26, ""), (27, "w1")]
    docs = [(i, run(rnd.randrange(0, 120))) for i in range(120)]
    for i in range(120, 260):
        w = words(rnd.choice(tests[:25])[1])
        a = rnd.randrange(len(w))
        docs.append((i, run(10) + ". " + ", ".join(w[a : a + rnd.randrange(1, 40)]).upper() + " " + run(10)))
    docs += [(300, None), (301, ""), (302, tests[0][1]), (303, tests[0][1]), (304, run(100_000) + " " + tests[1][1])]
    tests.append((28, tests[0][1]))  # a repeated test
    return docs, tests


def test_against_brute_force(spark):
    docs, tests = make()
    d, t = frames(spark, docs, tests)
    for n in (3, 4, 7, 18):
        want = brute(docs, tests, n)
        assert rows(L.leaked(d, t, min_words=n, shard_words=500, block_chars=600).select("doc_id", "item_id").distinct()) == want
    assert rows(L.leaked_items(L.leaked(d, t))) == brute(docs, tests, 18)


def test_longest_match_and_place(spark):
    w = [f"w{i}" for i in range(60)]
    d, t = frames(spark, [(1, "a b " + " ".join(w[5:45]) + " z " + " ".join(w[:20])), (2, " ".join(w[:17]))], [(7, " ".join(w))])
    assert rows(L.leaked(d, t)) == {(1, 7, 2, 5, 40), (1, 7, 43, 0, 20)}


def brute_matches(tokens, tests, n):
    out = set()
    for i in range(len(tokens)):
        for j in range(len(tests)):
            if i and j and tokens[i - 1] == tests[j - 1] > 0:
                continue
            k = 0
            while i + k < len(tokens) and j + k < len(tests) and tokens[i + k] == tests[j + k] > 0:
                k += 1
            if k >= n:
                out.add((i, j, k))
    return out


def test_matches_of_a_shard_against_brute_force():
    rng = np.random.default_rng(5)
    for vocabulary, n, part in ((3, 3, 7), (2, 4, 1 << 20), (6, 2, 50), (1, 5, 3)):
        test = [" ".join(f"w{x}" for x in rng.integers(0, vocabulary, k)) for k in (0, 3, 20, 20)]
        block = L.TestBlock(list(range(4)), test)
        tokens = rng.integers(0, len(block.vocabulary) + 1, 150) * (rng.random(150) > 0.05)
        got = [tuple(map(int, r)) for part_ in L.search_shard(tokens, block, n, part) for r in part_]
        assert len(got) == len(set(got)) and set(got) == brute_matches(tokens.tolist(), block.tokens.tolist(), n)


def test_suffix_array_is_in_order():
    rng = np.random.default_rng(6)
    for top in (2, 3, 50):
        t = np.r_[rng.integers(0, top, 200), 0]
        rest = lambda i: tuple(t[i : i + int(np.flatnonzero(t[i:] == 0)[0])])
        got = L.suffix_array(t).tolist()
        assert sorted(got) == np.flatnonzero(t).tolist()
        assert [rest(i) for i in got] == sorted(rest(i) for i in got)


def test_a_passage_held_by_all_is_expanded_in_parts():
    text = " ".join(f"w{i}" for i in range(40))
    block = L.TestBlock(list(range(300)), [text] * 300)
    tokens = np.tile(np.r_[np.arange(1, 41), 0], 200)
    parts = list(L.search_shard(tokens, block, 18, 5000))
    assert len(parts) > 10 and sum(map(len, parts)) == 300 * 200 and max(map(len, parts)) <= 5200


def test_empty_tables(spark):
    d, t = frames(spark, *make())
    assert rows(L.leaked(d.where("false"), t)) == set()
    assert rows(L.leaked(d, t.where("false"))) == set()


def test_removal(spark):
    docs, tests = make()
    d, t = frames(spark, docs, tests)
    found = L.leaked(d, t)
    left = {r["doc_id"] for r in L.without_leaks(d, found).collect()}
    assert left == {i for i, _ in docs} - {i for i, _ in brute(docs, tests, 18)}
