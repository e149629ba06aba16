import random
from collections import Counter

from helpers import rows
from pyspark.sql import functions as F

from lexdelta.operators import catalog


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_bag_similarity_is_the_quick_ratio(spark):
    import difflib

    rnd = random.Random(2)
    texts = [(i, " ".join(rnd.choice("abcdefg") for _ in range(rnd.randrange(1, 30))), " ".join(rnd.choice("abcdefg") for _ in range(rnd.randrange(1, 30)))) for i in range(60)] + [(60, None, "a"), (61, "a", None)]
    got = {r["k"]: r for r in catalog.bag_similarity(spark.createDataFrame(texts, "k int, o string, n string"), "k", "o", "n").collect()}
    assert set(got) == set(range(60))
    for k, o, n in texts[:60]:
        m = difflib.SequenceMatcher(None, o.split(), n.split())
        assert abs(got[k]["bag"] - m.quick_ratio()) < 1e-8 and abs(got[k]["length_bound"] - m.real_quick_ratio()) < 1e-8
        a, b = set(o.split()), set(n.split())
        assert abs(got[k]["jaccard"] - len(a & b) / len(a | b)) < 1e-8
        assert got[k]["class"] == ("below" if got[k]["bag"] < 0.4 else "between" if got[k]["bag"] < 0.6 else "above")


def test_levenshtein_counts_code_points(spark):
    pairs = [("kitten", "sitting"), ("é—“x", "e—”"), ("", "abc"), ("same", "same")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.levenshtein("a", "b").alias("d"))
    assert rows(df) == {(a, b, levenshtein(a, b)) for a, b in pairs}


def test_surveys(spark):
    c = spark.createDataFrame([(1, "b", ["p"], "removed", "x" * 60, None), (2, "b", ["p"], "added", None, "y" * 60), (3, "b", ["p"], "added", None, "short"), (4, "c", ["p"], "added", None, "y" * 60)], "change_id int, bill_id string, match_path array<string>, change_type string, old_text string, new_text string")
    assert rows(catalog.rewrite_candidates(c)) == {(1, 2)}
    assert rows(catalog.parity(c, c.where("change_type = 'added'"))) == {("removed", 1, 0), ("added", 3, 3)}
    t = lambda *x: spark.createDataFrame([(v,) for v in x], "t string")
    assert rows(catalog.vocabulary_overlap(t("a b", None), t("b c d"))) == {(1, 1, 2)}
    assert rows(catalog.find(spark.createDataFrame([(1, "Shall shall"), (2, "no"), (3, None)], "k int, t string"), "k", "t", "SHALL")) == {(1, 2)}
    assert rows(catalog.find(spark.createDataFrame([(1, "x")], "k int, t string"), "k", "t", "x")) == set()
    h = catalog.histogram(spark.createDataFrame([(0.0,), (0.05,), (0.95,), (1.0,)], "s double"), "s")
    assert Counter({r["bin"]: r["n"] for r in h.collect()}) == Counter({0: 2, 9: 2})
    assert rows(catalog.gap_clusters(spark.createDataFrame([("d", 1.0), ("d", 2.0), ("d", 9.0), ("d", 9.0)], "k string, q double"), "k", "q", 3.0)) == {("d", 0, 2, 1.0, 2.0), ("d", 1, 1, 9.0, 9.0)}
