import pytest
from helpers import rows

from lexdelta.llm import mixing as M

DOCS = [(i, f"word{i} and more text here " * (1 + i % 5), s, 5) for i, s in enumerate(["big"] * 600 + ["small"] * 40 + ["other"] * 10)] + [(900, None, "big", 1), (901, "", "small", 1), (902, "lost", None, 1)]
TARGETS = [("m", "big", 0.5, 1), ("m", "small", 0.3, 6), ("m", "absent", 0.2, 2), ("n", "small", 1.0, 3), (None, "big", 0.5, 1)]


def mix(spark, docs=DOCS, targets=TARGETS, **kw):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, _n int")
    return M.Mixture(d, spark.createDataFrame(targets, "mix_name string, source string, target_share double, max_repeats int"), **kw)


@pytest.mark.parametrize("rate, cap", [(0.0, 3), (0.3, 1), (1.0, 1), (2.5, 4), (4.0, 4), (3.99, 4), (0.7, 10)])
def test_poisson_mean(rate, cap):
    cdf = M.poisson_cdf(rate, cap)
    assert len(cdf) == max(cap, 1) and cdf == sorted(cdf)
    assert abs(sum(1 - c for c in cdf[:cap]) - rate) < 1e-6


def test_shares_and_caps(spark):
    m = mix(spark)
    shares = {(r["mix_name"], r["source"]): r for r in m.shares().collect()}
    assert shares["m", "absent"]["reached_share"] == 0 and shares["n", "small"]["reached_share"] == 1
    assert abs(shares["m", "big"]["reached_share"] - 0.5 / 0.8) < 0.06
    got = m.mixed().collect()
    cap = {(a, b): c for a, b, _, c in TARGETS}
    assert all(1 <= r["copy_no"] <= cap[r["mix_name"], r["source"]] for r in got)
    assert {r["source"] for r in got} == {"big", "small"}
    assert len({(r["mix_name"], r["doc_id"], r["copy_no"]) for r in got}) == len(got)


def test_same_draw_again_and_other_seed(spark):
    key = lambda m: rows(m.mixed().select("mix_name", "doc_id", "copy_no"))
    assert key(mix(spark)) == key(mix(spark)) != key(mix(spark, seed=8))


def test_shuffled(spark):
    ids = [r["doc_id"] for r in mix(spark).mixed().where("mix_name = 'm'").collect()]
    assert ids != sorted(ids) and sum(a < b for a, b in zip(ids, ids[1:])) < 0.6 * len(ids)


def test_total_holds_sources_at_their_cap():
    plan = M.plan_rates([{"mix_name": "m", "source": s, "target_share": 0.5, "max_repeats": 2} for s in "ab"], {"a": 100, "b": 1000}, total=1000)
    assert [r["rate"] for r in plan] == [2, 0.5]


def test_empty(spark):
    m = mix(spark, docs=DOCS[:1])
    assert {r["reached_share"] for r in M.Mixture(m.docs.where("false").toDF("doc_id", "source", "text"), spark.createDataFrame(TARGETS, "mix_name string, source string, target_share double, max_repeats int")).shares().collect()} == {0.0}
    assert mix(spark, docs=DOCS, targets=TARGETS[-1:]).mixed().count() == 0


def test_tokens_round_trip():
    enc = M._encoding(M.TOKENIZERS + "/byte_bpe_50k.tiktoken")
    for t in ["The § 3 of “roads” — é.", "  spaced\n\nout ", "it's 123's", "x" * 5000]:
        assert enc.decode(enc.encode_ordinary(t)) == t
    import tokenizers

    full = tokenizers.Tokenizer.from_file(M.TOKENIZERS + "/byte_bpe_50k.json")
    for t in ["The § 3 of “roads” — é.", "it's 123's  and   more \n text"]:
        assert full.encode(t, add_special_tokens=False).ids == enc.encode_ordinary(t)


@pytest.mark.parametrize("rate, cap", [(900, 1000), (650, 700), (3.5, 4), (0.2, 1), (5000, 20000), (1e-6, 3), (999.9, 1000)])
def test_mean_is_the_rate_however_high(rate, cap):
    cdf = M.poisson_cdf(rate, cap)
    assert abs(cap - sum(cdf) - rate) < 1e-6 * max(rate, 1)
    assert all(a <= b for a, b in zip(cdf, cdf[1:]))
