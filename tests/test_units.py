import numpy as np
import pytest
from pyspark.sql import functions as F

from lexdelta.operators import units


@pytest.mark.parametrize(
    "note, factor",
    [("K$", 1000), ("three zeros omitted", 1000), ("[Dollars in millions]", 10**6), ("MILLIONS", 10**6), ("figures in mn", 10**6), ("amounts in 000s", 1000), ("$000", 1000), ("(thousands of dollars)", 1000), ("USD", 1), ("actual dollars", 1),
     ("converted from thousands to dollars", 1), ("in dollars, not thousands", 1), ("dollars, rounded to the nearest thousand", 1), ("six zeros omitted", 10**6), ("$ billions", 10**9), ("see page 3", None), ("", None), (None, None)],
)
def test_notes(spark, note, factor):
    assert spark.createDataFrame([(note,)], "t string").select(units.stated_factor(F.col("t"))).first()[0] == factor


@pytest.mark.parametrize(
    "name, factor",
    [("THOUSAND ISLES FERRY", None), ("MILLION TREES CORRIDOR [$000]", 1000), ("ROADS (INCLUDING TRANSFER OF FUNDS)", None), ("ROADS--THOUSANDS OF DOLLARS", 1000), ("ROADS --CONTINUED (IN MILLIONS)", 10**6), ("Roads, in whole dollars", 1),
     ("Roads ($ thousands)", 1000), ("Roads (dollars)", 1), ("CREW PAY -- TERRITORIAL MILITIA", None), ("ROADS (000S OMITTED)", 1000), (None, None)],
)
def test_names(spark, name, factor):
    assert spark.createDataFrame([(name,)], "t string").select(units.label_factor(F.col("t"))).first()[0] == factor


@pytest.mark.parametrize(
    "head, factor",
    [("Bill. The bill provides $34 million for x. Amounts in the statement are thousands of dollars. More.", 1000), ("Bill. [In millions of dollars] Of the funds, $5.", 10**6), ("The bill provides $3 million for the columns.", None),
     ("Columns show actual dollars and are not cut to thousands.", 1), ("Nothing here.", None), ("(000s omitted in all columns)", 1000), ("All table figures: $ thousands.", 1000), (None, None)],
)
def test_statements(spark, head, factor):
    assert spark.createDataFrame([(head,)], "t string").select(units.statement_factor(F.col("t"))).first()[0] == factor


@pytest.mark.parametrize(
    "text, want",
    [("$214.609M", (214.609, 10**6)), ("$1.06\u202fmillion", (1.06, 10**6)), ("$\xa05\u2009thousand dollars", (5, 1000)), ("0.137 bn", (0.137, 10**9)), ("$ 765,000", (765000, None)), ("626,325,000 dollars", (626325000, 1)), ("$3,773 thou.", (3773, 1000)), ("(1,462)", (None, None)), ("such sums", (None, None)), ("---", (None, None)), ("", (None, None)), (None, (None, None))],
)
def test_printed(spark, text, want):
    figure, factor = units.printed_amount(F.col("t"))
    got = spark.createDataFrame([(text,)], "t string").select(figure.cast("double"), factor).first()
    assert tuple(got) == want


def test_mixture_recovers_units():
    rng = np.random.default_rng(3)
    true = rng.normal(7.5, 0.5, 4000)
    offset = rng.choice([0, 3, 6], 4000, p=[0.6, 0.3, 0.1])
    x, n = np.unique(np.round((true - offset) / 0.02).astype(int), return_counts=True)
    m = units.fit_mixture(x * 0.02, n, [0, 3, 6], np.array([7.0, 7.5, 8.0]), np.array([700, 1400, 700]))
    assert np.allclose(m["weights"], [0.6, 0.3, 0.1], atol=0.03)
    free = units.fit_mixture(x * 0.02, n, [0, 3, 6])
    assert abs(free["sigma"] - 0.5) < 0.15


def test_mixture_has_no_step_in_the_number_of_stated_rows():
    x, n = np.array([4.5, 7.5]), np.array([30, 70])
    mus = [units.fit_mixture(x, n, [0, 3], np.array([7.5]), np.array([k]))["mu"] for k in range(25, 36)]
    assert np.ptp(mus) < 0.01


def test_prior_is_the_weight_without_evidence():
    m = units.fit_mixture(np.array([0.0]), np.array([0.0]), [0, 3], prior=[1, 3])
    assert np.allclose(m["weights"], [0.25, 0.75])


def harmonised(spark, data, **kw):
    df = spark.createDataFrame(data, "source string, key bigint, figure string, own bigint, near bigint, factor string, _log int").withColumn("figure", F.col("figure").cast("decimal(28,6)"))
    return {r["key"]: r for r in units.harmonise(df.drop("factor", "_log"), **kw).collect()}


def test_harmonise(spark):
    data = [("a", i, str(10**7 + i), 1, None, "x", 1) for i in range(200)] + [("a", 1000, "12000", None, None, "x", 1), ("a", 1001, "9000000", None, None, "x", 1), ("a", 1002, None, None, None, "x", 1), ("a", 1003, "0", None, None, "x", 1), ("a", 1004, "-5", None, 1000, "x", 1), (None, 1005, "7", None, None, "x", 1)]
    for more in ({}, {"small": 0}):  # mixtures broadcast, and joined
        got = harmonised(spark, data, **more)
        assert (got[1000]["factor"], got[1000]["amount"], got[1000]["unit_source"]) == (1000, 12_000_000, "mixture")
        assert got[1001]["factor"] == 1 and not got[1001]["uncertain"]
        assert got[1002]["amount"] is None and got[1003]["amount"] == 0 and got[1003]["uncertain"]
        assert (got[1004]["amount"], got[1004]["unit_source"]) == (-5000, "near")
        assert len(got) == len(data) and got[1005]["factor"] is not None
    # a convention is a prior: a figure that cannot be in its unit gets another one
    assert harmonised(spark, data, conventions={"a": 1})[1000]["factor"] == 1000
    assert harmonised(spark, data, conventions={"a": 1})[1003]["factor"] == 1
    assert harmonised(spark, []) == {}


def test_convention_decides_what_figures_leave_open(spark):
    flat = [("a", i, str(10 ** (3 + i % 5)), None, None, "x", 1) for i in range(200)]
    assert {r["factor"] for r in harmonised(spark, flat, conventions={"a": 1}).values()} == {1}
    assert {r["factor"] for r in harmonised(spark, flat, conventions={"a": 1000}).values()} == {1000}
