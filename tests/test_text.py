from pyspark.sql import functions as F

from lexdelta.functions import text as T

BLANKS = "".join(map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def one(spark, expr, /, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if not isinstance(v, int) else 'bigint'}" for k, v in values.items()))
    return df.select(expr.alias("x")).first()["x"]


def test_words_split_as_python_does(spark):
    texts = ["a" + b + "b" for b in BLANKS] + ["", "  ", BLANKS, "x", "a  b\n\nc"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.words("t").alias("w"), T.collapse("t").alias("c")).collect()
    for r in got:
        assert r["w"] == texts[r["i"]].split()
        assert r["c"] == " ".join(texts[r["i"]].split())


def test_null_text(spark):
    df = spark.createDataFrame([(None,)], "t string").select(T.words("t").alias("w"), T.collapse("t").alias("c"), T.amounts("t").alias("a"), T.division_title("t").alias("d"), T.has_annotation("t").alias("n"))
    assert tuple(df.first()) == ([], None, [], "", False)


def test_amounts(spark):
    t = "A $1,000,000 and $17,40022 (increased by $5,000) plus $0, $5000000 (reduced by  $3) or $12 each"
    assert one(spark, T.amounts("t"), t=t) == [1000000, 17400, 0, 5000000, 12]
    assert one(spark, T.amounts("t"), t="$99999999999999999999") == [None]


def test_unified_diff(spark):
    import difflib

    for a, b in [("x y", "x z"), ("", "new"), ("old", ""), ("same", "same"), ("", "")]:
        want = [line.rstrip() for line in difflib.unified_diff(a.splitlines(True), b.splitlines(True), "old", "new", lineterm="")]
        assert one(spark, T.unified_diff(F.col("a"), F.col("b")), a=a, b=b) == want


def test_money(spark):
    assert one(spark, T.money(F.col("a")), a=-1234567) == "-$1,234,567"
    assert one(spark, T.delta(F.col("a"), F.col("b")), a=10, b=30) == "+$20"
    assert one(spark, T.delta_percent(F.col("a"), F.col("b")), a=200, b=150) == "-25.0%"
    assert one(spark, T.delta_percent(F.col("a"), F.col("b")), a=0, b=150) == "—"


def test_ids_and_titles(spark):
    assert tuple(one(spark, T.parse_bill_id(F.col("c")), c="118-hr-1:engrossed")) == ("118", "hr", "1", "engrossed")
    assert one(spark, T.parse_bill_id(F.col("c")), c="nothing") is None
    assert one(spark, T.title_match_header(F.col("c")), c="TITLE IV—Roads") == "Roads"
    assert one(spark, T.title_match_header(F.col("c")), c="TITLE IV") == ""
    assert one(spark, T.title_match_header(F.col("c")), c="Roads") == "Roads"
    assert one(spark, T.version_label(F.col("c")), c="2_engrossed-in-house") == "engrossed-in-house"
    assert one(spark, T.congress_of_year(F.col("y")), y=2023) == 118
    assert one(spark, T.division_title("c"), c="Division A:  Roads  And\nRails") == "roads and rails"
    assert one(spark, T.path_text(F.array(F.col("a"), F.lit(None), F.lit(" B  c "))), a="X") == "x >  > b c"


def test_printed_openings(spark):
    cover = "118TH CONGRESS\n1ST SESSION\nH. R. 4366\n\nAN ACT\nMaking  appropriations for\nroads, and for other purposes.\nBe it"
    assert one(spark, T.printed_congress(F.col("t")), t=cover) == "118" and one(spark, T.printed_congress(F.col("t")), t="none") == ""
    assert one(spark, T.printed_title(F.col("t")), t=cover) == "H.R. 4366 — Making appropriations for roads, and for other purposes."
    assert one(spark, T.printed_title(F.col("t")), t="A BILL\nTo x" + " y" * 100 + " purposes.") == ("To x" + " y" * 100)[:137].rstrip() + "…"
    assert one(spark, T.printed_title(F.col("t")), t="nothing") == ""
    assert one(spark, T.slug(F.col("t")), t="!!") == "unknown" and one(spark, T.slug(F.col("t")), t="Reported in House") == "reported-in-house"
