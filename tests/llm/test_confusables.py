import unicodedata

import pytest
from helpers import rows

from lexdelta.llm import confusables as C

FORMS = C.Forms(C.table_from())
NB, ZW, SOFT, THIN, WIDE_SPACE = (chr(x) for x in (0xA0, 0x200B, 0xAD, 0x2009, 0x3000))


@pytest.mark.parametrize(
    "text, clean, kinds",
    [
        ("plain text, “quoted” — § 3 é", None, []), ("a" + NB + "b", "a b", ["blank"]), ("in" + ZW + "side", "inside", ["no_width"]), ("soft" + SOFT + "ly", "softly", ["no_width"]), ("x" + THIN + "y" + WIDE_SPACE + "z", "x y z", ["blank"]),
        ("Ｗｉｄｅ １２", "Wide 12", ["wide"]), ("ﬁnal", "final", ["wide"]), (unicodedata.normalize("NFD", "Río"), "Río", ["mark"]), ("trestlе", "trestle", ["look_alike"]), ("мост", None, []), ("θάλασσα", None, []),
        ("Αpril", "April", ["look_alike"]), ("thе" + NB + "ｅnd", "the end", ["blank", "look_alike", "wide"]), ("", None, []), ("line\nend\r\n", None, []), ("tab\there", "tab here", ["blank"]), ("жar", None, []),
    ],
)
def test_clean(text, clean, kinds):
    assert FORMS.one_form(text) == (text if clean is None else clean, kinds)


@pytest.mark.parametrize(
    "text, form",
    [("𝐀ct", "Act"), ("Ⅳ", "IV"), ("①", "1"), ("½", "1⁄2"), ("Ĳ", "IJ"), ("ǆ", "dž"), ("ℌouse", "House"), ("scrɪpt", "script"), ("Ꭺct", "Act"), ("trıal", "trial"), ("Οctober", "October"), ("Іtem", "Item"), ("раypаl", "paypal"), ("Ёlan", "Ëlan"), ("㎏", "kg")],
)
def test_forms_of_the_whole_table(text, form):
    got, kinds = FORMS.one_form(text)
    assert got == form and kinds
    assert FORMS.skeleton(got) == FORMS.skeleton(text)
    assert FORMS.one_form(got) == (got, [])


@pytest.mark.parametrize("text", ["naïve œuvre Straße Łódź", "«x» ‑ – — −", "n.º 5ª x²", "日本 한국 שלום नमस्ते สวัสดี", "word′s", "“a” ‘b’ „c‚", "ПРАВДА α β"])
def test_proper_texts_stay(text):
    assert FORMS.one_form(text) == (text, [])


def test_table_is_the_whole_public_one():
    assert len(FORMS.table) > 6000 and FORMS.table["а"] == "a" and FORMS.table["m"] == "rn"


def test_without_prototypes_no_look_alike_is_found():
    assert C.Forms({}).one_form("trestlе") == ("trestlе", [])


def test_skeletons_of_look_alikes():
    same = ["The end", "Thе end", "The" + NB + "end", "Ｔｈｅ end", "T" + ZW + "he  end", "The end\n"]
    assert len({FORMS.skeleton(t) for t in same}) == 1
    assert FORMS.skeleton("The end") != FORMS.skeleton("The ends")
    for t in same:
        assert FORMS.skeleton(FORMS.skeleton(t)) == FORMS.skeleton(t)


TEXTS = ["plain", None, "", "a" + NB + "b", "a b", "x" * 200_000 + ZW, "мост", "a" + NB + "b"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "k", "c") for i, t in enumerate(texts)], "id bigint, text string, kinds string, _c string")


def test_improper(spark):
    got = C.improper(frame(spark, TEXTS)).select("id", "clean_text")
    assert {r["id"] for r in got.collect()} == {3, 5, 7}
    assert rows(C.improper(frame(spark, TEXTS).where("false")).select("id")) == set()


def test_filter_passes_all_that_is_improper(spark):
    import random

    rnd = random.Random(1)
    pool = "aeo é“ §" + NB + ZW + SOFT + THIN + WIDE_SPACE + "ﬁＡ１" + "еοа" + "мλ" + chr(0x301) + "\t"
    texts = ["".join(rnd.choice(pool) for _ in range(6)) for _ in range(500)]
    got = {r["id"] for r in C.improper(frame(spark, texts)).select("id").collect()}
    assert got == {i for i, t in enumerate(texts) if FORMS.one_form(t)[1]}


def test_groups(spark):
    df = frame(spark, TEXTS + ["c"] * 50)
    got = C.look_alike_groups(df).collect()
    assert [(r["n_rows"], r["n_forms"]) for r in got] == [(3, 2)]


PROTOTYPES = {ord(k): v for k, v in FORMS.table.items()}


def pure(text):
    """The method as it is dealt: decompose, prototype, decompose."""
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(PROTOTYPES))


@pytest.mark.parametrize("text", ["x²", "n.º", "5ª", "H₂O", "1⁹", "don´t", "a¸b", "so˜", "mot˙", "2ʳ", "ϲt", "Ϲt", "é ç ö", "Ѕесtion", "5%", "‰"])
def test_skeleton_is_decompose_prototype_decompose(text):
    assert FORMS.skeleton(text) == pure(text)


def test_skeleton_of_every_character_and_its_one_form():
    chars = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) not in ("Cn", "Co", "Cs")]
    own = [c for c in chars if C._kind(c) is None and not c.isspace()]
    assert [c for c in own if FORMS.skeleton(c) != C._WS_RUN.sub(" ", pure(c)).strip()] == []
    assert [c for c in chars if FORMS.skeleton(FORMS.one_form(c)[0]) != FORMS.skeleton(c)] == []


@pytest.mark.parametrize("text, plain", [("x²", "x2"), ("n.º", "n.o"), ("H₂O", "H2O"), ("2ʳ", "2r")])
def test_raised_and_lowered_characters_look_like_no_others(text, plain):
    assert FORMS.skeleton(text) != FORMS.skeleton(plain)


@pytest.mark.parametrize("text, form", [("nº", "nº"), ("don´t", "don´t"), ("¨¯¸", "¨¯¸"), ("aϲt", "act"), ("ϲοφια", "ϲοφια"), ("nоª", "noª"), ("xʰо", "xʰo"), ("￣", "¯")])
def test_one_form_has_the_skeleton_by_the_table(text, form):
    assert FORMS.one_form(text)[0] == form and FORMS.one_form(form) == (form, [])
    assert FORMS.skeleton(form) == FORMS.skeleton(text)


def test_no_table_is_an_error(monkeypatch, tmp_path):
    monkeypatch.setenv("SPARK_HOME", str(tmp_path))
    assert C.table_from() == FORMS.table  # that of the installed package
    monkeypatch.setattr(C.pyspark, "__file__", str(tmp_path / "__init__.py"))
    with pytest.raises(FileNotFoundError):
        C.table_from()


def test_groups_by_skeletons_not_by_their_hashes(spark):
    a, b = "all text of land", "axlbyiklzETXsB-3"  # one 64-bit hash
    pair = spark.createDataFrame([(a, b)], "a string, b string").selectExpr("xxhash64(a) = xxhash64(b)").first()
    assert pair[0] and FORMS.skeleton(a) == a and FORMS.skeleton(b) == b
    got = C.look_alike_groups(frame(spark, [a, a.replace("l", "I"), b, b.replace("l", "1"), a])).collect()
    assert {(r["skeleton"], r["n_rows"], r["n_forms"]) for r in got} == {(a, 3, 2), (b, 2, 2)}
    assert C.look_alike_groups(frame(spark, [a, b])).count() == 0


def test_groups_keep_raised_characters_apart(spark):
    got = C.look_alike_groups(frame(spark, ["10²", "102", "l02", "don´t", "don't"])).collect()
    assert {(r["skeleton"], r["n_rows"], r["n_forms"]) for r in got} == {("lO2", 2, 2), ("don't", 2, 2)}
