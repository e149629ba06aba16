import pytest
from helpers import rows

from lexdelta.llm import encodings as E

LOST = E.LOST
CLEAN = ["El señor explicó la situación del niño.", "Für die Übergangslösung “quoted words” — § 3.", "L’hôpital de la forêt brûlée.", "The marker reads “мост” on both faces.", "NÃO SE APLICA, Âmbito, Ñandara, ¿Qué?", "plain ASCII"]


def bad(t, written="utf-8", read="cp1252"):
    return E._step(t, written, read)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "w", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, word string, n int")


@pytest.mark.parametrize("written, read", [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("utf-8", "mac_roman"), ("utf-8", "cp1251"), ("cp1252", "cp850"), ("cp1252", "cp1251")])
def test_found_and_restored(spark, written, read):
    texts = CLEAN * 3 + [bad(CLEAN[0], written, read), None, "", "unseen: " + bad("hôpital", written, read) + " " + CLEAN[4]]
    m = E.Mojibake(frame(spark, texts))
    n = len(CLEAN) * 3
    assert {r["doc_id"] for r in m.affected().collect()} == {n, n + 3}
    back = {r["doc_id"]: r["text"] for r in m.restored().collect()}
    assert back[n] == CLEAN[0]


def test_twice_and_partly(spark):
    twice = bad(bad("señor"))
    texts = CLEAN * 4 + [f"El {twice} llegó, señor.", "El se" + LOST + "or y " + LOST + LOST + "zz."]
    m = E.Mojibake(frame(spark, texts))
    n = len(CLEAN) * 4
    got = {r["doc_id"]: r for r in m.restored().collect()}
    assert got.keys() == {n, n + 1}
    assert got[n]["text"] == "El señor llegó, señor."
    assert got[n + 1]["text"].startswith("El señor") and got[n + 1]["n_lost"] == 1


def test_runs_cover_words_that_never_occur_clean(spark):
    texts = CLEAN * 2 + ["the " + bad("“orchards") + " grow"]
    back = E.Mojibake(frame(spark, texts)).restored().collect()
    assert [r["text"] for r in back] == ["the “orchards grow"]


def test_clean_corpora_stay(spark):
    assert rows(E.Mojibake(frame(spark, CLEAN * 5)).affected()) == set()
    assert rows(E.Mojibake(frame(spark, CLEAN).where("false")).affected()) == set()
    assert rows(E.Mojibake(frame(spark, [None, "", "ascii"])).affected()) == set()


def test_very_long_and_shuffled_join(spark):
    long_ = "señor " * 30_000
    texts = CLEAN * 3 + [long_, bad(long_)]
    m = E.Mojibake(frame(spark, texts), broadcast_words=0)
    assert not m.small
    assert {r["doc_id"] for r in m.affected().collect()} == {len(CLEAN) * 3 + 1}
