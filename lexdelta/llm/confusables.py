"""Texts that look alike but differ in characters, brought to one form by confusables skeletons.

The skeleton of a text: decompose, replace every character by its prototype from the public look-alike
table, decompose again; texts with equal skeletons look alike and are one group. Before that, characters without width
go and wide and joined forms become their plain characters; raised and lowered characters do not (``x²`` is not ``x2``),
for them the table speaks. Decomposing is canonical: it takes no character away before the table sees it. A skeleton is no text to
read (it writes ``1`` and ``I`` as ``l``, curly quotes as straight ones), so the one form of a text is the proper text of the
same skeleton that is closest to it: a character stays where it is proper, and is replaced by the plain character of
its skeleton where it is not. A text is improper where its one form differs from it.

Improper are wide and joined forms, accents apart from their letter, characters without width, other blanks, and
letters whose skeleton is a plain Latin letter inside words otherwise in Latin letters. Quotes, dashes, ``§``, composed
accents, raised and lowered characters and words wholly in another script stay.

The table is the one of the ICU library that Spark itself ships (6,355 entries), read once on the driver and sent
to the tasks; its path is a parameter of ``table_from``. Without that table there are no skeletons, so its absence is an error.
"""

from __future__ import annotations

import glob
import os
import re
import struct
import unicodedata
import zipfile
from functools import lru_cache

import pandas as pd
import pyspark
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: where the library keeps its look-alike table.
_ENTRY = "com/ibm/icu/impl/data/icudata/confusables.cfu"


def table_from(jar: str | None = None) -> dict[str, str]:
    """Character to prototype, from the library's table; an error where the library is not found."""
    homes = [h for h in (os.path.dirname(pyspark.__file__), os.environ.get("SPARK_HOME")) if h]  # the last is preferred
    found = [jar] if jar else [j for h in homes for j in sorted(glob.glob(os.path.join(h, "jars", "icu4j-*.jar")))]
    if not found:
        raise FileNotFoundError(f"no icu4j-*.jar with the look-alike table in the jars of {homes}")
    with zipfile.ZipFile(found[-1]) as z:
        data = z.read(_ENTRY)
    data = data[struct.unpack_from(">H", data)[0] :]  # behind the header
    _, _, _, keys_at, n, index_at, _, strings_at, size = struct.unpack_from(">9i", data)
    keys, index = struct.unpack_from(f">{n}i", data, keys_at), struct.unpack_from(f">{n}H", data, index_at)
    strings = data[strings_at : strings_at + 2 * size]
    out = {}
    for key, at in zip(keys, index):
        units = (key >> 24 & 0xFF) + 1  # UTF-16 units of the prototype; a single one stands in the index itself
        raw = struct.pack(">H", at) if units == 1 else strings[2 * at : 2 * (at + units)]
        out[chr(key & 0xFFFFFF)] = raw.decode("utf-16-be")
    return out


#: Characters of no width besides format characters, and format characters that show.
_NO_WIDTH = {0xAD, 0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), 0x3164, *range(0xFE00, 0xFE10), 0xFFA0, *range(0xE0100, 0xE01F0)}
_SHOWN = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, *range(0xFFF9, 0xFFFC), 0x110BD, 0x110CD}
#: Decompositions that are no wide or joined form: raised, lowered, and blanks and hyphens that do not break.
_OTHER_FORMS = ("<super>", "<sub>", "<noBreak>")
#: Fixed value: letters of their own despite a decomposition, seen as ``c`` and ``C`` and not as the sigmas they decompose to.
_OWN = "ϲϹ"
#: Ranges of combining marks of alphabets.
_MARKS = ((0x300, 0x36F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE20, 0xFE2F))
_LETTER = r"[^\W\d_]"
_WORD = re.compile(rf"{_LETTER}(?:{_LETTER}|[̀-ͯ])*")
#: For the JVM: a text without any of these is proper, the others are looked at by ``Forms``. (Written as what is
#: suspect: the same class negated takes forty times as long.)
SUSPECT = r"[\t\x0b\x0c\x{80}-\x{a6}\x{a8}-\x{bf}\x{100}-\x{200f}\x{2020}-\x{10ffff}]"
_WS_RUN = re.compile(r"\s+")


def _no_width(c: str) -> bool:
    return ord(c) in _NO_WIDTH or (unicodedata.category(c) == "Cf" and ord(c) not in _SHOWN)


def _kind(c: str) -> str | None:
    """Why a character is improper wherever it stands; NULL where it is not."""
    if _no_width(c):
        return "no_width"
    category = unicodedata.category(c)
    if c in "\t\v\f" or (category == "Zs" and c != " "):
        return "blank"
    if any(a <= ord(c) <= b for a, b in _MARKS):
        return "mark"
    form, *codes = unicodedata.decomposition(c).split(" ")
    if codes[:1] == ["0020"] or c in _OWN:  # an accent or bar with a place of its own: no plain character has it
        return None
    if form.startswith("<") and form not in _OTHER_FORMS and category not in ("Pd", "Pi", "Pf") and not 0x2032 <= ord(c) <= 0x2037:
        return "wide"
    return None


def _plain(c: str) -> str:
    """The plain characters of a wide or joined form; a wide accent with a place of its own keeps it."""
    plain = unicodedata.normalize("NFKC", c)
    return chr(int(unicodedata.decomposition(c).split(" ")[1], 16)) if plain.startswith(" ") else plain


class Forms:
    """Skeletons and one forms by one look-alike table."""

    def __init__(self, table: dict[str, str]) -> None:
        self.table = table
        self.prototypes = {ord(k): v for k, v in table.items()}
        self.kind = lru_cache(100_000)(_kind)
        upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
        #: (skeleton, whether a capital) to the plain letter that has it
        self.plain = {(self.skeleton(c), c.isupper()): c for c in upper + lower}
        self.letter = lru_cache(100_000)(self._letter)
        self.word = lru_cache(100_000)(self._word)

    def skeleton(self, text: str) -> str:
        """Equal for texts that look alike; white space runs count as one blank."""
        if not text.isascii():
            kinds = {c: k for c in set(text) if not c.isascii() and (k := self.kind(c)) in ("no_width", "wide")}
            text = text.translate({ord(c): "" if k == "no_width" else _plain(c) for c, k in kinds.items()}) if kinds else text
        out = unicodedata.normalize("NFD", text).translate(self.prototypes)
        return _WS_RUN.sub(" ", unicodedata.normalize("NFD", out)).strip()

    def _letter(self, c: str) -> str | None:
        """The plain letter a foreign letter is seen as; NULL for Latin letters of living alphabets and all others."""
        if c.isascii() or unicodedata.category(c) not in ("Lu", "Ll", "Lt", "Lo"):
            return None
        latin = unicodedata.name(c, "").startswith("LATIN ")
        if latin and (c != "ı" and ord(c) < 0x180 or unicodedata.decomposition(c)):
            return None
        seen = self.skeleton(c)
        return self.plain.get((seen, c.isupper())) or self.plain.get((seen, not c.isupper()))

    def _word(self, word: str) -> str:
        parts = unicodedata.normalize("NFD", word)
        own = [c for c in parts if unicodedata.category(c)[0] == "L" and not unicodedata.decomposition(c).startswith(_OTHER_FORMS)]
        foreign = [c for c in own if not unicodedata.name(c, "").startswith("LATIN ") or self.letter(c)]
        if len(foreign) == len(own) or not all(self.letter(c) for c in foreign):
            return word
        plain = "".join(self.letter(c) or c for c in parts)
        # the replaced word must look as the word did
        return unicodedata.normalize("NFC", plain) if self.skeleton(plain) == self.skeleton(word) else word

    def one_form(self, text: str) -> tuple[str, list[str]]:
        """The proper text of the same skeleton, and what was improper: wide, mark, no_width, blank, look_alike."""
        if text.isascii() and not any(c in text for c in "\t\v\f"):
            return text, []
        kinds = {c: k for c in set(text) if not ("\x20" <= c <= "\x7e") and (k := self.kind(c))}
        swap = {"no_width": lambda c: "", "blank": lambda c: " ", "wide": _plain, "mark": lambda c: c}
        out = text.translate({ord(c): swap[k](c) for c, k in kinds.items()}) if kinds else text
        out = unicodedata.normalize("NFC", out)
        plain = _WORD.sub(lambda m: m.group() if m.group().isascii() else self.word(m.group()), out)
        found = set(kinds.values())
        if plain != out:
            found.add("look_alike")
        return plain, sorted(found)


def _looked(text: Column, table: dict[str, str]) -> Column:
    held: dict[str, Forms] = {}  # a task's own

    def look(s: pd.Series) -> pd.DataFrame:
        if "forms" not in held:
            held["forms"] = Forms(table)
        got = [held["forms"].one_form(t) if t is not None else (None, []) for t in s]
        return pd.DataFrame({"text": [g[0] for g in got], "kinds": [g[1] for g in got]})

    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType()))])
    return F.pandas_udf(look, kind)(text)


def _skeletons(text: Column, table: dict[str, str]) -> Column:
    held: dict[str, Forms] = {}  # a task's own

    def look(s: pd.Series) -> pd.Series:
        if "forms" not in held:
            held["forms"] = Forms(table)
        return s.map(held["forms"].skeleton)

    return F.pandas_udf(look, T.StringType())(text)


def improper(df: DataFrame, text: str = "text", table: dict[str, str] | None = None) -> DataFrame:
    """The rows whose text is not in its one form, with ``clean_text`` and ``kinds``; no shuffle.

    NULL and empty texts are proper. All rows are looked at by a JVM filter; only texts with a character
    beyond it go to Python. Repeated rows stay, other columns are kept.
    """
    looked = df.where(F.col(text).rlike(SUSPECT)).withColumn("_c", _looked(F.col(text), table or table_from()))
    return looked.withColumns({"clean_text": F.col("_c.text"), "kinds": F.col("_c.kinds")}).drop("_c").where(F.size("kinds") > 0)


def look_alike_groups(df: DataFrame, text: str = "text", table: dict[str, str] | None = None) -> DataFrame:
    """(skeleton_hash, n_rows, n_forms, skeleton) of the skeletons that stand in more than one form.

    Forms are told apart, and grouped, by themselves; the hash is only a short name of the skeleton.
    Both shuffles are pre-aggregated, so a text repeated in a third of all rows is one row a task, and every
    form is looked at once. NULL texts have no skeleton; the empty text has one.
    """
    forms = df.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("form")).agg(F.count("*").alias("n"))
    looked = forms.select("n", _skeletons(F.col("form"), table or table_from()).alias("skeleton"))
    groups = looked.groupBy("skeleton").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_forms")).where("n_forms > 1")
    return groups.select(F.xxhash64("skeleton").alias("skeleton_hash"), "n_rows", "n_forms", "skeleton")
