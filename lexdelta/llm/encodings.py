"""Texts decoded with the wrong character encoding: found and restored from the corpus's own words.

Every distinct word of the corpus that has a character beyond ASCII is garbled by all encoding
chains, and the garbled forms are hash-joined with the words that occur. A word that is the
garbled form of another word of the corpus is garbled, if its original is the likelier of the
two: at least as frequent, or shorter (bytes read one by one only make a text longer). Runs of such
characters are treated as words are, which covers words whose original never occurs.

A word is a run of ASCII letters and characters beyond ASCII: garbling maps characters beyond
ASCII to such characters, so words keep their bounds. Documents are reduced to their
distinct words of this kind before anything is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexdelta.session import cut

LOST = chr(0xFFFD)
#: For the JVM, where a class written as what it is not takes four times as long.
BEYOND = r"[\x{80}-\x{10ffff}]"
TOKEN = rf"(?<![A-Za-z\x{{80}}-\x{{10ffff}}])[A-Za-z]*+{BEYOND}[A-Za-z\x{{80}}-\x{{10ffff}}]*+"
_RUN = re.compile(r"[^\x00-\x7f]+")

# Fixed values: (written in, read as). "cp1252" reads its five undefined bytes as controls,
# "cp1252!" and "utf-8!" as lost characters.
_SINGLE = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "koi8_r", "cp866")
_STEPS = (
    *[("utf-8", x) for x in (*_SINGLE, "cp1252!")],
    *[("cp1252", x) for x in ("cp437", "cp850", "mac_roman", "cp1251", "cp1250", "utf-8!")],
    *[("mac_roman", x) for x in ("cp1252", "latin-1", "utf-8!")],
    *[(x, y) for x in ("cp850", "cp437") for y in ("cp1252", "latin-1")],
    *[(x, y) for x in ("cp1251", "koi8_r", "cp866") for y in ("cp1252", "latin-1", "koi8_r", "cp866", "cp1251") if x != y],
)
_TWICE = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251")
CHAINS = (*[(s,) for s in _STEPS], *[(("utf-8", a), ("utf-8", b)) for a in _TWICE for b in (*_TWICE, "cp1252!")])
_UNDEFINED = (0x81, 0x8D, 0x8F, 0x90, 0x9D)
_SOFT = {b: (chr(b) if b in _UNDEFINED else bytes([b]).decode("cp1252")) for b in range(256)}
_HARD = {b: (LOST if b in _UNDEFINED else _SOFT[b]) for b in range(256)}


def _step(text: str, written: str, read: str) -> str | None:
    """``text`` garbled by one wrong reading; None where that is not possible or loses everything unsaid."""
    try:
        raw = bytes(text, written) if written != "cp1252" else b"".join(_cp1252(c) for c in text)
    except UnicodeError:
        return None
    if read == "cp1252":
        return "".join(_SOFT[b] for b in raw)
    if read == "cp1252!":
        out = "".join(_HARD[b] for b in raw)
        return out if LOST in out else None
    if read == "utf-8!":
        out = raw.decode("utf-8", "replace")
        return out if LOST in out else None
    try:
        return raw.decode(read)
    except UnicodeError:
        return None


def _cp1252(c: str) -> bytes:
    return bytes([ord(c)]) if ord(c) in _UNDEFINED else c.encode("cp1252")


def garbled_forms(word: str) -> dict[str, str]:
    """Garbled form to the name of a chain that makes it."""
    out: dict[str, str] = {}
    for chain in CHAINS:
        x: str | None = word
        for written, read in chain:
            x = _step(x, written, read)
            if x is None:
                break
        if x is not None and x != word:
            out.setdefault(x, " ".join(f"{a}>{b}" for a, b in chain))
    return out


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(form, w, n, chain) for w, n in zip(b["word"], b["n"]) for form, chain in garbled_forms(w).items()]
        yield pd.DataFrame(rows, columns=["form", "original", "n_original", "chain"])


class Mojibake:
    """Wrongly decoded documents among ``docs``.

    NULL and empty texts have no words; repeated documents count in the frequencies; very long
    texts are one row of distinct words each; an empty table gives empty results.
    """

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", broadcast_words: int = 500_000) -> None:
        self.docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
        found = F.array_distinct(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)))
        self.held = cut(self.docs.where("text is not null").select("doc_id", found.alias("words")).where(F.size("words") > 0), "words")
        self.occurring = self.held.select("doc_id", F.explode("words").alias("word"))
        vocabulary = cut(self.occurring.groupBy("word").agg(F.count("*").alias("n")), "vocabulary")
        # a word may stand clean only beside quotes or an apostrophe, so its runs of letters are originals too
        letters = F.filter(F.regexp_extract_all("word", F.lit(r"(\p{L}+)"), F.lit(1)), lambda w: w.rlike(BEYOND))
        sources = vocabulary.select(F.explode(F.array_distinct(F.concat(F.array("word"), letters))).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
        whole = self._originals(vocabulary, sources)
        runs = vocabulary.select("word", "n", F.explode(F.array_distinct(F.regexp_extract_all("word", F.lit(f"{BEYOND}+"), F.lit(0)))).alias("run"))
        by_run = self._originals(runs.groupBy(F.col("run").alias("word")).agg(F.sum("n").alias("n"))).where(F.length("word") > F.length("original"))
        pieces = runs.join(by_run.select(F.col("word").alias("run"), F.col("original").alias("o"), "chain"), "run").groupBy("word").agg(F.collect_set(F.struct("run", "o")).alias("swaps"), F.min("chain").alias("chain_r"))
        all_ = vocabulary.join(whole.select("word", "original", "chain"), "word", "left").join(pieces, "word", "left")
        swapped = F.when(F.col("swaps").isNotNull(), _swap_udf(F.col("word"), F.col("swaps")))
        garbled = all_.where(F.col("original").isNotNull() | F.col("swaps").isNotNull() | F.col("word").contains(LOST))
        #: (word, original, chain): the garbled words; original is NULL where it is lost
        self.garbled = cut(garbled.select("word", F.coalesce("original", swapped).alias("original"), F.coalesce("chain", "chain_r").alias("chain")), "garbled")
        # broadcast behind a count; beyond it the join shuffles
        self.small = self.garbled.count() <= broadcast_words

    @staticmethod
    def _originals(vocabulary: DataFrame, sources: DataFrame | None = None) -> DataFrame:
        """(word, original, chain) of the words that are a garbled form of a likelier word of ``sources``."""
        # repartitioned, as garbling is the work here and adaptive execution puts a short list of words into one task
        words = (vocabulary if sources is None else sources).select("word", "n")
        forms = words.repartition(words.sparkSession.sparkContext.defaultParallelism, "word").mapInPandas(_forms, "form string, original string, n_original bigint, chain string")
        hit = vocabulary.join(forms, vocabulary["word"] == forms["form"])
        likelier = (F.col("n_original") >= F.col("n")) | (F.length("word") > F.length("original"))
        best = hit.where(likelier).groupBy("word").agg(F.max_by(F.struct("original", "chain"), F.struct("n_original", "original")).alias("b"))
        return best.select("word", F.col("b.original").alias("original"), F.col("b.chain").alias("chain"))

    def _hits(self) -> DataFrame:
        g = F.broadcast(self.garbled) if self.small else self.garbled
        return self.occurring.join(g, "word")

    def affected(self) -> DataFrame:
        """(doc_id): documents with a garbled word, also where characters were lost."""
        g = self.garbled.select("word")
        return self.occurring.join(F.broadcast(g) if self.small else g, "word", "left_semi").select("doc_id").distinct()

    def restored(self) -> DataFrame:
        """(doc_id, text, n_words, n_lost): affected documents with every garbled word that has one put back to its original."""
        per = self._hits().groupBy("doc_id").agg(
            F.map_from_entries(F.collect_set(F.when(F.col("original").isNotNull(), F.struct("word", "original")))).alias("swaps"),
            F.count("original").alias("n_words"), F.count_if(F.col("original").isNull() | F.col("original").contains(LOST)).alias("n_lost"),
        )
        return self.docs.join(per, "doc_id").select("doc_id", _restore_udf(F.col("text"), F.col("swaps")).alias("text"), "n_words", "n_lost")


_PY_TOKEN = re.compile("(?<![A-Za-z\x80-\U0010ffff])[A-Za-z]*[^\x00-\x7f][A-Za-z\x80-\U0010ffff]*")


@F.pandas_udf(T.StringType())
def _swap_udf(word: pd.Series, swaps: pd.Series) -> pd.Series:
    out = []
    for w, s in zip(word, swaps):
        known = {x["run"]: x["o"] for x in s} if s is not None else {}
        out.append(_RUN.sub(lambda m, k=known: k.get(m.group(), m.group()), w))
    return pd.Series(out)


@F.pandas_udf(T.StringType())
def _restore_udf(text: pd.Series, swaps: pd.Series) -> pd.Series:
    out = []
    for t, s in zip(text, swaps):
        known = dict(s) if s is not None else {}
        for _ in range(3):  # a word garbled twice becomes one garbled once first
            new = _PY_TOKEN.sub(lambda m, k=known: k.get(m.group(), m.group()), t) if t else t
            if new == t:
                break
            t = new
        out.append(t)
    return pd.Series(out)
