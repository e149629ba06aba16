"""Column functions on text. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters Python's ``str.split()`` takes as white space (Java's ``\s`` takes fewer).
WS_CLASS = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Fixed value: printed amounts, and the notes of an amendment that name a difference, not an amount.
AMOUNT = r"\$\d{1,3}(?:,\d{3})+|\$\d+"
ANNOTATION = r"\((?:increased|reduced|decreased) by\s+\$[\d,]+\)"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c: str | Column) -> Column:
    """White space runs to single blanks, trimmed; NULL stays NULL."""
    return F.trim(F.regexp_replace(col(c), WS_CLASS + "+", " "))


def strip_ws(c: str | Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(col(c), WS_CLASS + "+", "")


def words(c: str | Column) -> Column:
    """``str.split()``: the non-empty tokens between white space; NULL gives an empty array."""
    return F.filter(F.split(F.coalesce(col(c), F.lit("")), WS_CLASS + "+"), lambda w: w != "")


def header_norm(c: str | Column) -> Column:
    return F.lower(collapse(c))


def division_title(c: str | Column) -> Column:
    """What follows the first colon, normalised; ``""`` without a colon and for NULL."""
    c = F.coalesce(col(c), F.lit(""))
    return F.when(F.instr(c, ":") > 0, header_norm(F.regexp_replace(c, r"(?s)^[^:]*:", ""))).otherwise(F.lit(""))


def path_text(c: str | Column) -> Column:
    """The elements of a path, each normalised, joined by `` > ``; NULL gives ``""``."""
    return F.coalesce(F.array_join(F.transform(col(c), lambda x: header_norm(F.coalesce(x, F.lit("")))), " > "), F.lit(""))


def amounts(c: str | Column) -> Column:
    """ARRAY<BIGINT> of the whole-dollar amounts in document order, amendment notes aside; ``$0`` is kept."""
    body = F.regexp_replace(F.coalesce(col(c), F.lit("")), ANNOTATION, "")
    found = F.regexp_extract_all(body, F.lit(f"({AMOUNT})"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, r"[$,]", "").try_cast("bigint"))


def word_amounts(c: str | Column) -> Column:
    """ARRAY<STRUCT<word_no, amount>>: the first amount of each word that has one, amendment notes aside."""
    ws = words(F.regexp_replace(F.coalesce(col(c), F.lit("")), ANNOTATION, ""))
    each = F.transform(ws, lambda w, i: F.struct(i.alias("word_no"), F.regexp_replace(F.regexp_extract(w, f"({AMOUNT})", 1), r"[$,]", "").try_cast("bigint").alias("amount")))
    return F.filter(each, lambda x: x["amount"].isNotNull())


def has_annotation(c: str | Column) -> Column:
    return F.coalesce(col(c).rlike(ANNOTATION), F.lit(False))


def unified_diff(old: Column, new: Column) -> Column:
    """Unified diff of two one-line texts as ARRAY<STRING>; empty where they are equal."""
    at = lambda c: F.when(c == "", F.lit("0,0")).otherwise(F.lit("1"))
    line = lambda sign, c: F.when(c != "", F.array(F.rtrim(F.concat(F.lit(sign), c)))).otherwise(F.array().cast("array<string>"))
    head = F.array(F.lit("--- old"), F.lit("+++ new"), F.concat(F.lit("@@ -"), at(old), F.lit(" +"), at(new), F.lit(" @@")))
    return F.when(old == new, F.array().cast("array<string>")).otherwise(F.concat(head, line("-", old), line("+", new)))


def money(c: Column) -> Column:
    """``$1,234``, a minus sign before the dollar sign."""
    return F.concat(F.when(c < 0, F.lit("-$")).otherwise(F.lit("$")), F.format_number(F.abs(c), 0))


def delta(old: Column, new: Column) -> Column:
    """The signed difference as money; NULL where a side is absent."""
    d = new - old
    return F.when(d.isNotNull(), F.concat(F.when(d > 0, F.lit("+")).otherwise(F.lit("")), money(d)))


def delta_percent(old: Column, new: Column) -> Column:
    """``+12.5%``; a dash where the old amount is 0."""
    r = F.round((new - old) * F.lit(100.0) / old, 1)
    return F.when(old == 0, F.lit("—")).when(r.isNotNull(), F.concat(F.when(r > 0, F.lit("+")).otherwise(F.lit("")), F.format_string("%.1f", r), F.lit("%")))


def title_match_header(label: Column) -> Column:
    """The header of a ``TITLE I—HEADER`` label; ``""`` without one; other labels as they are."""
    return F.when(label.rlike(r"^TITLE\s+[^\s—]+(—.*)?$"), F.regexp_replace(label, r"^TITLE\s+[^\s—]+—?", "")).otherwise(label)


def version_label(stem: Column) -> Column:
    """What follows the number of ``<number>_<label>``; other stems as they are."""
    return F.when(stem.rlike(r"^\d+_"), F.regexp_replace(stem, r"^\d+_", "")).otherwise(stem)


#: Chamber designators by bill type.
DESIGNATORS = {"hr": "H.R.", "s": "S.", "hjres": "H.J.Res.", "sjres": "S.J.Res.", "hconres": "H.Con.Res.", "sconres": "S.Con.Res.", "hres": "H.Res.", "sres": "S.Res."}


def bill_title(bill_type: Column, number: Column, official: Column) -> Column:
    """``H.R. 1 — title``; without a type only the title."""
    named = F.create_map(*[F.lit(x) for kv in DESIGNATORS.items() for x in kv])
    label = F.concat_ws(" ", F.coalesce(F.try_element_at(named, bill_type), F.upper(bill_type)), number.cast("string"))
    official = F.coalesce(official, F.lit(""))
    return F.when(F.coalesce(bill_type, F.lit("")) == "", official).when(official != "", F.concat(label, F.lit(" — "), official)).otherwise(label)


def bill_id(congress: Column, bill_type: Column, number: Column, version: Column | None = None) -> Column:
    base = F.concat_ws("-", congress.cast("string"), F.lower(bill_type), number.cast("string"))
    return base if version is None else F.when(F.coalesce(version, F.lit("")) == "", base).otherwise(F.concat_ws(":", base, version))


def parse_bill_id(c: Column) -> Column:
    """STRUCT<congress, bill_type, number, version> of ``118-hr-1[:label]``; NULL for other texts."""
    shape = r"^([^-:]+)-([^-:]+)-([^-:]+)(?::(.+))?$"
    part = lambda i: F.regexp_extract(c, shape, i)
    return F.when(c.rlike(shape), F.struct(part(1).alias("congress"), part(2).alias("bill_type"), part(3).alias("number"), F.nullif(part(4), F.lit("")).alias("version")))


def congress_of_year(year: Column) -> Column:
    return F.floor((year - 1789) / 2).cast("int") + 1


def slug(c: Column) -> Column:
    """Lower case, other characters to single dashes; ``unknown`` where nothing is left."""
    s = F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(s == "", F.lit("unknown")).otherwise(s)


def version_path(bill: Column, number: Column, label: Column, ext: str = "xml") -> Column:
    """Where a version's file stands: ``<bill>/<number>_<label>.<ext>``."""
    return F.concat(bill, F.lit("/"), number.cast("string"), F.lit("_"), slug(label), F.lit(f".{ext}"))


def printed_congress(head: Column) -> Column:
    """The number in ``118TH CONGRESS`` of a cover's first lines; ``""`` without one."""
    return F.regexp_extract(head, r"(?i)(\d{1,3})(?:ST|ND|RD|TH)\s+CONGRESS", 1)


def printed_title(text: Column, within: int = 1500, most: int = 140) -> Column:
    """Designator and long title in the opening of a printed bill, as far as they are found."""
    head = F.array_join(F.filter(F.transform(F.split(F.substring(text, 1, within), r"\n"), lambda x: F.trim(x)), lambda x: x != ""), " ")
    kinds = r"\b(H\.\s?R\.|[SH]\.\s?J\.\s?RES\.|[SH]\.\s?CON\.\s?RES\.|[SH]\.\s?RES\.|S\.)\s?(\d{1,5})\b"
    name = F.concat_ws(" ", F.replace(F.regexp_extract(head, kinds, 1), F.lit(" "), F.lit("")), F.nullif(F.regexp_extract(head, kinds, 2), F.lit("")))
    long_ = lambda opening: F.nullif(F.regexp_extract(head, rf"(?i)\b{opening}\b\s+(.+?\bpurposes\.)", 1), F.lit(""))
    title = F.regexp_replace(F.coalesce(long_("AN ACT"), long_("A BILL"), F.lit("")), r"\s+", " ")
    title = F.when(F.length(title) > most, F.concat(F.rtrim(F.substring(title, 1, most - 3)), F.lit("…"))).otherwise(title)
    return F.array_join(F.filter(F.array(F.trim(name), title), lambda x: x != ""), " — ")


def alnum_name(c: Column) -> Column:
    """Names as ground truth is compared: letters, digits and blanks of the lower-cased text."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9 ]", ""))


def glyph_norm(c: Column) -> Column:
    """Dashes, quotes and doubled single quotes of print brought to ASCII."""
    return F.replace(F.translate(c, "‐‑‒–—―−‘’‚‛“”„‟", "-------''''\"\"\"\""), F.lit("''"), F.lit('"'))


def breadcrumb(path: Column) -> Column:
    return F.array_join(path, " › ")
