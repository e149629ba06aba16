"""Headings of printed documents: titles, sections, accounts, groupings, agencies, majors, divisions.

Input is the line table (doc_id, page, line_ord, line_number, text, glyph_size and, where known, content_left,
content_right, first_word_right). Every rule that looks at neighbours is a window over a document's lines:
carry-forwards, look-aheads and islands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How far sizes may differ, the share of lines whose size must be known, and how headings are printed.
EPS, COVERAGE = 0.3, 0.85
TITLE, SECTION = r"^TITLE\s+([IVXLC]+)\b.*$", r"^(SEC(?:TION)?\.?\s+\d+)\b"
BANNER = r"^DIVISION\s+([A-Z]+)\s*[—–]"
#: Words no heading ends with, and hyphens a heading may be broken with.
DANGLING = ("AND", "OR", "OF", "FOR", "TO", "THE", "A", "AN", "IN", "ON", "WITH", "AT", "BY")
WRAP = r"[-\x{2010}\x{2011}]$"


def is_blank(t: Column) -> Column:
    return F.trim(t) == ""


def is_heading(t: Column) -> Column:
    """Has a letter, has no lower-case letter, is no title or section line."""
    return t.rlike(r"\p{L}") & ~t.rlike(r"\p{Ll}") & ~t.rlike(TITLE) & ~t.rlike(SECTION)


def is_parenthetical(t: Column) -> Column:
    return F.trim(t).rlike(r"^\(.*\)$")


def has_lowercase(t: Column) -> Column:
    return t.rlike(r"[a-z]")


def dangles(t: Column) -> Column:
    return F.upper(F.element_at(F.split(F.trim(t), r"\s+"), -1)).isin(*DANGLING)


def joined(parts: Column) -> Column:
    """Heading lines as one name: a hyphen at a line's end joins, else a blank."""
    return F.aggregate(parts, F.lit(""), lambda a, x: F.when(a == "", x).when(a.rlike(WRAP), F.concat(F.regexp_replace(a, WRAP, ""), x)).otherwise(F.concat_ws(" ", a, x)))


def _meaningful(lines: DataFrame) -> DataFrame:
    """Lines that are neither blank nor in parentheses; the others are transparent to all look-ups."""
    return lines.where(~is_blank(F.col("text")) & ~is_parenthetical(F.col("text")))


def size_bands(lines: DataFrame) -> DataFrame:
    """(doc_id, body, heading_lo, heading_hi) of documents with one clear heading size below the body's.

    The body size is the most frequent rounded size of prose, the larger one on ties. Heading sizes split where they
    are more than 0.6 apart; a second cluster of 30 % of the dominant one, or none at all, leaves a document out.
    """
    sized = lines.where("line_number is not null and glyph_size is not null").withColumn("s", F.round("glyph_size", 1))
    modes = sized.where(has_lowercase(F.col("text"))).groupBy("doc_id", "s").count()
    body = modes.groupBy("doc_id").agg(F.max_by("s", F.struct("count", "s")).alias("body"))
    heads = sized.where(is_heading(F.col("text"))).join(body, "doc_id").where(F.col("glyph_size") < F.col("body") - EPS)
    sizes = heads.groupBy("doc_id", "body", "s").agg(F.count("*").alias("n"))
    w = Window.partitionBy("doc_id").orderBy("s")
    split = F.when(F.col("s") - F.lag("s").over(w) > 2 * EPS, 1).otherwise(0)
    clusters = sizes.withColumn("_x", split).withColumn("_c", F.sum("_x").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    clusters = clusters.groupBy("doc_id", "body", "_c").agg(F.sum("n").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi"))
    per = clusters.groupBy("doc_id", "body").agg(F.max_by(F.struct("lo", "hi", "n", "_c"), F.struct("n", -F.col("_c"))).alias("d"), F.collect_list(F.struct("_c", "n")).alias("cs"))
    rival = F.exists("cs", lambda c: (c["_c"] != F.col("d._c")) & (c["n"] >= 0.3 * F.col("d.n")))
    return per.where(~rival & (F.col("body") - F.col("d.hi") > 2 * EPS)).select("doc_id", "body", F.col("d.lo").alias("heading_lo"), F.col("d.hi").alias("heading_hi"))


def coverage(lines: DataFrame) -> DataFrame:
    """(doc_id, coverage): the share of numbered lines whose size is known."""
    return lines.where("line_number is not null").groupBy("doc_id").agg(F.avg(F.col("glyph_size").isNotNull().cast("double")).alias("coverage"))


def column_width(lines: DataFrame) -> DataFrame:
    """(doc_id, width): median right less median left edge of prose lines."""
    prose = lines.where(F.col("content_left").isNotNull() & has_lowercase(F.col("text")))
    return prose.groupBy("doc_id").agg((F.median("content_right") - F.median("content_left")).alias("width"))


def _anchor(kind: str | Column, text: Column, emit: int) -> list[Column]:
    return ["doc_id", "page", "line_number", (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), text.alias("text"), F.lit(emit).alias("emit")]


def title_section_anchors(lines: DataFrame) -> DataFrame:
    t = F.col("text")
    rows = lines.where(F.col("line_number").isNotNull() & (t.rlike(TITLE) | t.rlike(SECTION)))
    kind = F.when(t.rlike(TITLE), "title").otherwise("section")
    name = F.when(t.rlike(TITLE), F.concat(F.lit("TITLE "), F.regexp_extract(t, TITLE, 1))).otherwise(F.regexp_replace(F.regexp_extract(t, SECTION, 1), r"\s+", " "))
    return rows.select(*_anchor(kind, name, 0))


def _geometry(lines: DataFrame) -> DataFrame:
    for c in ("glyph_size", "content_left", "content_right", "first_word_right"):
        if c not in lines.columns:
            lines = lines.withColumn(c, F.lit(None).cast("double"))
    return lines


def sized_anchors(lines: DataFrame, bands: DataFrame) -> DataFrame:
    """Accounts, groupings and agencies by glyph size and by what follows.

    Runs of heading-band lines are islands. A run that follows a section line is that section's wrapped catchline and
    gives nothing. The last line of a run is a grouping before a section line and an account before body text or the
    document's end; the lines of the run above an account are its agency.
    """
    rows = _meaningful(lines).join(bands, "doc_id")
    t, s = F.col("text"), F.col("glyph_size")
    band = s.between(F.col("heading_lo") - EPS, F.col("heading_hi") + EPS)
    cand = F.col("line_number").isNotNull() & F.coalesce(band, F.lit(False)) & is_heading(t) & ~t.rlike(r"^\([0-9A-Za-z]{1,4}\)\s")
    w = Window.partitionBy("doc_id").orderBy("page", "line_ord")
    rows = rows.withColumns({"c": cand, "sec": F.trim(t).rlike(SECTION), "isbody": s.isNull() | (F.abs(s - F.col("body")) <= EPS)})
    rows = rows.withColumns({
        "g": F.count_if(~F.col("c")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "before": F.lag("sec").over(w), "pc": F.lag("c").over(w),
        "nc": F.lead("c").over(w), "nsec": F.lead("sec").over(w), "nbody": F.lead("isbody").over(w),
    }).where("c")
    run = Window.partitionBy("doc_id", "g").orderBy("page", "line_ord")
    catchline = F.coalesce(F.first("before").over(run), F.lit(False))
    rows = rows.withColumn("catch", catchline).where(~F.col("catch"))
    last = ~F.coalesce("nc", F.lit(False))
    kind = F.when(last & F.col("nsec"), "grouping").when(last & (F.col("nc").isNull() | F.coalesce("nbody", F.lit(False))), "account")
    leaf = rows.withColumn("kind", kind)
    own = leaf.where("kind is not null").select(*_anchor(F.col("kind"), F.trim("text"), 1))
    names = leaf.groupBy("doc_id", "g").agg(F.max_by("kind", F.struct("page", "line_ord")).alias("k"), F.sort_array(F.collect_list(F.struct("page", "line_ord", "line_number", F.trim("text").alias("t")))).alias("r")).where("k = 'account' and size(r) > 1")
    name = F.array_join(F.transform(F.slice("r", 1, F.size("r") - 1), lambda x: x["t"]), " ")
    agency = names.withColumn("text", name).where(~dangles(F.col("text"))).select("doc_id", F.col("r")[0]["page"].alias("page"), F.col("r")[0]["line_number"].alias("line_number"), F.lit("agency").alias("kind"), "text", F.lit(1).alias("emit"))
    return own.unionByName(agency)


def major_anchors(lines: DataFrame, bands: DataFrame, space: float = 6.0, slack: float = 4.0) -> DataFrame:
    """Departments: runs of body-size headings right under a bare title line.

    A line whose first word would have fitted on the line above begins a new department; names that end
    on a joining word are dropped.
    """
    rows = _meaningful(_geometry(lines)).join(bands, "doc_id").join(column_width(_geometry(lines)), "doc_id", "left")
    t = F.col("text")
    w = Window.partitionBy("doc_id").orderBy("page", "line_ord")
    major = F.col("line_number").isNotNull() & F.coalesce(F.abs(F.col("glyph_size") - F.col("body")) <= EPS, F.lit(False)) & is_heading(t) & ~t.rlike(r"^\([0-9A-Za-z]{1,4}\)\s")
    bare = F.col("line_number").isNotNull() & t.rlike(TITLE) & ~t.rlike(r"^TITLE\s+[IVXLC]+\s*[—–]\s*\S")
    rows = rows.withColumns({"m": major, "bare": bare})
    rows = rows.withColumns({"g": F.count_if(~F.col("m")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "under": F.lag("bare").over(w)}).where("m")
    run = Window.partitionBy("doc_id", "g").orderBy("page", "line_ord")
    rows = rows.withColumn("top", F.first("under").over(run)).where("top")
    before = lambda c: F.lag(c).over(run)
    early = (before("content_right") - before("content_left") + space + F.col("first_word_right") - F.col("content_left") <= F.col("width") - slack) & ~F.rtrim(before("text")).rlike(WRAP)
    rows = rows.withColumn("_x", F.when(F.coalesce(early, F.lit(False)), 1).otherwise(0)).withColumn("seg", F.sum("_x").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    segs = rows.groupBy("doc_id", "g", "seg").agg(F.sort_array(F.collect_list(F.struct("page", "line_ord", "line_number", F.trim("text").alias("t")))).alias("r"))
    segs = segs.withColumn("text", joined(F.transform("r", lambda x: x["t"]))).where(~dangles(F.col("text")))
    return segs.select("doc_id", F.col("r")[0]["page"].alias("page"), F.col("r")[0]["line_number"].alias("line_number"), F.lit("major").alias("kind"), "text", F.lit(2).alias("emit"))


def legacy_accounts(lines: DataFrame) -> DataFrame:
    """Accounts without sizes: the nearest heading in the three lines above ``For necessary expenses of``."""
    t = F.col("text")
    w = Window.partitionBy("doc_id", "page").orderBy("line_ord").rowsBetween(-3, -1)
    fits = F.col("line_number").isNotNull() & ~is_parenthetical(t) & is_heading(t)
    above = F.last(F.when(fits, F.struct("line_number", F.trim(t).alias("t"))), ignorenulls=True).over(w)
    rows = lines.withColumn("a", above).where(F.col("line_number").isNotNull() & t.rlike(r"(?i)^For necessary expenses of\b") & F.col("a").isNotNull())
    return rows.select("doc_id", "page", F.col("a.line_number").alias("line_number"), F.lit("account").alias("kind"), F.col("a.t").alias("text"), F.lit(1).alias("emit")).distinct()


def divisions(flat: DataFrame) -> DataFrame:
    """(doc_id, flat_ix, label): division banners with their wrapped names; of a letter met twice the last counts.

    A banner whose name runs straight into the next banner is an entry of a table of divisions and is dropped.
    """
    t = F.trim("text")
    w = Window.partitionBy("doc_id").orderBy("flat_ix")
    rows = flat.where(t != "").withColumns({"t": t, "banner": t.rlike(BANNER) & is_heading(t)})
    stops = ~F.col("banner") & ~is_heading(F.col("t")) & ~F.col("t").rlike(r"^\d{4},?$")
    rows = rows.withColumns({"b": F.count_if("banner").over(w.rowsBetween(Window.unboundedPreceding, 0)), "stop": stops}).where("b > 0")
    inside = Window.partitionBy("doc_id", "b").orderBy("flat_ix")
    rows = rows.withColumn("ended", F.max("stop").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    agg = rows.groupBy("doc_id", "b").agg(
        F.min("flat_ix").alias("flat_ix"), F.min_by("t", "flat_ix").alias("first"), F.max("stop").alias("stopped"),
        F.sort_array(F.collect_list(F.when(~F.col("ended") & ~F.col("banner"), F.struct("flat_ix", "t")))).alias("more"),
    )
    following = F.lead("b").over(Window.partitionBy("doc_id").orderBy("b"))
    agg = agg.withColumn("next", following).where("stopped or next is null")
    head = F.trim(F.regexp_replace("first", r"^[^—–]*[—–]", ""))
    agg = agg.withColumns({"letter": F.regexp_extract("first", BANNER, 1), "name": joined(F.concat(F.array(head), F.transform("more", lambda x: x["t"])))})
    agg = agg.groupBy("doc_id", "letter").agg(F.max_by(F.struct("flat_ix", "name"), "flat_ix").alias("x"))
    return agg.select("doc_id", F.col("x.flat_ix").alias("flat_ix"), F.concat(F.lit("Division "), F.col("letter"), F.lit(": "), F.col("x.name")).alias("label"))


def positions(flat: DataFrame) -> DataFrame:
    """(doc_id, page, line_number, flat_ix): the first place of each page and line number."""
    return flat.groupBy("doc_id", "page", "line_number").agg(F.min("flat_ix").alias("flat_ix"))


def with_divisions(anchors: DataFrame, flat: DataFrame) -> DataFrame:
    """Adds ``division``: the last banner at or above the anchor (an as-of look-up by place in the document), or ``""``."""
    placed = anchors.join(positions(flat), ["doc_id", "page", "line_number"], "left")
    events = placed.select("doc_id", F.coalesce("flat_ix", F.lit(-1)).alias("at"), F.lit(1).alias("z"), F.struct(*anchors.columns).alias("a"), F.lit(None).cast("string").alias("label"))
    marks = divisions(flat).select("doc_id", F.col("flat_ix").alias("at"), F.lit(0).alias("z"), F.lit(None).cast(events.schema["a"].dataType).alias("a"), "label")
    w = Window.partitionBy("doc_id").orderBy("at", "z").rowsBetween(Window.unboundedPreceding, 0)
    out = events.unionByName(marks).withColumn("division", F.coalesce(F.last("label", ignorenulls=True).over(w), F.lit("")))
    return out.where("a is not null").select("a.*", "division")


def extract_anchors(lines: DataFrame, flat: DataFrame) -> DataFrame:
    """(doc_id, anchor_no, page, line_number, kind, text, division) in document order, ties as they are found."""
    lines = _geometry(lines)
    bands = size_bands(lines).join(coverage(lines).where(F.col("coverage") >= COVERAGE).select("doc_id"), "doc_id", "left_semi")
    plain = lines.join(bands.select("doc_id"), "doc_id", "left_anti")
    found = title_section_anchors(lines).unionByName(sized_anchors(lines, bands)).unionByName(major_anchors(lines, bands)).unionByName(legacy_accounts(plain))
    w = Window.partitionBy("doc_id").orderBy("page", "line_number", "emit", "kind")
    out = with_divisions(found, flat).withColumn("anchor_no", F.row_number().over(w))
    return out.select("doc_id", "anchor_no", "page", "line_number", "kind", "text", "division")


def breadcrumbs(anchors: DataFrame) -> DataFrame:
    """Adds ``path``: the anchor's parents and itself, division first.

    Within one title: the nearest major above; for an account the nearest agency with no grouping or section in
    between; for a section the nearest grouping.
    """
    w = Window.partitionBy("doc_id").orderBy("anchor_no")
    rows = anchors.withColumn("tg", F.count_if(F.col("kind") == "title").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    up = Window.partitionBy("doc_id", "tg").orderBy("anchor_no").rowsBetween(Window.unboundedPreceding, -1)
    nearest = lambda c, v="text": F.last(F.when(c, F.col(v)), ignorenulls=True).over(up)
    k = F.col("kind")
    rows = rows.withColumns({"title": nearest(k == "title"), "major": nearest(k == "major"), "grp": nearest(k == "grouping"), "ag": nearest(k.isin("agency", "grouping", "section")), "agk": nearest(k.isin("agency", "grouping", "section"), "kind")})
    parents = F.array("division", "title", "major", F.when((k == "account") & (F.col("agk") == "agency"), F.col("ag")), F.when(k == "section", F.col("grp")))
    chain = F.when(k.isin("title", "preamble"), F.array("division", "text")).otherwise(F.array_append(parents, F.col("text")))
    return rows.withColumn("path", F.filter(chain, lambda x: x.isNotNull() & (x != ""))).drop("tg", "title", "major", "grp", "ag", "agk")


def title_descriptors(lines: DataFrame) -> DataFrame:
    """(doc_id, page, line_number, descriptor): the all-capitals line printed right below a title line, or ``""``."""
    w = Window.partitionBy("doc_id", "page").orderBy("line_ord")
    below = F.trim(F.coalesce(F.lead("text").over(w), F.lit("")))
    rows = lines.withColumn("below", below).where(F.col("line_number").isNotNull() & F.col("text").rlike(TITLE))
    named = (F.col("below") != "") & (F.col("below") == F.upper("below")) & ~F.col("below").startswith("SEC.")
    return rows.select("doc_id", "page", "line_number", F.when(named, F.col("below")).otherwise("").alias("descriptor"))
