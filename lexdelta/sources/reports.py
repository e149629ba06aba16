"""Committee reports: fixed-width text in, accounts and comparative rows out. All windows, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Words that make a line part of a table's head, and words that title case leaves small.
_TABLE_HEAD = r"(?i)\b(?:recommendation|estimate|appropriations?|fiscal year|grand total|budget|amount|project title|activity)\b"
_SMALL = ("of", "and", "the", "for", "to", "in", "a", "an", "on", "at", "by", "or", "with")
# How dotted rows, summary lines and titles are printed.
_ROW = r"^(\s*.*?\S)\.{2,}\s+(.*\d.*)$"
_SUMMARY = r"^Committee recommendation\.{2,}\s+\$?([\d,]+)\s*$"
_TITLE = r"^\s*TITLE [IVXLC]+(?:\s*[-—–]{1,2}\s*(.+?))?\s*$"


def pre_text(c: Column) -> Column:
    """The text of the report's ``pre`` block with the five basic entities read."""
    t = F.regexp_extract(c, r"(?is)<pre>(.*?)</pre>", 1)
    for name, ch in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("nbsp", " "), ("amp", "&")):
        t = F.replace(t, F.lit(f"&{name};"), F.lit(ch))
    return t


def is_qualifier(s: Column) -> Column:
    """A rider such as ``(INCLUDING TRANSFER OF FUNDS)``, in parentheses or not."""
    return s.startswith("(") | s.rlike(r"^(?:INCLUDING|LIMITATION|RESCISSION)\b")


def is_heading(s: Column) -> Column:
    """More than four fifths of its letters are capitals, and it is no dotted row and no rider."""
    letters, capitals = F.length(F.regexp_replace(s, r"\P{L}", "")), F.length(F.regexp_replace(s, r"\P{Lu}", ""))
    return (s != "") & ~F.contains(s, F.lit("....")) & ~is_qualifier(s) & (letters > 0) & (capitals / letters > 0.8)


def is_title_case(s: Column) -> Column:
    ws = F.filter(F.regexp_extract_all(s, F.lit(r"([A-Za-z']+)"), F.lit(1)), lambda w: ~F.lower(w).isin(*_SMALL))
    return (F.size(ws) > 0) & F.forall(ws, lambda w: w.rlike(r"^\p{Lu}"))


def is_bureau(line: Column) -> Column:
    """An indented name in title case of at most twelve words: no table head, no prose, no run-in heading."""
    s = F.trim(line)
    return (
        line.rlike(r"^\s{4,}\S") & ~F.contains(s, F.lit("....")) & ~is_qualifier(s) & s.rlike(r"^\p{Lu}") & s.rlike(r"\p{Ll}") & ~s.rlike(_TABLE_HEAD) & ~s.rlike(r"\d")
        & ~s.rlike(r"\.\s*[-—–]") & (F.size(F.split(s, r"\s+")) <= 12) & ~s.rlike(r"[.:;,]$") & is_title_case(s)
    )


def report_lines(reports: DataFrame, text: str = "text") -> DataFrame:
    """(report_id, line_no, line) of plain report texts."""
    return reports.select("report_id", F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "line"))


def _titled(lines: DataFrame, w, pattern: str) -> DataFrame:
    """Adds ``tg`` (which title's part a line is in) and ``title``: the name in the title line, or the heading on the first of the next three lines that is not blank."""
    s = F.trim("line")
    following = F.coalesce(*(F.when(F.lead(s, k).over(w) != "", F.lead(s, k).over(w)) for k in (1, 2, 3)))
    named = F.when(is_heading(F.col("_n")), F.col("_n"))
    out = lines.withColumns({"is_t": F.col("line").rlike(pattern), "_n": following})
    inline = F.nullif(F.trim(F.regexp_extract("line", _TITLE, 1)), F.lit(""))
    return out.withColumn("_name", F.when(F.col("is_t"), F.coalesce(inline, named))).withColumn("tg", F.count_if("is_t").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def summary_accounts(lines: DataFrame) -> DataFrame:
    """(report_id, line_no, heading, committee_recommendation, title, bureau) of the accounts' summary blocks.

    The heading is the nearest line above, within seven, that is not blank, dotted or a rider, if it is one at all.
    """
    w = Window.partitionBy("report_id").orderBy("line_no")
    s = F.trim("line")
    rows = _titled(lines, w, r"^\s*TITLE [IVXLC]+\s*$")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    inside = Window.partitionBy("report_id", "tg").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    solid = (s != "") & ~F.contains(s, F.lit("....")) & ~is_qualifier(s)
    rows = rows.withColumns({
        "title": F.last("_name", ignorenulls=True).over(run), "bureau": F.last(F.when(is_bureau(F.col("line")), s), ignorenulls=True).over(inside),
        "above": F.last(F.when(solid, s), ignorenulls=True).over(w.rowsBetween(-7, -1)),
    })
    amount = F.regexp_replace(F.regexp_extract(s, _SUMMARY, 1), ",", "").try_cast("bigint")
    return rows.where(s.rlike(_SUMMARY) & is_heading(F.coalesce("above", F.lit("")))).select("report_id", "line_no", F.col("above").alias("heading"), amount.alias("committee_recommendation"), "title", "bureau")


def cells(c: Column) -> Column:
    """ARRAY<BIGINT> of a row's columns; dots, memo figures in parentheses and other tokens are NULL."""
    digits = lambda t: F.regexp_replace(t, r"[^\d]", "").try_cast("bigint")
    one = lambda t: F.when(t.rlike(r"^\.{2,}$") | t.startswith("("), F.lit(None).cast("bigint")).when(t.rlike(r"^[+\-]?\(?-?[\d,]+\)?$"), F.when(t.startswith("-"), -digits(t)).otherwise(digits(t)))
    return F.transform(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda t: t != ""), one)


def comparative_rows(lines: DataFrame) -> DataFrame:
    """(report_id, line_no, item, committee_recommendation_thousands, title, bureau) below the last statement header, or of the whole text without one."""
    w = Window.partitionBy("report_id").orderBy("line_no")
    begin = F.max(F.when(F.contains("line", F.lit("COMPARATIVE STATEMENT OF NEW BUDGET")), F.col("line_no"))).over(Window.partitionBy("report_id"))
    lines = lines.withColumn("_b", F.coalesce(begin, F.lit(0))).where("line_no >= _b").drop("_b")
    rows = _titled(lines, w, _TITLE)
    s, data = F.trim("line"), F.col("line").rlike(_ROW)
    inside = Window.partitionBy("report_id", "tg").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    section = F.when(~data & ~F.col("is_t") & (is_heading(s) | is_bureau(F.col("line"))), s)
    rows = rows.withColumns({"title": F.first("_name").over(inside), "bureau": F.last(section, ignorenulls=True).over(inside)})
    third = F.get(cells(F.regexp_extract("line", _ROW, 2)), F.lit(2))
    return rows.where(data & ~F.col("is_t") & third.isNotNull()).select("report_id", "line_no", F.trim(F.regexp_extract("line", _ROW, 1)).alias("item"), third.alias("committee_recommendation_thousands"), "title", "bureau")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(report_id, text) of the report pages below ``path``."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).withColumn("f", F.col("_metadata.file_name"))
    return raw.select(F.regexp_replace("f", r"\.[^.]*$", "").alias("report_id"), pre_text(F.col("value")).alias("text"))
