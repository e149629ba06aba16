"""Printed pages as numbered lines.

Input is the raw text of pages (doc_id, page, text), as a PDF text layer gives it, or glyphs. The
native PDF step is optional: ``read_pdf_pages`` needs ``pypdfium2`` and says so when it is absent.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexdelta.functions.kernels import lines_from_glyphs
from lexdelta.session import spread

#: Fixed value: the soft hyphen as the text layer gives it.
SOFT = chr(0xFFFE)
# A margin number; a footer or watermark glued to a line's end; numbered lines; page numbers, running
# heads and feet, print lines and watermarks.
MARGIN, GLUED, NUMBERED = r"(\d{1,2}) ", r"(?:VerDate\b|\S* on DSK)[^\n]*", r"^(\d{1,2}) (.*)$"
CHROME = (
    r"\A\d+ *\n",
    r"(?m)^•(?:HR|S)\b.*\n",
    r"(?m)^(?:H|S|HR|HRES|SRES|HJRES|SJRES|HCONRES|SCONRES)\s+\d+\s+[A-Z]{2,4}$\n?",
    r"(?s)\n?VerDate\b.*\z",
    r"(?s)\n?\S+ on DSK\S*PROD with .*\z",
)


def normalize_raw(c: Column) -> Column:
    """Line ends to LF; a soft hyphen with the next line's number after it becomes a hyphen and a line break; glued
    footers are cut; other soft hyphens before a lower-case letter join the word; line ends are trimmed."""
    c = F.replace(c, F.lit("\r\n"), F.lit("\n"))
    c = F.regexp_replace(c, SOFT + MARGIN, "-\n$1 ")
    c = F.regexp_replace(c, SOFT + GLUED, "-")
    c = F.regexp_replace(c, SOFT + r"([a-z])", "$1")
    return F.regexp_replace(F.replace(c, F.lit(SOFT), F.lit("-")), r"[^\S\n]+(?=\n|\z)", "")


def strip_chrome(c: Column) -> Column:
    """Without page number, running headers and footers, and what stands below the print line or the watermark."""
    for pattern in CHROME:
        c = F.regexp_replace(c, pattern, "")
    return c


def rejoin_soft_hyphens(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)(\w)-\n([a-z])", "$1$2")


def print_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page, line_ord, line_number, text): one row a printed line; unnumbered lines have a NULL number."""
    text = strip_chrome(normalize_raw(F.coalesce("text", F.lit(""))))
    each = pages.select("doc_id", "page", F.posexplode(F.split(text, "\n")).alias("line_ord", "raw"))
    number = F.regexp_extract("raw", NUMBERED, 1)
    return each.select("doc_id", "page", "line_ord", F.when(number != "", number.cast("int")).alias("line_number"), F.when(number != "", F.regexp_extract("raw", NUMBERED, 2)).otherwise(F.col("raw")).alias("text"))


def merge_hyphens(lines: DataFrame, within: list[str], order: list[str]) -> DataFrame:
    """Lines joined where one ends in a letter or digit and a hyphen and the next begins in lower case.

    A joined line keeps the first one's columns; ``src_start`` and ``src_end`` are the places of the lines it was
    made of, the end exclusive. Islands of joined lines are found with one window.
    """
    w = Window.partitionBy(*within).orderBy(*order)
    goes_on = F.coalesce(F.lag("text").over(w).rlike(r"[\p{L}\p{N}]-$"), F.lit(False)) & F.col("text").rlike(r"^\p{Ll}")
    rows = lines.withColumns({"_at": F.row_number().over(w) - 1, "_new": F.when(goes_on, 0).otherwise(1)})
    rows = rows.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rest = [c for c in lines.columns if c not in (*within, "text")]
    parts = F.sort_array(F.collect_list(F.struct("_at", "text")))
    last = F.element_at(parts, -1)["text"]
    cut_off = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.regexp_replace(x["text"], "-$", ""))
    out = rows.groupBy(*within, "_g").agg(F.min_by(F.struct(*rest), "_at").alias("_first"), F.concat(F.array_join(cut_off, ""), last).alias("text"), F.min("_at").alias("src_start"), (F.max("_at") + 1).alias("src_end"))
    return out.select(*within, "_first.*", "text", "src_start", "src_end")


def page_lines(lines: DataFrame) -> DataFrame:
    """Printed lines joined within each page."""
    return merge_hyphens(lines, ["doc_id", "page"], ["line_ord"])


def flat_lines(lines: DataFrame) -> DataFrame:
    """Page lines as one stream a document, joined across pages too; ``flat_ix`` numbers them from 0."""
    joined = merge_hyphens(lines.drop("src_start", "src_end"), ["doc_id"], ["page", "line_ord"])
    return joined.drop("src_start", "src_end").withColumn("flat_ix", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "line_ord")) - 1)


def rendered(lines: DataFrame) -> DataFrame:
    """Adds the row as shown (number right-aligned in five places) and its char span in the document's full text.

    Pages are set apart by a blank line; offsets count code points and are a running sum.
    """
    row = F.concat(F.coalesce(F.lpad(F.col("line_number").cast("string"), 5, " "), F.lit("     ")), F.lit("  "), F.col("text"))
    w = Window.partitionBy("doc_id").orderBy("page", "line_ord")
    out = lines.withColumn("row_text", row)
    turned = F.when(F.coalesce(F.lag("page").over(w) != F.col("page"), F.lit(False)), 1).otherwise(0)
    out = out.withColumn("_step", F.length("row_text") + 1).withColumn("_turn", turned)
    start = F.coalesce(F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("start_char", start).withColumn("end_char", F.col("start_char") + F.length("row_text")).drop("_step", "_turn")


def full_text(shown: DataFrame) -> DataFrame:
    """(doc_id, full_text) of ``rendered`` lines; bounded by one document."""
    w = Window.partitionBy("doc_id").orderBy("page", "line_ord")
    text = F.when(F.lag("page").over(w) != F.col("page"), F.concat(F.lit("\n"), F.col("row_text"))).otherwise(F.col("row_text"))
    each = shown.withColumn("_t", text)
    return each.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "line_ord", "_t"))), lambda x: x["_t"]), "\n").alias("full_text"))


def glyph_lines(glyphs: DataFrame) -> DataFrame:
    """(doc_id, page, line_ord, text, glyph_size, content_left, content_right) from glyphs (bottom, left, right, cp, size); a page a group."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        made = lines_from_glyphs([(b, x, y, chr(c), s) for b, x, y, c, s in pdf[["bottom", "left", "right", "cp", "size"]].itertuples(index=False)])
        out = pd.DataFrame(made, columns=["text", "glyph_size", "content_left", "content_right"])
        return out.assign(doc_id=pdf["doc_id"].iloc[0], page=pdf["page"].iloc[0], line_ord=range(len(out)))[["doc_id", "page", "line_ord", "text", "glyph_size", "content_left", "content_right"]]

    return spread(glyphs, "doc_id", "page").groupBy("doc_id", "page").applyInPandas(build, "doc_id string, page int, line_ord int, text string, glyph_size double, content_left double, content_right double")


def margin_sizes(glyphs: DataFrame) -> DataFrame:
    """(doc_id, page, line_number, glyph_size) of lines with a margin number; numbers met twice on a page are left out."""
    g = glyph_lines(glyphs).withColumn("line_number", F.regexp_extract("text", r"^(\d{1,2}) ", 1).try_cast("int")).where("line_number is not null")
    return g.groupBy("doc_id", "page", "line_number").agg(F.median("glyph_size").alias("glyph_size"), F.count("*").alias("n")).where("n = 1").drop("n")


def read_pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, page, text) of the PDF files below ``path``."""
    if importlib.util.find_spec("pypdfium2") is None:
        raise ImportError("reading PDF files needs pypdfium2; start from a table of pages instead")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pypdfium2 as pdfium

        for batch in batches:
            for name, data in zip(batch["path"], batch["content"]):
                doc = pdfium.PdfDocument(bytes(data))
                for n in range(len(doc)):
                    page = doc[n]
                    yield pd.DataFrame({"doc_id": [name], "page": [n + 1], "text": [page.get_textpage().get_text_range()]})
                    page.close()
                doc.close()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "doc_id string, page int, text string")
