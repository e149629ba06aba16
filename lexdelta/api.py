"""What a user calls: compare two delivered bills, as XML or as printed pages, and get tables, JSON or HTML."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexdelta import contract, report
from lexdelta.functions.text import amounts, printed_congress
from lexdelta.operators import anchors, blocks, compare, spans, tree
from lexdelta.session import cut, get_spark, ship
from lexdelta.sources import index as sources_index
from lexdelta.sources import print_lines, xml_bills


def pair_up(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sides of comparisons from parsed nodes and ``pairs`` (pair_id, old_doc, new_doc)."""
    side = lambda s: nodes.where("error is null").join(pairs.select("pair_id", F.col(f"{s}_doc").alias("doc_id"), F.lit(s).alias("side")), "doc_id")
    return side("old").unionByName(side("new"))


def xml_documents(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, canonical) of pairs of parsed bills, with full texts, trees and places of changes."""
    sides = cut(pair_up(nodes, pairs), "sides")
    found = cut(compare.compare(sides), "changes")
    changes = compare.with_money(found)
    doc = sides.withColumn("doc_id", F.concat_ws("|", "pair_id", "side"))
    lines = cut(spans.serialise(doc), "lines")
    bodies = spans.body_spans(lines)
    items = tree.items_of(doc)
    grouped = tree.group_front_matter(tree.build(items), items)
    trees = tree.nested_json(tree.placed(grouped, items, bodies, spans.heading_spans(lines)))
    texts = spans.full_text(lines)
    meta = sides.groupBy("pair_id", "side").agg(*(F.first(c).alias(c) for c in ("bill_type", "bill_number", "congress", "version_label")))
    wide = meta.withColumn("doc_id", F.concat_ws("|", "pair_id", "side")).join(texts, "doc_id", "left").join(trees, "doc_id", "left")
    wide = wide.withColumn("v", F.when(F.col("side") == "old", "v1").otherwise("v2"))
    names = wide.select("doc_id", "pair_id", F.col("v").alias("side"))
    placed = spans.change_spans(found, bodies.join(names, "doc_id"), texts.join(names, "doc_id"))
    meta_of = lambda v: [F.col("bill_type").alias(f"_t{v}"), F.col("bill_number").alias(f"_n{v}"), F.col("congress").alias(f"_c{v}")]
    one = lambda v: wide.where(F.col("v") == v).select("pair_id", F.col("version_label").alias(f"{v}_label"), F.col("full_text").alias(f"{v}_text"), F.col("tree").alias(f"{v}_tree"), *meta_of(v))
    heads = one("v1").join(one("v2"), "pair_id", "full")
    heads = heads.withColumns({"bill_type": F.coalesce("_tv1", "_tv2"), "number": F.coalesce("_nv1", "_nv2"), "congress": F.coalesce("_cv1", "_cv2")})
    same = found.where("change_type = 'unchanged'").groupBy("pair_id").agg(F.count("*").cast("int").alias("n"))
    return contract.documents(contract.xml_changes(changes, placed), heads, "xml", same)


def xml_diffs(nodes: DataFrame, pairs: DataFrame, financial: bool = False, include_unchanged: bool = True, needle: str | None = None) -> DataFrame:
    """(pair_id, diff): the plain record of each comparison; changes may be narrowed as on the command line."""
    sides = cut(pair_up(nodes, pairs), "sides")
    changes = compare.filter_changes(compare.compare(sides), needle, financial, include_unchanged)
    meta = sides.groupBy("pair_id", "side").agg(*(F.first(c).alias(c) for c in ("bill_type", "bill_number", "congress", "version_label")))
    of = lambda side, c: F.first(F.when(F.col("side") == side, F.col(c)), ignorenulls=True)
    heads = meta.groupBy("pair_id").agg(of("old", "version_label").alias("old_version"), of("new", "version_label").alias("new_version"), *(of("old", c).alias(c) for c in ("congress", "bill_type", "bill_number")))
    return contract.diff_documents(compare.with_money(changes) if financial else changes, heads, financial)


def printed_blocks(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, anchors with breadcrumbs) of printed lines."""
    merged = print_lines.page_lines(lines)
    flat = cut(print_lines.flat_lines(merged), "flat")
    found = cut(anchors.breadcrumbs(anchors.extract_anchors(merged, flat)), "anchors")
    return blocks.blocks(flat, found), found


def printed_hunks(lines: DataFrame, pairs: DataFrame, made: DataFrame | None = None) -> DataFrame:
    """Hunks of pairs of printed documents given as line tables (or as the ``blocks`` made of them)."""
    made = cut(printed_blocks(lines)[0], "blocks") if made is None else made
    side = lambda s: made.join(pairs.select("pair_id", F.col(f"{s}_doc").alias("doc_id")), "doc_id")
    return blocks.compare_blocks(side("old"), side("new"))


def printed_trees(found: DataFrame, front: DataFrame, shown: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, tree JSON) of printed documents: every heading with its own text's place and amounts.

    ``front`` (doc_id): documents with lines above their first heading; that text is theirs too. Amounts are taken
    from a heading's own text only, so none is counted twice.
    """
    opening = front.select("doc_id", F.lit(0).alias("anchor_no"), F.lit("preamble").alias("kind"), F.lit(blocks.FRONT).alias("text"), F.array(F.lit(blocks.FRONT)).alias("path"), F.lit(0).cast("bigint").alias("start_char"))
    at = shown.where("line_number is not null").groupBy("doc_id", "page", "line_number").agg(F.max_by("start_char", "line_ord").cast("bigint").alias("start_char"))
    every = found.join(at, ["doc_id", "page", "line_number"], "left").select("doc_id", "anchor_no", "kind", "text", "path", "start_char").unionByName(opening)
    own = spans.own_blocks(every.join(texts, "doc_id").withColumn("size", F.length("full_text")).drop("full_text"), F.col("size"))
    piece = F.substring("full_text", (F.col("block_start") + 1).cast("int"), (F.col("block_end") - F.col("block_start")).cast("int"))
    own = own.join(texts, "doc_id").select("doc_id", F.col("anchor_no").alias("item_ord"), "path", F.col("kind").alias("level"), F.coalesce(amounts(F.when(F.col("block_start").isNotNull(), piece)), F.array().cast("array<bigint>")).alias("own_amounts"), F.col("text").alias("header_text"), F.col("kind").alias("tag"), F.lit("").alias("section_number"), "block_start", "block_end")
    items = cut(own, "items")
    grouped = tree.group_front_matter(tree.build(items), items)
    # a document that opens with its own front matter needs no other node for it
    mine = grouped.where("parent_id = 'front' and item_ord = 0").select("doc_id", F.col("node_id").alias("_f"))
    up = F.when(F.col("parent_id") == "front", F.when(F.col("_f").isNull(), F.lit("front")).otherwise(F.nullif("_f", "node_id"))).otherwise(F.col("parent_id"))
    grouped = grouped.join(mine, "doc_id", "left").where("node_id <> 'front' or _f is null").withColumn("parent_id", up).drop("_f")
    places = items.select("doc_id", "item_ord", F.col("block_start").alias("start_char"), F.col("block_end").alias("end_char"))
    return tree.nested_json(grouped.join(places, ["doc_id", "item_ord"], "left"))


def printed_documents(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, canonical) of pairs of printed documents, with full texts, trees, places, and what their covers say."""
    merged = cut(print_lines.page_lines(lines), "lines")
    flat = cut(print_lines.flat_lines(merged), "flat")
    found = cut(anchors.breadcrumbs(anchors.extract_anchors(merged, flat)), "anchors")
    made = cut(blocks.blocks(flat, found), "blocks")
    shown = cut(print_lines.rendered(merged), "shown")
    texts = cut(print_lines.full_text(shown), "texts")
    front = made.where("block_no = 0 and anchor is not null").select("doc_id").distinct()
    trees = printed_trees(found, front, shown, texts)
    hunks = printed_hunks(lines, pairs, made)
    for side, name in (("v1", "old_doc"), ("v2", "new_doc")):
        ranges = hunks.join(pairs.select("pair_id", F.col(name).alias("doc_id")), "pair_id").where(f"{side}_range is not null").select("pair_id", "hunk_no", "doc_id", f"{side}_range.*")
        at = spans.range_spans(ranges, shown).where("start_char is not null").select("pair_id", "hunk_no", F.struct(F.col("start_char").alias("start"), F.col("end_char").alias("end")).alias(f"{side}_span"))
        hunks = hunks.join(at, ["pair_id", "hunk_no"], "left")
    w = Window.partitionBy("doc_id").orderBy("page", "line_ord")
    cover = merged.withColumn("_n", F.row_number().over(w)).where("_n <= 10").groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "line_ord", "text"))), lambda x: x["text"]), "\n").alias("head"))
    one = lambda v, name: pairs.select("pair_id", F.col(name).alias("doc_id")).join(texts, "doc_id", "left").join(trees, "doc_id", "left").join(cover, "doc_id", "left").select("pair_id", F.col("doc_id").alias(f"{v}_label"), F.coalesce("full_text", F.lit("")).alias(f"{v}_text"), F.coalesce("tree", F.lit("[]")).alias(f"{v}_tree"), F.coalesce(printed_congress(F.col("head")), F.lit("")).alias(f"_{v}"))
    no = F.lit("")
    heads = one("v1", "old_doc").join(one("v2", "new_doc"), "pair_id").withColumns({"bill_type": no, "number": no, "congress": F.col("_v2")})
    return contract.documents(contract.print_changes(hunks), heads, "pdf")


def compare_printed(spark: SparkSession, old: list[str], new: list[str], output: str = "json", labels: tuple[str, str] = ("Start version", "End version")) -> str:
    """One comparison of two printed bills given as the raw texts of their pages: the published JSON, or the HTML report."""
    ship(spark)
    pages = spark.createDataFrame([(label, n, t) for label, ts in zip(labels, (old, new)) for n, t in enumerate(ts, 1)], "doc_id string, page int, text string")
    pairs = spark.createDataFrame([("c", *labels)], "pair_id string, old_doc string, new_doc string")
    return _output(printed_documents(print_lines.print_lines(pages), pairs), output)


def compare_pdfs(spark: SparkSession, old: str, new: str, output: str = "json", labels: tuple[str, str] = ("Start version", "End version")) -> str:
    """``compare_printed`` of two PDF files; needs ``pypdfium2``."""
    texts = [[r["text"] for r in print_lines.read_pdf_pages(spark, path).orderBy("page").collect()] for path in (old, new)]
    return compare_printed(spark, *texts, output=output, labels=labels)


def compare_xml(spark: SparkSession, old: bytes | str, new: bytes | str, output: str = "json", labels: tuple[str, str] = ("old", "new"), **narrow) -> str:
    """One comparison of two bills given as XML: the published JSON, the HTML report, or the plain record (``diff``).

    ``narrow`` (financial, include_unchanged, needle) is for the plain record.
    """
    ship(spark)
    names = [f"{n}_{label}" for n, label in enumerate(labels, 1)]
    raw = [x if isinstance(x, str) else x.decode("utf-8") for x in (old, new)]
    nodes = cut(xml_bills.parse_documents(spark.createDataFrame(list(zip(names, raw)), "path string, content string")), "nodes")
    bad = xml_bills.errors(nodes).collect()
    if bad:
        raise ValueError("; ".join(f"{r['doc_id']}: {r['error']}" for r in bad))
    pairs = spark.createDataFrame([("c", *names)], "pair_id string, old_doc string, new_doc string")
    if output == "diff":
        return xml_diffs(nodes, pairs, **narrow).first()["diff"]
    return _output(xml_documents(nodes, pairs), output)


def _output(docs: DataFrame, output: str) -> str:
    if output not in ("json", "html"):
        raise ValueError(f"output is json or html, not {output}")
    return report.reports(docs).first()["html"] if output == "html" else docs.first()["canonical"]


def build_index(spark: SparkSession, archives: str, index: str | None, out: str, mode: str = "merge") -> int:
    """The index CSV at ``index`` (none: an empty one) brought up to date with the status archives below ``archives``; its number of records."""
    known = sources_index.read_csv(spark, index) if index else spark.createDataFrame([], ", ".join(f"{c} string" for c in sources_index.STATUS_COLUMNS))
    made = cut(sources_index.ingest(known, sources_index.read_archives(spark, archives), mode), "index")
    sources_index.write_csv(made, out)
    return made.count()


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexdelta", description="Compare two versions of a bill, and keep an index of bills.")
    sub = p.add_subparsers(dest="command", required=True)
    for name, what in (("compare", "two XML files"), ("print", "two printed bills: PDF files, or texts with a form feed between pages")):
        c = sub.add_parser(name, help=what)
        c.add_argument("old")
        c.add_argument("new")
        c.add_argument("-o", "--output")
        c.add_argument("--format", choices=("json", "html", "diff") if name == "compare" else ("json", "html"), default="html")
        if name == "compare":
            c.add_argument("--financial", action="store_true", help="only changes of amounts, with the amounts (diff)")
            c.add_argument("--include-unchanged", action="store_true", help="unchanged sections too (diff)")
            c.add_argument("--filter", help="only changes whose path holds this (diff)")
    i = sub.add_parser("index", help="bring the index up to date with status archives")
    i.add_argument("archives")
    i.add_argument("-i", "--index")
    i.add_argument("-o", "--output", required=True)
    i.add_argument("--mode", choices=("merge", "skip"), default="merge")
    return p


def _read(name: str) -> str:
    with open(name, encoding="utf-8", newline="") as f:
        return f.read()


def main(argv: list[str] | None = None) -> int:
    a = _arguments().parse_args(argv)
    spark = get_spark(master="local[*]")
    if a.command == "index":
        sys.stdout.write(f"{build_index(spark, a.archives, a.index, a.output, a.mode)} records\n")
        return 0
    if a.command == "compare":
        narrow = {"financial": a.financial, "include_unchanged": a.include_unchanged, "needle": a.filter} if a.format == "diff" else {}
        out = compare_xml(spark, _read(a.old), _read(a.new), output=a.format, **narrow)
    elif a.old.lower().endswith(".pdf"):
        out = compare_pdfs(spark, a.old, a.new, a.format)
    else:
        out = compare_printed(spark, _read(a.old).split("\f"), _read(a.new).split("\f"), a.format)
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(out)
    else:
        sys.stdout.write(out + "\n")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
