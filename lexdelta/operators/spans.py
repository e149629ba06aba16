"""Where things stand in a document's full text: headings, bodies, changes, marks on rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexdelta.session import cut, spread


def common_prefix(a: Column, b: Column) -> Column:
    """How many first elements two arrays have in common."""
    n = F.least(F.size(a), F.size(b))
    same = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.get(a, (i - 1).cast("int")) == F.get(b, (i - 1).cast("int"))))
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, ok: F.struct((s["n"] + F.when(s["go"] & ok, 1).otherwise(0)).alias("n"), (s["go"] & ok).alias("go")), lambda s: s["n"])


def serialise(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_ord, line_no, text, kind, label, element_id, start_char, body_start, body_end): full text, a row a line.

    A node gives the part of its path that the node before had not, then its header if it has no path, then its body
    (with ``SEC. N.`` before a section's), each heading and body set apart by a blank line. Offsets count code points.
    ``path`` is the path a heading stands for.
    """
    w = Window.partitionBy("doc_id").orderBy("node_ord")
    path = F.coalesce("display_path", F.array().cast("array<string>"))
    heading = F.when((F.coalesce("section_number", F.lit("")) != "") & (F.size(path) > 0), F.slice(path, 1, F.size(path) - 1)).otherwise(path)
    n = nodes.withColumns({"_path": path, "_h": heading}).withColumn("_prev", F.coalesce(F.lag("_h").over(w), F.array().cast("array<string>")))
    n = n.withColumn("_c", common_prefix(F.col("_prev"), F.col("_h")))
    line = lambda text, kind, label, gap, pre, path=F.lit(None): F.struct(text.alias("text"), kind.alias("kind"), label.alias("label"), gap.alias("gap"), pre.alias("prefix"), path.alias("path"))
    no, zero = F.lit(None).cast("string"), F.lit(0)
    new = F.slice("_h", F.col("_c") + 1, F.greatest(F.size("_h") - F.col("_c"), F.lit(0)))
    heads = F.transform(new, lambda s, i: line(s, F.when((F.col("_c") + i == 0) | F.upper(s).startswith("TITLE "), "title").otherwise("account"), s, F.lit(True), zero, F.slice("_h", F.lit(1), F.col("_c") + i + 1)))
    lone = F.when((F.size("_path") == 0) & (F.coalesce("header_text", F.lit("")) != ""), F.array(line(F.col("header_text"), no, no, F.lit(False), zero)))
    shown = F.when(F.coalesce("display_text", F.lit("")) != "", F.col("display_text")).otherwise(F.col("body_text"))
    number = F.coalesce("section_number", F.lit(""))
    prefix = F.when(number != "", F.concat(F.upper(number), F.lit(".  "))).otherwise(F.lit(""))
    body = F.when(F.coalesce("body_text", F.lit("")) != "", F.array(line(F.concat(prefix, shown), F.when(number != "", "section").otherwise("body"), F.when(number != "", number), F.lit(True), F.length(prefix))))
    empty = F.array().cast("array<struct<text:string,kind:string,label:string,gap:boolean,prefix:int,path:array<string>>>")
    kind = "array<struct<text:string,kind:string,label:string,gap:boolean,prefix:int,path:array<string>>>"
    rows = n.select("doc_id", "node_ord", "element_id", F.posexplode(F.concat(heads.cast(kind), F.coalesce(lone.cast(kind), empty), F.coalesce(body.cast(kind), empty))).alias("at", "l")).select("doc_id", "node_ord", "at", "element_id", "l.*")
    o = Window.partitionBy("doc_id").orderBy("node_ord", "at")
    before = F.lag("kind").over(o)
    # a blank line follows every body and precedes headings and bodies, once
    blank = F.when(F.row_number().over(o) == 1, 0).when((F.col("gap")) | before.isin("section", "body"), 1).otherwise(0)
    rows = rows.withColumn("blank", blank).withColumn("step", F.length("text") + 1 + F.col("blank"))
    start = F.sum("step").over(o.rowsBetween(Window.unboundedPreceding, 0)) - F.length("text") - 1
    rows = rows.withColumn("start_char", start).withColumn("line_no", F.row_number().over(o) - 1 + F.sum("blank").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    is_body = F.col("kind").isin("section", "body")
    return rows.select("doc_id", "node_ord", "line_no", "text", "kind", "label", "element_id", "start_char", F.when(is_body, F.col("start_char") + F.col("prefix")).alias("body_start"), F.when(is_body, F.col("start_char") + F.length("text")).alias("body_end"), "blank", "path")


def full_text(lines: DataFrame) -> DataFrame:
    """(doc_id, full_text) of ``serialise``; bounded by one document."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "blank", "text"))), lambda x: F.concat(F.when(x["blank"] > 0, "\n").otherwise(""), x["text"]))
    return lines.groupBy("doc_id").agg(F.array_join(parts, "\n").alias("full_text"))


def sections(lines: DataFrame) -> DataFrame:
    """(doc_id, label, kind, start_char, descriptor): the list of headings; a bare title takes the account that follows as its descriptor."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    s = lines.where("kind in ('title', 'account', 'section')")
    bare = (F.col("kind") == "title") & F.upper("label").startswith("TITLE ") & ~F.col("label").contains("—")
    return s.select("doc_id", "label", "kind", "start_char", F.when(bare & (F.lead("kind").over(w) == "account"), F.lead("label").over(w)).alias("descriptor"))


def body_spans(lines: DataFrame) -> DataFrame:
    """(doc_id, element_id, start_char, end_char): each element's body, the last one where an id repeats."""
    b = lines.where("body_start is not null and coalesce(element_id, '') <> ''")
    return b.groupBy("doc_id", "element_id").agg(F.max_by(F.struct("body_start", "body_end"), "line_no").alias("s")).select("doc_id", "element_id", F.col("s.body_start").alias("start_char"), F.col("s.body_end").alias("end_char"))


def heading_spans(lines: DataFrame) -> DataFrame:
    """(doc_id, path, start_char): where the heading of each path first stands."""
    return lines.where("path is not null").groupBy("doc_id", "path").agg(F.min("start_char").alias("start_char"))


def range_spans(ranges: DataFrame, shown: DataFrame) -> DataFrame:
    """Adds ``start_char`` and ``end_char`` of page and line ranges by two look-ups; NULL where a line has no number or is not found."""
    at = shown.where("line_number is not null").groupBy("doc_id", "page", "line_number").agg(F.max_by(F.struct("start_char", "end_char"), "line_ord").alias("s"))
    first = at.select("doc_id", F.col("page").alias("start_page"), F.col("line_number").alias("start_line"), F.col("s.start_char").alias("_s"))
    last = at.select("doc_id", F.col("page").alias("end_page"), F.col("line_number").alias("end_line"), F.col("s.end_char").alias("_e"))
    out = ranges.join(first, ["doc_id", "start_page", "start_line"], "left").join(last, ["doc_id", "end_page", "end_line"], "left")
    both = F.col("_s").isNotNull() & F.col("_e").isNotNull()
    return out.withColumns({"start_char": F.when(both, F.col("_s")), "end_char": F.when(both, F.col("_e"))}).drop("_s", "_e")


def own_blocks(anchors: DataFrame, size: Column) -> DataFrame:
    """Adds ``block_start`` and ``block_end``: an anchor's own text, up to the next anchor whose place is known, by index.

    ``start_char`` is NULL where it is not known; ``size`` is the length of the full text.
    """
    w = Window.partitionBy("doc_id").orderBy("anchor_no").rowsBetween(1, Window.unboundedFollowing)
    nxt = F.coalesce(F.first("start_char", ignorenulls=True).over(w), size)
    return anchors.withColumns({"block_start": F.col("start_char"), "block_end": F.when(F.col("start_char").isNotNull(), F.greatest("start_char", nxt))})


def accept_marks(spans: DataFrame) -> DataFrame:
    """(doc_id, start_char, end_char, mark_id): of overlapping spans the first to start stays.

    The cursor moves on accepted spans only, so this is a pass over one document's sorted spans, not a window; a document is
    a group. Equal starts go by end and then by mark.
    """
    import numpy as np
    import pandas as pd

    def accept(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start_char", "end_char", "mark_id"])
        at, keep = 0, np.zeros(len(pdf), bool)
        for n, (start, end) in enumerate(zip(pdf["start_char"], pdf["end_char"])):
            if start >= at:
                at, keep[n] = end, True
        return pdf[keep]

    lean = spans.where("start_char is not null and end_char is not null").select("doc_id", F.col("start_char").cast("bigint"), F.col("end_char").cast("bigint"), F.col("mark_id").cast("bigint"))
    return spread(lean, "doc_id").groupBy("doc_id").applyInPandas(accept, lean.schema)


def marks_on_rows(rows: DataFrame, marks: DataFrame, bucket: int = 4096) -> DataFrame:
    """(doc_id, row_id, mark_id, from_char, to_char): the part of each mark on each row it overlaps.

    Rows and marks meet by (document, bucket of offsets), never all with all; a pair is kept in the first bucket both touch.
    """
    at = lambda a, z: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.greatest(F.col(z) - 1, F.col(a)) / bucket)))
    r = rows.where("row_end > row_start").select("doc_id", "row_id", "row_start", "row_end", at("row_start", "row_end").alias("b"))
    m = marks.where("end_char > start_char").select("doc_id", "mark_id", "start_char", "end_char", at("start_char", "end_char").alias("b"))
    out = r.join(m, ["doc_id", "b"]).where("start_char < row_end and end_char > row_start")
    out = out.where(F.col("b") == F.greatest(F.floor(F.col("row_start") / bucket), F.floor(F.col("start_char") / bucket)))
    return out.select("doc_id", "row_id", "mark_id", F.greatest("row_start", "start_char").alias("from_char"), F.least("row_end", "end_char").alias("to_char"))


def search_spans(changes: DataFrame, texts: DataFrame) -> DataFrame:
    """(pair_id, change_no, start_char, end_char) of texts looked up in their pair's full text.

    Looked for from the end of the last find on, then from the start; each find moves the place on, so the changes of one
    pair are gone through in order (``changes``: pair_id, change_no, target; ``texts``: pair_id, full_text). Changes that
    have a place already (``known_start``, ``known_end``, where the table has them) keep it and move the place on too.
    A text is held once a pair.
    """
    import pandas as pd

    for c in ("known_start", "known_end"):
        changes = changes if c in changes.columns else changes.withColumn(c, F.lit(None).cast("bigint"))

    def place(pdf: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        pdf, at, out = pdf.sort_values("change_no"), 0, []
        full = held["full_text"].iloc[0] if len(held) else None
        for target, start, end in zip(pdf["target"], pdf["known_start"], pdf["known_end"]):
            if target and not pd.isna(start):
                at = int(end)
                out.append((int(start), at))
                continue
            found = full.find(target, at) if target and full is not None else -1
            if found < 0 and target and full is not None:
                found = full.find(target)
            at = found + len(target) if found >= 0 else at
            out.append((found, at) if found >= 0 else (None, None))
        spots = pd.DataFrame(out, columns=["start_char", "end_char"], index=pdf.index, dtype="Int64")
        return pd.concat([pdf[["pair_id", "change_no"]], spots], axis=1)

    kinds = {c: changes.schema[c].dataType.simpleString() for c in ("pair_id", "change_no")}
    lean = changes.select("pair_id", "change_no", "target", "known_start", "known_end").groupBy("pair_id")
    out = lean.cogroup(texts.select("pair_id", "full_text").groupBy("pair_id")).applyInPandas(place, f"pair_id {kinds['pair_id']}, change_no {kinds['change_no']}, start_char bigint, end_char bigint")
    return out.where("pair_id is not null")


def change_spans(changes: DataFrame, bodies: DataFrame, texts: DataFrame) -> DataFrame:
    """(pair_id, side, change_no, start_char, end_char): changes placed by their element, else by looking their text up.

    ``bodies`` (pair_id, side v1/v2, element_id, start_char, end_char), ``texts`` (pair_id, side, full_text). Only pairs with
    a change that no element places have their texts searched.
    """
    one = lambda side, ident, text: changes.where("change_type <> 'unchanged'").select("pair_id", F.lit(side).alias("side"), "change_no", F.col(ident).alias("element_id"), F.col(text).alias("target"))
    c = one("v1", "element_id_old", "old_text").unionByName(one("v2", "element_id_new", "new_text")).where("coalesce(target, '') <> ''")
    known = bodies.select("pair_id", "side", "element_id", F.col("start_char").cast("bigint").alias("known_start"), F.col("end_char").cast("bigint").alias("known_end"))
    c = cut(c.join(known, ["pair_id", "side", "element_id"], "left").withColumn("k", F.struct("pair_id", "side")), "spans")
    missing = c.where("known_start is null").select("k").distinct()
    whole = c.join(missing, "k", "left_anti").select("pair_id", "side", "change_no", F.col("known_start").alias("start_char"), F.col("known_end").alias("end_char"))
    key = lambda df: df.withColumn("pair_id", F.to_json("k"))
    part = key(c.join(missing, "k", "left_semi"))
    full = key(texts.withColumn("k", F.struct("pair_id", "side")).join(missing, "k", "left_semi"))
    names = part.select("pair_id", "k").distinct()
    looked = search_spans(part, full).join(names, "pair_id").select(F.col("k.pair_id").alias("pair_id"), F.col("k.side").alias("side"), "change_no", "start_char", "end_char")
    return whole.unionByName(looked)
