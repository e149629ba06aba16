"""Printed versions compared block by block: lines grouped below their headings, blocks aligned, pairs classified."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexdelta.functions import kernels as K
from lexdelta.functions import udfs
from lexdelta.functions.text import WS_CLASS, amounts, has_annotation
from lexdelta.operators import anchors as A

FRONT = "Front Matter"


def blocks(flat: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, block_no, anchor STRUCT, start_page, start_line, end_page, end_line, text): a row a block.

    An anchor opens a block at its line's first place and runs to the next one; anchors whose line is not found are
    left out with their place. Lines above the first anchor are the front matter; a document without anchors is one
    block without anchor. Headings at a block's ends are trimmed unless nothing would be left.
    """
    path = F.col("path") if "path" in anchors.columns else F.array("text")
    at = anchors.join(A.positions(flat), ["doc_id", "page", "line_number"]).withColumn("anchor", F.struct("kind", "text", "division", path.alias("path")))
    w = Window.partitionBy("doc_id").orderBy("anchor_no")
    spans = at.select("doc_id", "anchor_no", "anchor", F.col("flat_ix").alias("lo"), F.lead("flat_ix").over(w).alias("hi"))
    # anchors of one line give empty blocks but for the last of them
    lines = flat.withColumn("key", F.struct("flat_ix"))
    opened = spans.where("hi is null or hi > lo").select("doc_id", F.col("lo").alias("flat_ix"), "anchor", "anchor_no")
    run = Window.partitionBy("doc_id").orderBy("flat_ix").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.join(opened, ["doc_id", "flat_ix"], "left").withColumns({"anchor": F.last("anchor", ignorenulls=True).over(run), "block_no": F.coalesce(F.last("anchor_no", ignorenulls=True).over(run), F.lit(0))})
    some = F.max(F.col("block_no") > 0).over(Window.partitionBy("doc_id"))
    front = F.struct(F.lit("preamble").alias("kind"), F.lit(FRONT).alias("text"), F.lit("").alias("division"), F.array(F.lit(FRONT)).alias("path"))
    rows = rows.withColumn("anchor", F.when(F.col("anchor").isNull() & some, front).otherwise(F.col("anchor")))
    t = F.col("text")
    inner = Window.partitionBy("doc_id", "block_no").orderBy("flat_ix")
    bare = (F.row_number().over(inner) == 1) & (F.col("anchor.kind") == "title")
    chrome = A.is_blank(t) | (A.is_heading(t) & (F.size(amounts(t)) == 0)) | F.coalesce(bare, F.lit(False))
    chrome = chrome & (F.col("block_no") > 0)
    whole = Window.partitionBy("doc_id", "block_no")
    rows = rows.withColumn("chrome", chrome).withColumns({"a": F.min(F.when(~F.col("chrome"), F.col("flat_ix"))).over(whole), "z": F.max(F.when(~F.col("chrome"), F.col("flat_ix"))).over(whole)})
    rows = rows.where("a is null or flat_ix between a and z")
    parts = F.sort_array(F.collect_list(F.struct("flat_ix", "page", "line_number", "text", "anchor")))
    out = rows.groupBy("doc_id", "block_no").agg(parts.alias("r"))
    line = lambda c: F.coalesce(c, F.lit(-1))
    return out.select(
        "doc_id", "block_no", F.col("r")[0]["anchor"].alias("anchor"), F.col("r")[0]["page"].alias("start_page"), line(F.col("r")[0]["line_number"]).alias("start_line"),
        F.element_at("r", -1)["page"].alias("end_page"), line(F.element_at("r", -1)["line_number"]).alias("end_line"), F.array_join(F.transform("r", lambda x: x["text"]), "\n").alias("text"),
    )


def block_key(anchor_text: Column, text: Column) -> Column:
    return F.concat(F.coalesce(anchor_text, F.lit("(preamble)")), F.lit("::"), F.regexp_replace(F.substring(text, 1, 80), rf"^{WS_CLASS}+|{WS_CLASS}+$", ""))


def align(old: DataFrame, new: DataFrame) -> DataFrame:
    """(pair_id, step, old block, new block) of blocks with ``pair_id``: by sequence alignment of their keys, one pair of documents a group."""
    side = lambda d, s: d.select("pair_id", F.lit(s).alias("side"), F.struct("block_no", "anchor", "start_page", "start_line", "end_page", "end_line", "text").alias("b"), block_key(F.col("anchor.text"), F.col("text")).alias("key"))
    both = side(old, "old").unionByName(side(new, "new"))
    lists = both.groupBy("pair_id").agg(*(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct(F.col("b.block_no").alias("n"), "key", "b")))).alias(s) for s in ("old", "new")))

    def steps(olds: pd.Series, news: pd.Series) -> pd.Series:
        return pd.Series([[{"i": i, "j": j} for i, j in K.align_blocks([x["key"] for x in o], [x["key"] for x in n])] for o, n in zip(olds, news)], dtype=object)

    udf = F.pandas_udf(steps, "array<struct<i:int,j:int>>")
    slim = lambda c: F.transform(c, lambda x: F.struct(x["key"].alias("key")))
    out = lists.select("pair_id", "old", "new", F.posexplode(udf(slim("old"), slim("new"))).alias("step", "p"))
    return out.select("pair_id", "step", F.get("old", F.col("p.i"))["b"].alias("old"), F.get("new", F.col("p.j"))["b"].alias("new"))


def classify_pairs(aligned: DataFrame) -> DataFrame:
    """(pair_id, hunk_ord, change_type, old, new): equal blocks are dropped unless renamed; unlike ones split in two."""
    renamed = F.col("old.anchor.text") != F.col("new.anchor.text")
    keep = ["pair_id", "step", "part", "change_type", "old", "new"]
    one = aligned.where("old is null or new is null").withColumns({"part": F.lit(0), "change_type": F.when(F.col("old").isNull(), "added").otherwise("removed")})
    same = aligned.where("old.text = new.text").where(renamed).withColumns({"part": F.lit(0), "change_type": F.lit("moved")})
    other = aligned.where("old.text <> new.text").withColumn("sim", udfs.seq_ratio("old.text", "new.text"))
    other = other.withColumn("near", F.col("sim") >= K.SPLIT_BELOW).withColumn("part", F.explode(F.when(F.col("near"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    first = F.col("part") == 0
    other = other.withColumns({
        "change_type": F.when(F.col("near") & F.coalesce(renamed, F.lit(False)) & (F.col("sim") >= K.MOVE_FROM), "moved").when(F.col("near"), "modified").when(first, "removed").otherwise("added"),
        "old": F.when(F.col("near") | first, F.col("old")), "new": F.when(F.col("near") | ~first, F.col("new")),
    })
    out = one.select(keep).unionByName(same.select(keep)).unionByName(other.select(keep))
    return out.withColumn("hunk_ord", F.struct("step", "part")).drop("step", "part")


def with_block_moves(hunks: DataFrame) -> DataFrame:
    """Removed and added hunks re-linked as moved, at the removed one's place."""
    from lexdelta.operators.compare import find_moves

    order = F.struct(F.col("hunk_ord.step").alias("path_ord"), F.lit(0).alias("k"), F.col("hunk_ord.part").alias("part"))
    node = lambda s: F.struct(F.col(f"{s}.text").alias("body_text"))
    slim = hunks.where("change_type in ('removed', 'added')").select("pair_id", "change_type", order.alias("change_ord"), node("old").alias("old"), node("new").alias("new"))
    moves = find_moves(slim).select("pair_id", *(F.struct(F.col(f"{c}.path_ord").alias("step"), F.col(f"{c}.part").alias("part")).alias(c) for c in ("ro", "ao")))
    gone = moves.select("pair_id", F.explode(F.array("ro", "ao")).alias("hunk_ord"))
    old = hunks.select("pair_id", F.col("hunk_ord").alias("ro"), "old")
    new = hunks.select("pair_id", F.col("hunk_ord").alias("ao"), "new")
    made = moves.join(old, ["pair_id", "ro"]).join(new, ["pair_id", "ao"]).select("pair_id", F.lit("moved").alias("change_type"), "old", "new", F.col("ro").alias("hunk_ord"))
    return hunks.join(gone, ["pair_id", "hunk_ord"], "left_anti").unionByName(made)


def hunk_table(hunks: DataFrame) -> DataFrame:
    """Hunks numbered in order with texts, ranges, amount pairs (of two-sided hunks only) and the annotation flag."""
    w = Window.partitionBy("pair_id").orderBy("hunk_ord")
    rng = lambda s: F.when(F.col(s).isNotNull(), F.struct(*(F.col(f"{s}.{c}").alias(c) for c in ("start_page", "start_line", "end_page", "end_line"))))
    text = lambda s: F.coalesce(F.col(f"{s}.text"), F.lit(""))
    h = hunks.select("pair_id", F.row_number().over(w).alias("hunk_no"), "change_type", F.col("old.anchor.text").alias("v1_anchor"), F.col("new.anchor.text").alias("v2_anchor"), F.col("old.anchor.path").alias("v1_path"), F.col("new.anchor.path").alias("v2_path"), rng("old").alias("v1_range"), rng("new").alias("v2_range"), text("old").alias("v1_text"), text("new").alias("v2_text"))
    two = h.where("v1_range is not null and v2_range is not null").withColumn("amount_pairs", udfs.pair_amounts("v1_text", "v2_text"))
    one = h.where("v1_range is null or v2_range is null").withColumn("amount_pairs", F.array().cast("array<struct<old:bigint,new:bigint>>"))
    return two.unionByName(one).withColumn("has_amendment_annotations", has_annotation("v1_text") | has_annotation("v2_text"))


def compare_blocks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Hunks between the blocks of old and new printed documents, both keyed by ``pair_id``."""
    from lexdelta.session import cut

    return hunk_table(with_block_moves(cut(classify_pairs(align(old, new)), "hunks")))
