"""The levelled structure of a document as an adjacency table; nesting happens at the sink.

Input items are (doc_id, item_ord, path ARRAY<STRING>, level, own_amounts, header_text, tag, section_number). Every item
stays exactly one content node, so no amount is lost or counted twice.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexdelta.functions.text import amounts
from lexdelta.session import cut, spread

# Levels by element.
LEAF = {"appropriations-major": "major", "appropriations-intermediate": "agency", "appropriations-small": "account", "section": "section", "front-matter": "preamble"}
FRONT = "Front Matter"


def leaf_level(tag: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LEAF.items() for x in kv]), F.coalesce(tag, F.lit(""))), F.lit("account"))


def interior_level(label: Column) -> Column:
    return F.when(label.rlike(r"^Division [A-Z](?=$|[\s:])"), "division").when(label.rlike(r"(?i)^TITLE\s+[IVXLCDM]+\b"), "title").otherwise("heading")


def items_of(nodes: DataFrame) -> DataFrame:
    """Tree items of parsed bill nodes; amounts come from the readable text, which keeps what the body text drops."""
    text = F.when(F.coalesce("display_text", F.lit("")) != "", F.col("display_text")).otherwise(F.col("body_text"))
    return nodes.select("doc_id", F.col("node_ord").alias("item_ord"), F.coalesce("display_path", F.array().cast("array<string>")).alias("path"), leaf_level(F.col("tag")).alias("level"), amounts(text).alias("own_amounts"), "header_text", "tag", "section_number", "element_id")


def build(items: DataFrame) -> DataFrame:
    """(doc_id, node_id, parent_id, sort_ord, depth, label, level, path, item_ord, own_amounts): the tree as an adjacency table.

    Prefixes without an item of their own become interior nodes, in the place they are first needed; the first item of
    such a path is adopted by it. Later items of one path are siblings of their own. ``node_id`` is ``i<item_ord>``
    for the node that owns a path (its first use) and for each further item.
    """
    none = F.array().cast("array<string>")
    i = items.select("doc_id", "item_ord", "path", "level", "own_amounts")
    w = Window.partitionBy("doc_id", "path").orderBy("item_ord")
    i = i.withColumn("rk", F.when(F.size("path") == 0, F.lit(2)).otherwise(F.row_number().over(w)))
    each = i.where(F.size("path") > 0).select("doc_id", "item_ord", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", F.lit(1), k))).alias("prefix"))
    first = each.groupBy("doc_id", "prefix").agg(F.min("item_ord").alias("sort_ord"))
    owner = i.where("rk = 1").select("doc_id", F.col("path").alias("prefix"), "item_ord", "level", "own_amounts")
    node_id = lambda d, o: F.concat(F.lit("p"), o.cast("string"), F.lit("."), d.cast("string"))
    paths = first.join(owner, ["doc_id", "prefix"], "left").withColumns({"depth": F.size("prefix"), "label": F.element_at("prefix", -1)})
    paths = paths.select("doc_id", node_id(F.col("depth"), F.col("sort_ord")).alias("node_id"), "sort_ord", "depth", "label", F.coalesce("level", interior_level(F.col("label"))).alias("level"), F.col("prefix").alias("path"), "item_ord", F.coalesce("own_amounts", F.array().cast("array<bigint>")).alias("own_amounts"))
    more = i.where("rk > 1").select("doc_id", F.concat(F.lit("i"), F.col("item_ord").cast("string")).alias("node_id"), F.col("item_ord").alias("sort_ord"), F.size("path").alias("depth"), F.when(F.size("path") > 0, F.element_at("path", -1)).otherwise("").alias("label"), "level", "path", "item_ord", "own_amounts")
    allnodes = paths.unionByName(more).withColumn("up", F.when(F.size("path") > 1, F.slice("path", F.lit(1), F.size("path") - 1)).otherwise(none))
    parents = paths.select("doc_id", F.col("path").alias("up"), F.col("node_id").alias("parent_id"))
    return allnodes.join(parents, ["doc_id", "up"], "left").drop("up")


def group_front_matter(tree: DataFrame, items: DataFrame) -> DataFrame:
    """Roots before the first title or division under one ``Front Matter`` node; without either only leading roots without a path."""
    roots = F.col("parent_id").isNull()
    doc = Window.partitionBy("doc_id")
    opening = F.min(F.when(roots & F.col("level").isin("title", "division"), F.col("sort_ord"))).over(doc)
    pathed = F.min(F.when(roots & (F.size("path") > 0), F.col("sort_ord"))).over(doc)
    limit = F.coalesce(opening, pathed, F.lit(1 << 30))
    t = tree.withColumn("front", roots & (F.col("sort_ord") < limit))
    meta = items.select("doc_id", "item_ord", F.coalesce("header_text", F.lit("")).alias("h"), F.when((F.col("tag") == "section"), F.coalesce("section_number", F.lit(""))).otherwise("").alias("sec"))
    t = t.join(meta, ["doc_id", "item_ord"], "left")
    label = F.when(F.col("front") & F.col("item_ord").isNotNull(), F.when(F.col("h") != "", F.col("h")).otherwise(F.col("sec"))).otherwise(F.col("label"))
    moved = t.withColumns({"label": label, "path": F.when(F.col("front") & F.col("item_ord").isNotNull(), F.array(F.lit(FRONT), label)).otherwise(F.col("path")), "parent_id": F.when(F.col("front"), F.lit("front")).otherwise(F.col("parent_id"))})
    top = moved.where("front").groupBy("doc_id").agg(F.min("sort_ord").alias("sort_ord")).select(
        "doc_id", F.lit("front").alias("node_id"), "sort_ord", F.lit(1).alias("depth"), F.lit(FRONT).alias("label"), F.lit("preamble").alias("level"), F.array(F.lit(FRONT)).alias("path"), F.lit(None).cast("int").alias("item_ord"), F.array().cast("array<bigint>").alias("own_amounts"), F.lit(None).cast("string").alias("parent_id")
    )
    return moved.drop("front", "h", "sec").unionByName(top)


def conservation(tree: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, amount, in_tree, in_items) of amounts the tree counts otherwise than its items; empty when money is conserved."""
    count = lambda d, n: d.select("doc_id", F.explode("own_amounts").alias("amount")).groupBy("doc_id", "amount").agg(F.count("*").alias(n))
    both = count(tree, "in_tree").join(count(items, "in_items"), ["doc_id", "amount"], "full")
    return both.na.fill(0, ["in_tree", "in_items"]).where("in_tree <> in_items")


def placed(tree: DataFrame, items: DataFrame, bodies: DataFrame, headings: DataFrame) -> DataFrame:
    """Adds ``start_char`` and ``end_char``: a node's body, else its heading, else all that stands directly below it.

    ``bodies`` (doc_id, element_id, start_char, end_char) and ``headings`` (doc_id, path, start_char) are places in the
    full text. A node of neither spans the nearest placed nodes below; NULL where there are none.
    """
    ids = items.select("doc_id", "item_ord", "element_id")
    body = bodies.select("doc_id", "element_id", F.col("start_char").alias("_bs"), F.col("end_char").alias("_be"))
    head = headings.select("doc_id", "path", F.col("start_char").alias("_hs"))
    own = tree.join(ids, ["doc_id", "item_ord"], "left").join(body, ["doc_id", "element_id"], "left").join(head, ["doc_id", "path"], "left")
    own = own.withColumns({"_s": F.coalesce("_bs", "_hs"), "_e": F.coalesce("_be", F.col("_hs") + F.length("label"))}).drop("_bs", "_be", "_hs", "element_id")
    own = cut(own, "placed")
    # a placed node counts for the open nodes above it, up to the first placed one
    up = own.where("_s is not null").select("doc_id", "node_id", "_s", "_e", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda k: F.slice("path", F.lit(1), k))).alias("k", "up")).where(F.size("up") == F.col("k"))
    owners = own.where(F.col("node_id").startswith("p")).select("doc_id", F.col("path").alias("up"), F.col("node_id").alias("_owner"), F.col("_s").isNotNull().alias("_placed"))
    up = up.join(owners, ["doc_id", "up"]).where("_owner <> node_id")
    stop = F.max(F.when(F.col("_placed"), F.col("k"))).over(Window.partitionBy("doc_id", "node_id"))
    wide = up.withColumn("_stop", F.coalesce(stop, F.lit(-1))).where("k > _stop").groupBy("doc_id", F.col("_owner").alias("node_id")).agg(F.min("_s").alias("_lo"), F.max("_e").alias("_hi"))
    out = own.join(wide, ["doc_id", "node_id"], "left").withColumns({"start_char": F.coalesce("_s", "_lo"), "end_char": F.coalesce("_e", "_hi")})
    front = out.where("parent_id = 'front'").groupBy("doc_id").agg(F.min("start_char").alias("_fs"), F.max("end_char").alias("_fe")).withColumn("node_id", F.lit("front"))
    out = out.join(front, ["doc_id", "node_id"], "left").withColumns({"start_char": F.coalesce("start_char", "_fs"), "end_char": F.coalesce("end_char", "_fe")})
    return out.drop("_s", "_e", "_lo", "_hi", "_fs", "_fe")


def walk(tree: DataFrame) -> DataFrame:
    """Adds ``walk_no``: depth-first order, children by their place."""
    w = Window.partitionBy("doc_id").orderBy("sort_ord", "depth", "node_id")
    return tree.withColumn("walk_no", F.row_number().over(w))


def nested_json(tree: DataFrame) -> DataFrame:
    """(doc_id, tree JSON): nodes nested below their parents, with their places where ``placed`` gave them; a document a group."""
    import pandas as pd

    def nest(pdf: pd.DataFrame) -> pd.DataFrame:
        made = {r.node_id: {"label": r.label, "level": r.level, "own_amounts": [int(a) for a in r.own_amounts], "full_text_span": None if pd.isna(r.start_char) else {"start": int(r.start_char), "end": int(r.end_char)}, "children": []} for r in pdf.itertuples()}
        roots = []
        for r in pdf.sort_values(["sort_ord", "depth", "node_id"]).itertuples():
            (made[r.parent_id]["children"] if r.parent_id in made else roots).append(made[r.node_id])
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "tree": [json.dumps(roots, ensure_ascii=False)]})

    for c in ("start_char", "end_char"):
        tree = tree if c in tree.columns else tree.withColumn(c, F.lit(None).cast("bigint"))
    lean = tree.select("doc_id", "node_id", "parent_id", "sort_ord", "depth", "label", "level", "own_amounts", "start_char", "end_char")
    return spread(lean, "doc_id").groupBy("doc_id").applyInPandas(nest, "doc_id string, tree string")
