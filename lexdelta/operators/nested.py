"""Deeply nested JSON records as flat tables that keep parent and child linked.

1. ``merged_schema`` infers one schema over all records: every path, the types seen there and
   how deep a recursive path goes.
2. ``explode_tree`` explodes one array level after the other, as deep as that schema says; each
   child carries its parent's surrogate key and its ordinal. The levels of one record are made by
   nested higher-order functions, so a record is parsed once and no level needs a shuffle.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _walk(value: object, path: str, child: str, depth: int, seen: Counter) -> None:
    """Count (path, type, depth); nested ``child`` levels share one path, so recursion adds no paths."""
    stack = [(value, path, depth)]
    while stack:
        value, path, depth = stack.pop()
        kind = {dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", float: "number"}.get(type(value), "null")
        seen[path, kind, depth] += 1
        if isinstance(value, dict):
            stack += [(v, path if k == child else f"{path}.{k}", depth + (k == child)) for k, v in value.items()]
        elif isinstance(value, list):
            stack += [(v, path + ("" if path.endswith("[]") else "[]"), depth) for v in value]


def merged_schema(df: DataFrame, payload: str, child: str = "children") -> DataFrame:
    """(path, type, n, max_depth): the merged schema of all complete JSON texts in ``payload``.

    Counts are summed in each batch before the shuffle. Incomplete JSON, NULL and empty texts have
    no schema; an empty table gives no rows.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch["p"]:
                try:
                    _walk(json.loads(text), "$", child, 0, seen)
                except (TypeError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["path", "type", "depth", "n"])

    parts = df.select(F.col(payload).alias("p")).mapInPandas(count, "path string, type string, depth int, n long")
    return parts.groupBy("path", "type").agg(F.sum("n").alias("n"), F.max("depth").alias("max_depth"))


def _entries(v: str) -> str:
    """SQL: the entries of a variant as an array; a lone object is a list of one, other entries than objects are no nodes."""
    whole = f"coalesce(try_variant_get({v}, '$', 'array<variant>'), array({v}))"
    return f"filter({whole}, e -> e is not null and schema_of_variant(e) like 'OBJECT%')"


def explode_tree(df: DataFrame, key: str, payload: str, root: str = "tree", sides: tuple[str, ...] = ("v1", "v2"), child: str = "children", depth: int | None = None) -> DataFrame:
    """(key, tree_side, node_pos, parent_pos, node_key, parent_key, depth, ordinal, node VARIANT), a row a node.

    ``depth`` is taken from the merged schema when not given: one aggregation whose single result is
    a number. ``tree_side`` is the first side where the tree is a list or a node itself. Incomplete
    JSON, NULL texts, absent and null trees give no rows; null entries take no ordinal; repeated
    deliveries are told apart by ``key``; a NULL key is kept. Other columns are not read.
    """
    if depth is None:
        deepest = merged_schema(df, payload, child).agg(F.max("max_depth")).first()[0]
        depth = (deepest or 0) + 1
    t = df.select(F.col(key).alias("_key"), F.expr(f"try_variant_get(try_parse_json({payload}), '$.{root}', 'variant')").alias("_t"))
    side = lambda s: f"try_variant_get(_t, '$.{s}', 'variant')"
    sided = " or ".join(f"{side(s)} is not null" for s in sides)
    pairs = ", ".join(f"struct('{s}' as s, {side(s)} as v)" for s in sides)
    t = t.where("_t is not null").select("_key", F.explode(F.expr(f"if({sided}, array({pairs}), array(struct('{sides[0]}' as s, _t as v)))")).alias("_s"))
    t = t.select("_key", F.col("_s.s").alias("_side"), F.col("_s.v").alias("_v")).where("_v is not null")
    t = t.withColumn("_l1", F.expr(f"transform({_entries('_v')}, (x, i) -> struct(cast(i + 1 as string) as pos, '' as parent, i + 1 as ord, 1 as depth, x as node))"))
    for d in range(2, depth + 1):
        kids = _entries(f"try_variant_get(n.node, '$.{child}', 'variant')")
        t = t.withColumn(f"_l{d}", F.expr(f"flatten(transform(_l{d - 1}, n -> transform({kids}, (c, j) -> struct(concat(n.pos, '.', j + 1) as pos, n.pos as parent, j + 1 as ord, {d} as depth, c as node))))"))
    t = t.select("_key", "_side", F.explode(F.concat(*(f"_l{d}" for d in range(1, depth + 1)))).alias("_n"))
    base = F.concat(F.coalesce(F.col("_key").cast("string"), F.lit("")), F.lit("/"), F.col("_side"), F.lit("/"))
    parent = F.when(F.col("_n.parent") != "", F.concat(base, F.col("_n.parent")))
    return t.select(
        F.col("_key").alias(key), F.col("_side").alias("tree_side"), F.col("_n.pos").alias("node_pos"), F.col("_n.parent").alias("parent_pos"),
        F.concat(base, F.col("_n.pos")).alias("node_key"), parent.alias("parent_key"), F.col("_n.depth").alias("depth"), F.col("_n.ord").alias("ordinal"), F.col("_n.node").alias("node"),
    )


def _text(path: str) -> Column:
    return F.expr(f"try_variant_get(node, '$.{path}', 'string')")


def node_table(nodes: DataFrame, key: str) -> DataFrame:
    """The scalar fields of ``explode_tree``'s nodes, optional and differently shaped ones brought to one form."""
    as_list = F.expr("try_variant_get(node, '$.display_path', 'array<string>')")
    as_text = F.split(_text("display_path"), " > ")
    return nodes.select(
        key, "tree_side", "node_pos", "parent_pos", "node_key", "parent_key", "depth", "ordinal", _text("label").alias("label"), _text("level").alias("level"),
        F.coalesce(as_list, as_text).alias("display_path"), _text("source.tag").alias("tag"), _text("source.element_id").alias("element_id"), _text("source.header_text").alias("header_text"),
        _text("source.division_label").alias("division_label"), _text("source.body_text").alias("body_text"),
        F.expr("try_variant_get(node, '$.full_text_span.start', 'bigint')").alias("span_start"), F.expr("try_variant_get(node, '$.full_text_span.end', 'bigint')").alias("span_end"),
    )


def amount_table(nodes: DataFrame, key: str) -> DataFrame:
    """(key, tree_side, node_pos, node_key, amount_ord, amount): the nodes' own amounts, printed ones read as dollars."""
    listed = "coalesce(try_variant_get(node, '$.own_amounts', 'array<variant>'), array(try_variant_get(node, '$.own_amounts', 'variant')))"
    each = nodes.select(key, "tree_side", "node_pos", "node_key", F.posexplode(F.expr(listed)).alias("at", "v"))
    amount = F.expr("coalesce(try_variant_get(v, '$', 'bigint'), try_cast(regexp_replace(try_variant_get(v, '$', 'string'), '[$, ]', '') as bigint))")
    return each.select(key, "tree_side", "node_pos", "node_key", (F.col("at") + 1).alias("amount_ord"), amount.alias("amount")).where("amount is not null")
