"""The published comparison document: one JSON text a pair, version 1.3, with explicit nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexdelta.operators.compare import TYPES, real_pairs

SCHEMA_VERSION, GENERATOR = "1.3", "lexdelta"
SPAN = "struct<start:bigint,end:bigint>"
_NULL_SPANS = f"struct<v1:{SPAN},v2:{SPAN}>"


def change_id(n: Column) -> Column:
    return F.format_string("c-%04d", n)


def _or_null(path: str) -> Column:
    return F.when(F.size(path) > 0, F.col(path))


def xml_changes(changes: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """(pair_id, n, change STRUCT) of structured changes; unchanged ones are dropped before numbering.

    ``spans`` (pair_id, side v1/v2, change_no, start_char, end_char) places changes in the full texts.
    """
    c = changes.where("change_type <> 'unchanged'")
    w = Window.partitionBy("pair_id").orderBy("change_no")
    c = c.withColumn("n", F.row_number().over(w))
    if spans is not None:
        for side in ("v1", "v2"):
            at = spans.where((F.col("side") == side) & F.col("start_char").isNotNull()).select("pair_id", "change_no", F.struct(F.col("start_char").alias("start"), F.col("end_char").alias("end")).alias(f"_{side}"))
            c = c.join(at, ["pair_id", "change_no"], "left")
        span = F.struct(F.col("_v1").cast(SPAN).alias("v1"), F.col("_v2").cast(SPAN).alias("v2"))
    else:
        span = F.lit(None).cast(_NULL_SPANS)
    same = F.coalesce("old_text", F.lit("")) == F.coalesce("new_text", F.lit(""))
    no = F.lit(None).cast("string")
    move = F.when(F.col("change_type") == "moved", F.struct(F.lit("relocated").alias("kind"), no.alias("old_label"), no.alias("new_label"), same.alias("body_unchanged")))
    pairs = F.coalesce(real_pairs(F.col("financial.paired_amounts")), F.array().cast("array<struct<old:bigint,new:bigint>>"))
    place = "struct<start_page:int,start_line:int,end_page:int,end_line:int>"
    change = F.struct(
        change_id(F.col("n")).alias("id"), "change_type", F.coalesce("section_number", F.lit("")).alias("section_number"), F.struct(_or_null("display_path_old").alias("v1"), _or_null("display_path_new").alias("v2")).alias("path"),
        F.lit(None).cast(f"struct<v1:{place},v2:{place}>").alias("location"), F.lit("resolved").alias("anchor_resolution"), F.struct(F.col("old_text").alias("old"), F.col("new_text").alias("new")).alias("text"),
        pairs.alias("amounts"), move.alias("move"), span.alias("full_text_span"),
    )
    return c.select("pair_id", "n", change.alias("change"))


def print_changes(hunks: DataFrame) -> DataFrame:
    """(pair_id, n, change STRUCT) of printed hunks: ranges as locations, renumbered sections named.

    ``v1_path``, ``v2_path`` and ``v1_span``, ``v2_span`` are used where the table has them.
    """
    have = set(hunks.columns)
    path = lambda s: (F.col(f"{s}_path") if f"{s}_path" in have else F.when(F.col(f"{s}_anchor").isNotNull(), F.array(f"{s}_anchor"))).alias(s)
    span = lambda s: (F.col(f"{s}_span") if f"{s}_span" in have else F.lit(None)).cast(SPAN).alias(s)
    line = lambda s, c: F.when(F.col(f"{s}_range.{c}") >= 0, F.col(f"{s}_range.{c}")).alias(c)
    place = lambda s: F.when(F.col(f"{s}_range").isNotNull(), F.struct(F.col(f"{s}_range.start_page").alias("start_page"), line(s, "start_line"), F.col(f"{s}_range.end_page").alias("end_page"), line(s, "end_line"))).alias(s)
    ranged = F.col("v1_range").isNotNull() | F.col("v2_range").isNotNull()
    known = F.col("v1_anchor").isNotNull() | F.col("v2_anchor").isNotNull()
    renumbered = F.coalesce(F.col("v1_anchor") != F.col("v2_anchor"), F.lit(False))
    move = F.when(F.col("change_type") == "moved", F.struct(F.when(renumbered, "renumbered").otherwise("relocated").alias("kind"), F.when(renumbered, F.col("v1_anchor")).alias("old_label"), F.when(renumbered, F.col("v2_anchor")).alias("new_label"), (F.col("v1_text") == F.col("v2_text")).alias("body_unchanged")))
    spans = F.struct(span("v1"), span("v2")) if {"v1_span", "v2_span"} & have else F.lit(None).cast(_NULL_SPANS)
    change = F.struct(
        change_id(F.col("hunk_no")).alias("id"), "change_type", F.lit("").alias("section_number"), F.struct(path("v1"), path("v2")).alias("path"), F.struct(place("v1"), place("v2")).alias("location"),
        F.when(known | ~ranged, "resolved").otherwise("degraded").alias("anchor_resolution"), F.struct(F.when(F.col("v1_range").isNotNull(), F.col("v1_text")).alias("old"), F.when(F.col("v2_range").isNotNull(), F.col("v2_text")).alias("new")).alias("text"),
        real_pairs(F.col("amount_pairs")).alias("amounts"), move.alias("move"), spans.alias("full_text_span"),
    )
    return hunks.select("pair_id", F.col("hunk_no").alias("n"), change.alias("change"))


def documents(changes: DataFrame, headers: DataFrame, source: str, unchanged: DataFrame | None = None) -> DataFrame:
    """(pair_id, canonical JSON) from numbered changes and ``headers`` (pair_id, bill_type, number, congress, v1_label, v2_label).

    Optional header columns: v1_number, v2_number, v1_text, v2_text (full texts), v1_tree, v2_tree (JSON). A tree needs
    full texts. Pairs without changes still give a document. Structured comparisons list all five types in the summary,
    printed ones those present; ``unchanged`` (pair_id, n) gives the count of what is not published. A document is
    bounded by one comparison.
    """
    have = set(headers.columns)
    opt = lambda c, t: (F.col(c) if c in have else F.lit(None)).cast(t)
    types = TYPES if source == "xml" else ("added", "removed", "modified", "moved")
    counts = [F.count_if(F.col("change.change_type") == t).alias(f"_{t}") for t in types]
    per = changes.groupBy("pair_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", F.to_json("change", {"ignoreNullFields": "false"}).alias("j")))), lambda x: x["j"]).alias("_c"), *counts)
    if unchanged is not None:
        per = headers.select("pair_id").join(per, "pair_id", "left").join(unchanged.select("pair_id", F.col("n").alias("_u")), "pair_id", "left").drop("_unchanged").withColumnRenamed("_u", "_unchanged")
    h = headers.join(per, "pair_id", "left")
    entries = F.array(*(F.struct(F.lit(t).alias("k"), F.coalesce(f"_{t}", F.lit(0)).alias("v")) for t in types))
    kept = entries if source == "xml" else F.filter(entries, lambda e: e["v"] > 0)
    text = F.when(opt("v1_text", "string").isNotNull() & opt("v2_text", "string").isNotNull(), F.struct(opt("v1_text", "string").alias("v1"), opt("v2_text", "string").alias("v2")))
    label = lambda s: F.struct(F.coalesce(f"{s}_label", F.lit("")).alias("label"), opt(f"{s}_number", "int").alias("version_number"), F.lit(source).alias("source"))
    to = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    tree = F.when(text.isNotNull() & opt("v1_tree", "string").isNotNull() & opt("v2_tree", "string").isNotNull(), F.concat(F.lit('{"v1":'), opt("v1_tree", "string"), F.lit(',"v2":'), opt("v2_tree", "string"), F.lit("}")))
    head = to(F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.struct(F.lit(GENERATOR).alias("name"), F.lit("0").alias("version")).alias("generator"),
        F.struct(F.coalesce("bill_type", F.lit("")).alias("type"), F.coalesce(F.col("number").cast("string"), F.lit("")).alias("number"), F.coalesce(F.col("congress").cast("string"), F.lit("")).alias("congress")).alias("bill"),
        F.struct(label("v1").alias("v1"), label("v2").alias("v2")).alias("versions"), F.map_from_entries(kept).alias("summary"), text.alias("full_text"),
    ))
    body = F.array_join(F.coalesce("_c", F.array().cast("array<string>")), ",")
    doc = F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(',"tree":'), F.coalesce("tree", F.lit("null")), F.lit(',"changes":['), F.col("body"), F.lit("]}"))
    return h.withColumns({"head": head, "tree": tree, "body": body}).select("pair_id", doc.alias("canonical"))


def diff_documents(changes: DataFrame, headers: DataFrame, financial: bool = False) -> DataFrame:
    """(pair_id, diff JSON): the plain record of a comparison, every change given, in order.

    ``headers``: pair_id, old_version, new_version, congress, bill_type, bill_number. With ``financial`` the changes of
    ``compare.with_money`` carry their amounts, and how many sections changed theirs is counted. A record is bounded
    by one comparison.
    """
    to = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    entry = to(F.struct(_or_null("display_path_old").alias("display_path_old"), _or_null("display_path_new").alias("display_path_new"), "match_path", "change_type", "old_text", "new_text", "text_diff", "section_number", "element_id_old", "element_id_new"))
    if financial:
        paid = F.col("financial").withField("paired_amounts", F.transform("financial.paired_amounts", lambda p: F.array(p["old"], p["new"])))
        entry = F.when(F.col("financial").isNull(), entry).otherwise(F.concat(F.substring(entry, F.lit(1), F.length(entry) - 1), F.lit(',"financial":'), to(paid), F.lit("}")))
    counted = F.count_if(F.coalesce(F.col("financial.amounts_changed"), F.lit(False))) if financial else F.max(F.lit(0))
    per = changes.withColumn("j", entry).groupBy("pair_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("change_no", "j"))), lambda x: x["j"]).alias("_c"), *(F.count_if(F.col("change_type") == t).alias(f"_{t}") for t in TYPES), counted.alias("_paid"))
    h = headers.join(per, "pair_id", "left")
    counts = F.map_from_entries(F.array(*(F.struct(F.lit(t).alias("k"), F.coalesce(f"_{t}", F.lit(0)).alias("v")) for t in TYPES)))
    head = to(F.struct("old_version", "new_version", "congress", "bill_type", "bill_number", counts.alias("summary")))
    tail = F.concat(F.lit(',"financial_summary":{"sections_with_financial_changes":'), F.coalesce(F.col("_paid"), F.lit(0)).cast("string"), F.lit("}}")) if financial else F.lit("}")
    doc = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"changes":['), F.array_join(F.coalesce("_c", F.array().cast("array<string>")), ","), F.lit("]"), tail)
    return h.select("pair_id", doc.alias("diff"))


#: The form of a published change, for reading documents back.
CHANGE = (
    "struct<id:string,change_type:string,section_number:string,path:struct<v1:array<string>,v2:array<string>>,"
    "location:struct<v1:struct<start_page:int,start_line:int,end_page:int,end_line:int>,v2:struct<start_page:int,start_line:int,end_page:int,end_line:int>>,"
    "anchor_resolution:string,text:struct<old:string,new:string>,amounts:array<struct<old:bigint,new:bigint>>,"
    "move:struct<kind:string,old_label:string,new_label:string,body_unchanged:boolean>,full_text_span:struct<v1:struct<start:bigint,end:bigint>,v2:struct<start:bigint,end:bigint>>>"
)
DOCUMENT = f"schema_version string, bill struct<type:string,number:string,congress:string>, versions struct<v1:struct<label:string,version_number:int,source:string>,v2:struct<label:string,version_number:int,source:string>>, summary map<string,int>, full_text struct<v1:string,v2:string>, changes array<{CHANGE}>"


def read_documents(docs: DataFrame, column: str = "canonical") -> DataFrame:
    """The documents' fields; a document that is no JSON gives NULL fields."""
    return docs.withColumn("doc", F.from_json(F.col(column), DOCUMENT))


def range_text(r: Column) -> Column:
    """``p.3 L.7`` style text of a location, a dash for none."""
    one = lambda p, n: F.when(r[n].isNull(), F.concat(F.lit("p."), r[p].cast("string"))).otherwise(F.concat(F.lit("p."), r[p].cast("string"), F.lit(" L"), r[n].cast("string")))
    a, z = one("start_page", "start_line"), one("end_page", "end_line")
    return F.when(r.isNull(), "—").when(a == z, a).otherwise(F.concat(a, F.lit(" – "), z))


def views(docs: DataFrame) -> DataFrame:
    """(pair_id, id, change_type, group_label, heading, place, move_note, old_text, new_text, n_amounts): what a reader shows a change as."""
    c = read_documents(docs).select("pair_id", F.posexplode("doc.changes").alias("at", "c"))
    path = F.coalesce("c.path.v2", "c.path.v1", F.array().cast("array<string>"))
    crumb = F.array_join(path, " > ")
    degraded = F.col("c.anchor_resolution") == "degraded"
    loc = F.coalesce("c.location.v2", "c.location.v1")
    note = (
        F.when(F.col("c.move.kind") == "renumbered", F.concat(F.lit("Renumbered: "), F.col("c.move.old_label"), F.lit(" → "), F.col("c.move.new_label"), F.when(F.col("c.move.body_unchanged"), " · body text unchanged").otherwise("")))
        .when(F.col("c.move").isNotNull(), F.concat(F.lit("Moved: "), F.coalesce(F.array_join("c.path.v1", " > "), range_text(F.col("c.location.v1"))), F.lit(" → "), F.coalesce(F.array_join("c.path.v2", " > "), range_text(F.col("c.location.v2")))))
    )
    return c.select(
        "pair_id", "at", F.col("c.id").alias("id"), F.col("c.change_type").alias("change_type"), F.when(F.size(path) > 1, path[0]).when(F.size(path) == 1, path[0]).otherwise("Uncategorized").alias("group_label"),
        F.when(degraded, F.concat(F.lit("(uncategorized) — "), range_text(loc))).when(crumb != "", crumb).otherwise("(unknown)").alias("heading"), F.when(F.col("c.location").isNotNull(), F.concat(range_text(F.col("c.location.v1")), F.lit(" | "), range_text(F.col("c.location.v2")))).alias("place"),
        note.alias("move_note"), F.col("c.text.old").alias("old_text"), F.col("c.text.new").alias("new_text"), F.size("c.amounts").alias("n_amounts"),
    )


def groups(shown: DataFrame) -> DataFrame:
    """(pair_id, group_no, group_label, n): groups of changes in the order first seen, uncategorised ones last."""
    g = shown.groupBy("pair_id", "group_label").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    w = Window.partitionBy("pair_id").orderBy((F.col("group_label") == "Uncategorized").cast("int"), "first")
    return g.select("pair_id", F.row_number().over(w).alias("group_no"), "group_label", "n")
