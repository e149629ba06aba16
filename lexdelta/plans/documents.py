"""Queries of whole pipelines: XML to nodes, printed pages to hunks, published documents, reports, streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexdelta import api, contract, report
from lexdelta.operators import anchors as A
from lexdelta.operators import compare
from lexdelta.plans.registry import Registry
from lexdelta.plans.versions import DOCS_SQL, bill_docs, steps
from lexdelta.session import cut
from lexdelta.sources import print_lines as P
from lexdelta.sources import xml_bills
from lexdelta.sources.tables import table
from lexdelta.streaming import ingest

R = Registry()


def _escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def bill_xml(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): every version of every bill as XML, its titles and divisions as they first occur, bare sections first."""
    n = bill_docs(spark, d).where("tag like 'appropriations-%' or tag = 'section'")
    path = F.coalesce("display_path", F.array().cast("array<string>"))
    title = F.coalesce(F.get(F.filter(path, lambda x: x.rlike(r"^TITLE\s+[^\s—]+—")), F.lit(0)), F.lit(""))
    division = F.when((title != "") & F.col("division_label").rlike(r"^Division [A-Z]: "), F.col("division_label")).otherwise("")
    tag = lambda name, text: F.concat(F.lit(f"<{name}>"), _escape(text), F.lit(f"</{name}>"))
    number = F.when((F.col("tag") == "section") & (F.coalesce("section_number", F.lit("")) != ""), F.concat(F.lit("<enum>"), F.trim("section_number"), F.lit(".</enum>"))).otherwise("")
    element = F.concat(F.lit("<"), F.col("tag"), F.lit(' id="'), F.coalesce("element_id", F.lit("")), F.lit('">'), number, tag("header", F.coalesce("header_text", F.lit(""))), tag("text", F.coalesce("body_text", F.lit(""))), F.lit("</"), F.col("tag"), F.lit(">"))
    n = n.select("doc_id", "node_ord", title.alias("t"), division.alias("v"), element.alias("x")).where("t <> '' or x like '<section%'")
    part = lambda label, shape, i: F.regexp_extract(label, shape, i)
    shape, banner = r"^TITLE\s+([^\s—]+)—(.*)$", r"^Division ([A-Z]): (.*)$"
    head = lambda label, s: F.concat(F.lit("<enum>"), part(label, s, 1), F.lit("</enum>"), tag("header", part(label, s, 2)))
    inner = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node_ord", "x"))), lambda s: s["x"]), "")
    g = n.groupBy("doc_id", "t", "v").agg(F.min("node_ord").alias("first"), inner.alias("inner"))
    x = F.when(F.col("t") == "", F.col("inner")).otherwise(F.concat(F.lit("<title>"), head("t", shape), F.col("inner"), F.lit("</title>")))
    x = F.when(F.col("v") != "", F.concat(F.lit("<division>"), head("v", banner), x, F.lit("</division>"))).otherwise(x)
    docs = g.select("doc_id", F.struct(F.col("t") != "", F.col("v") != "", "first").alias("at"), x.alias("x")).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]), "").alias("x"))
    return docs.select(F.col("doc_id").alias("path"), F.concat(F.lit("<bill><legis-body>"), F.col("x"), F.lit("</legis-body></bill>")).alias("content"))


_MARK = r" (\((?:[0-9]{1,2}|[a-z]{1,4}|[A-Z])\))"
_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_ONE = lambda c: f"trim(regexp_replace({c}, '{_WS}', ' ', 'g'))"
_PLAIN = lambda c: f"regexp_replace({_ONE(c)}, '{_MARK}', '\\1', 'g')"
# what an account stands under: the last intermediate account of its title; one in brackets bears the name before it
_PARSED = "with " + DOCS_SQL + f""", n as (select doc_id, node_ord, tag, coalesce(element_id, '') element_id, coalesce(section_number, '') num, {_PLAIN("coalesce(body_text, '')")} body, trim({_PLAIN("coalesce(header_text, '')")}) hdr, coalesce(list_filter(display_path, lambda x: regexp_matches(x, '^TITLE\\s+[^\\s—]+—'))[1], '') t, coalesce(division_label, '') dl from docs where tag like 'appropriations-%' or tag = 'section'),
v as (select *, case when t <> '' and regexp_matches(dl, '^Division [A-Z]: ') then dl else '' end v, tag = 'appropriations-intermediate' mid, tag in ('appropriations-intermediate', 'appropriations-small') acc, regexp_matches(hdr, '^\\(.+\\)$') aside from n where t <> '' or tag = 'section'),
c as (select *, min(node_ord) over (partition by doc_id, t, v) g, last_value(case when mid then hdr end ignore nulls) over w middle, case when aside then last_value(case when acc and hdr <> '' and not aside then hdr end ignore nulls) over w else hdr end called from v window w as (partition by doc_id, t, v order by node_ord rows between unbounded preceding and current row)),
p as (select *, list_filter([regexp_replace(t, '^TITLE\\s+[^\\s—]+—', '')] || case when t = '' then [] when mid then [called] when acc then [middle] || case when called is distinct from middle then [called] else [] end else [middle] end || case when tag = 'section' and num <> '' then ['sec. ' || trim(num)] else [] end, lambda x: coalesce(x, '') <> '') path from c)
select doc_id, row_number() over (partition by doc_id order by t <> '', v <> '', g, node_ord) - 1 node_ord, array_to_string(list_transform(path, lambda x: {_ONE('lower(x)')}), ' > ') path_text, tag, element_id, body body_text, case when v = '' then '' else trim(regexp_extract(v, '^Division [A-Z]: ')) || ' ' || trim({_PLAIN("regexp_replace(v, '^Division [A-Z]: ', '')")}) end division_label from p where body <> ''"""


@R.add("parse_bill_xml", _PARSED)
def parse_bill_xml(spark: SparkSession, d: str) -> DataFrame:
    """XML made of the nodes of every version, parsed back: paths, texts and divisions of all of them."""
    n = xml_bills.parse_documents(bill_xml(spark, d)).where("error is null")
    return n.select("doc_id", F.col("node_ord").cast("bigint").alias("node_ord"), F.array_join("match_path", " > ").alias("path_text"), "tag", "element_id", "body_text", "division_label")


def hunk_pages(spark: SparkSession, d: str, side: str) -> DataFrame:
    """(doc_id, page, line_ord, line_number, text): a side of each archived hunk as one printed page, its lines numbered."""
    h = table(spark, d, "pdf_hunks").where(F.coalesce(f"{side}_text", F.lit("")) != "")
    head = F.when(F.col(f"{side}_anchor").isNotNull(), F.concat(F.col(f"{side}_anchor"), F.lit("\n"))).otherwise("")
    each = h.select(F.concat(F.lit(f"{side}-"), F.col("hunk_id").cast("string")).alias("doc_id"), F.lit(1).alias("page"), F.posexplode(F.split(F.concat(head, f"{side}_text"), "\n")).alias("line_ord", "text"))
    return each.select("doc_id", "page", "line_ord", (F.col("line_ord") % 25 + 1).alias("line_number"), "text")


def _printed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines = hunk_pages(spark, d, "v1").unionByName(hunk_pages(spark, d, "v2"))
    pairs = table(spark, d, "pdf_hunks").select(F.col("hunk_id").alias("pair_id"), *(F.concat(F.lit(f"{s}-"), F.col("hunk_id").cast("string")).alias(n) for s, n in (("v1", "old_doc"), ("v2", "new_doc"))))
    return lines, pairs


@R.add("print_hunks")
def print_hunks(spark: SparkSession, d: str) -> DataFrame:
    """Archived hunks' sides read as printed pages and compared block by block."""
    return api.printed_hunks(*_printed(spark, d)).select("pair_id", "hunk_no", "change_type", "v1_anchor", "v2_anchor", "v1_text", "v2_text")


_SIDE = "select '{0}-' || hunk_id doc_id, string_split(case when {0}_anchor is not null then {0}_anchor || chr(10) else '' end || {0}_text, chr(10)) t from pdf_hunks where coalesce({0}_text, '') <> ''"


@R.add("print_anchors", f"""with l as (select doc_id, generate_subscripts(t, 1) - 1 line_ord, unnest(t) as "text" from ({_SIDE.format('v1')} union all {_SIDE.format('v2')}))
select doc_id, line_ord % 25 + 1 line_number, case when regexp_matches("text", '^TITLE\\s+[IVXLC]+\\b') then 'title' else 'section' end kind, case when regexp_matches("text", '^TITLE\\s+[IVXLC]+\\b') then 'TITLE ' || regexp_extract("text", '^TITLE\\s+([IVXLC]+)\\b', 1) else regexp_replace(regexp_extract("text", '^(SEC(TION)?\\.?\\s+\\d+)\\b', 1), '\\s+', ' ', 'g') end as "text" from l where regexp_matches("text", '^TITLE\\s+[IVXLC]+\\b') or regexp_matches("text", '^SEC(TION)?\\.?\\s+\\d+\\b')""")
def print_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Title and section lines of both printed sides."""
    return A.title_section_anchors(_printed(spark, d)[0]).select("doc_id", "line_number", "kind", "text")


@R.add("print_breadcrumbs")
def print_breadcrumbs(spark: SparkSession, d: str) -> DataFrame:
    """Anchors with their paths, of both printed sides of each archived hunk."""
    lines, _ = _printed(spark, d)
    merged = P.page_lines(lines)
    flat = cut(P.flat_lines(merged), "flat")
    return A.breadcrumbs(A.extract_anchors(merged, flat)).select("doc_id", "anchor_no", "kind", F.array_join("path", " > ").alias("path_text"))


@R.add("change_groups", """with h as (select bill_id pair_id, row_number() over (partition by bill_id order by hunk_id) n, coalesce(v2_anchor, v1_anchor, 'Uncategorized') g from pdf_hunks), a as (select pair_id, g, count(*) n, min(n) f from h group by all)
select pair_id, cast(row_number() over (partition by pair_id order by g = 'Uncategorized', f) as int) group_no, g group_label, n from a""")
def change_groups(spark: SparkSession, d: str) -> DataFrame:
    return contract.groups(contract.views(_print_docs(spark, d)))


def archived(spark: SparkSession, d: str) -> DataFrame:
    """Archived hunks as the canonical producer takes them, numbered within their bill."""
    h = table(spark, d, "pdf_hunks").withColumnRenamed("bill_id", "pair_id")
    return h.withColumn("hunk_no", F.row_number().over(Window.partitionBy("pair_id").orderBy("hunk_id"))).withColumns({"v1_text": F.coalesce("v1_text", F.lit("")), "v2_text": F.coalesce("v2_text", F.lit(""))})


def _print_docs(spark: SparkSession, d: str) -> DataFrame:
    h = archived(spark, d)
    no = F.lit("")
    heads = h.select("pair_id").distinct().select("pair_id", no.alias("bill_type"), no.alias("number"), no.alias("congress"), no.alias("v1_label"), no.alias("v2_label"))
    return contract.documents(contract.print_changes(h), heads, "pdf")


@R.add("canonical_print", """with h as (select *, row_number() over (partition by bill_id order by hunk_id) n from pdf_hunks) select bill_id pair_id, printf('c-%04d', n) id, change_type, case when v1_anchor is null and v2_anchor is null and (v1_range is not null or v2_range is not null) then 'degraded' else 'resolved' end anchor_resolution,
 v1_range.start_page v1_page, case when v2_range.start_line >= 0 then v2_range.start_line end v2_line, case when v1_range is not null then v1_text end old_text, case when v2_range is not null then v2_text end new_text, cast(len(list_filter(coalesce(amount_pairs, []), lambda p: p.old is not null and p.new is not null and p.old <> p.new)) as int) n_amounts,
 case when change_type = 'moved' then case when coalesce(v1_anchor <> v2_anchor, false) then 'renumbered' else 'relocated' end end move_kind from h""")
def canonical_print(spark: SparkSession, d: str) -> DataFrame:
    """Published documents of archived hunks, written as JSON and read back."""
    c = contract.read_documents(_print_docs(spark, d)).select("pair_id", F.explode("doc.changes").alias("c"))
    return c.select("pair_id", "c.id", "c.change_type", "c.anchor_resolution", F.col("c.location.v1.start_page").alias("v1_page"), F.col("c.location.v2.start_line").alias("v2_line"), F.col("c.text.old").alias("old_text"), F.col("c.text.new").alias("new_text"), F.coalesce(F.size("c.amounts"), F.lit(0)).alias("n_amounts"), F.col("c.move.kind").alias("move_kind"))


@R.add("canonical_xml", """with c as (select *, row_number() over (partition by bill_id order by change_id) n from node_changes where change_type <> 'unchanged') select bill_id pair_id, printf('c-%04d', n) id, change_type, coalesce(section_number, '') section_number, coalesce(array_to_string(coalesce(display_path_new, display_path_old), ' > '), '') path_text, old_text, new_text, case when change_type = 'moved' then coalesce(old_text, '') = coalesce(new_text, '') end body_unchanged from c""")
def canonical_xml(spark: SparkSession, d: str) -> DataFrame:
    """Published documents of archived changes, written as JSON and read back."""
    c = compare.with_money(table(spark, d, "node_changes").drop("financial").withColumnsRenamed({"bill_id": "pair_id", "change_id": "change_no"}))
    no = F.lit("")
    heads = c.select("pair_id").distinct().select("pair_id", no.alias("bill_type"), no.alias("number"), no.alias("congress"), no.alias("v1_label"), no.alias("v2_label"))
    docs = contract.documents(contract.xml_changes(c), heads, "xml")
    x = contract.read_documents(docs).select("pair_id", F.explode("doc.changes").alias("c"))
    path = F.coalesce("c.path.v2", "c.path.v1", F.array().cast("array<string>"))
    return x.select("pair_id", "c.id", "c.change_type", "c.section_number", F.array_join(path, " > ").alias("path_text"), F.col("c.text.old").alias("old_text"), F.col("c.text.new").alias("new_text"), F.col("c.move.body_unchanged").alias("body_unchanged"))


_LINE = "case when {0}.{1}_line >= 0 then ' L' || {0}.{1}_line else '' end"
_SPOT = "('p.' || {0}.{1}_page || " + _LINE + ")"
_RANGE = lambda r: f"case when {r} is null then '—' when {_SPOT.format(r, 'start')} = {_SPOT.format(r, 'end')} then {_SPOT.format(r, 'start')} else {_SPOT.format(r, 'start')} || ' – ' || {_SPOT.format(r, 'end')} end"


@R.add("change_views", f"""with h as (select *, row_number() over (partition by bill_id order by hunk_id) n, coalesce(v2_anchor, v1_anchor) a, {_RANGE('v1_range')} r1, {_RANGE('v2_range')} r2, v1_range is not null one, v2_range is not null two from pdf_hunks)
select bill_id pair_id, printf('c-%04d', n) id, change_type, coalesce(a, 'Uncategorized') group_label, case when a is null and (one or two) then '(uncategorized) — ' || case when two then r2 else r1 end when coalesce(a, '') <> '' then a else '(unknown)' end heading, r1 || ' | ' || r2 place,
 case when change_type <> 'moved' then null when v1_anchor <> v2_anchor then 'Renumbered: ' || v1_anchor || ' → ' || v2_anchor || case when coalesce(v1_text, '') = coalesce(v2_text, '') then ' · body text unchanged' else '' end else 'Moved: ' || coalesce(v1_anchor, r1) || ' → ' || coalesce(v2_anchor, r2) end move_note,
 case when one then coalesce(v1_text, '') end old_text, case when two then coalesce(v2_text, '') end new_text, cast(case when amount_pairs is null then -1 else len(list_filter(amount_pairs, lambda p: p.old is not null and p.new is not null and p.old <> p.new)) end as int) n_amounts from h""")
def change_views(spark: SparkSession, d: str) -> DataFrame:
    return contract.views(_print_docs(spark, d)).drop("at")


@R.add("html_reports", """select bill_id pair_id, count(*) n_cards, count(distinct coalesce(v2_anchor, v1_anchor, 'Uncategorized')) n_groups, coalesce(sum(len(list_filter(coalesce(amount_pairs, []), lambda p: p.old is not null and p.new is not null and p.old <> p.new))), 0) n_money, count(*) filter (coalesce(change_type, '') <> 'modified') n_structural from pdf_hunks group by 1""")
def html_reports(spark: SparkSession, d: str) -> DataFrame:
    """What each bill's self-contained report holds: cards, groups, rows of the money table, cards of the structural view."""
    html = F.regexp_replace("html", r"(?s)<script.*\z", "")
    hits = lambda p: F.regexp_count(html, F.lit(p)).cast("bigint")
    return report.reports(_print_docs(spark, d)).select("pair_id", hits("<article ").alias("n_cards"), hits('<section class="group"').alias("n_groups"), hits("<tr><td><a ").alias("n_money"), hits('<article id="[^"]*" data-type="(?!modified")').alias("n_structural"))


@R.add("xml_documents")
def xml_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each two neighbouring versions of every bill as published documents, with full texts, trees and places of changes."""
    doc = lambda v: F.concat_ws(":", "bill_id", v)
    n = bill_docs(spark, d).withColumns({"bill_type": F.split("bill_id", "-")[1], "bill_number": F.split("bill_id", "-")[2].cast("int"), "congress": F.split("bill_id", "-")[0].cast("int"), "version_label": F.col("version").cast("string"), "error": F.lit(None).cast("string")})
    pairs = steps(spark, d).select("pair_id", doc("old").alias("old_doc"), doc("new").alias("new_doc"))
    docs = api.xml_documents(n.drop("bill_id", "version"), pairs)
    return docs.select("pair_id", "canonical")


@R.add("stream_windows", "select time_bucket(interval '1 hour', ts) window_start, event_type, count(*) n, sum(cast(round(\"value\" * 100) as bigint)) cents from events group by all")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts of the events, run as a stream over the delivered files."""
    out = ingest.complete_counts(ingest.read_stream(spark, d, "events"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "cents")


@R.add("stream_latest", "select bill_id, version_no, version_label, delivered_at from (select *, row_number() over (partition by bill_id order by version_no desc, delivered_at desc, version_label desc) k from bill_versions where version_no is not null) where k = 1")
def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    """The newest version of each bill, kept up as deliveries arrive."""
    return ingest.latest_versions(ingest.read_stream(spark, d, "bill_versions"))

