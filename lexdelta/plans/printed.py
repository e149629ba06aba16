"""Queries of the printed pipeline: pages to lines, glyphs to lines, lines to headings, headings to blocks.

Bills are printed from their nodes (``PRINT_SQL``, ``printed_bills``) and read back, so what must come out is known from
the nodes themselves; printed extracts among the documents are given a text layer's marks and read back likewise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexdelta.functions import text as T
from lexdelta.operators import anchors as A
from lexdelta.operators import blocks as B
from lexdelta.operators import spans
from lexdelta.plans.registry import Registry
from lexdelta.plans.relational import WS, amounts_sql, norm_sql
from lexdelta.plans.versions import DOCS_SQL, bill_docs
from lexdelta.session import cut
from lexdelta.sources import print_lines as P
from lexdelta.sources.tables import table

R = Registry()
HEAD_SIZE, BODY_SIZE, LINES = 10.0, 14.0, 25

# --- pages and glyphs -----------------------------------------------------------------------------

_EXTRACT = "select doc_id, generate_subscripts(l, 1) - 1 line_ord, unnest(l) raw from (select doc_id, string_split(\"text\", chr(10)) l from documents where source = 'pdf_extract' and \"text\" is not null)"


def raw_pages(spark: SparkSession, d: str) -> DataFrame:
    """Printed extracts as a text layer gives them: a page number, CRLF, soft hyphens at line ends, a running head, a footer."""
    t = F.regexp_replace("text", r"(\p{L})-\n(\d{1,2} )", f"$1{P.SOFT}$2")
    page = F.concat(F.lit("7\n"), t, F.lit("\n•HR 12 RH\nVerDate Sep 11 2014 Jkt 000000\nPO 00000 Frm 00007"))
    docs = table(spark, d, "documents").where("source = 'pdf_extract' and text is not null")
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("page"), F.replace(page, F.lit("\n"), F.lit("\r\n")).alias("text"))


@R.add("printed_lines", f"with l as ({_EXTRACT}) select doc_id, line_ord, try_cast(nullif(regexp_extract(raw, '^(\\d{{1,2}}) (.*)$', 1), '') as int) line_number, regexp_replace(case when regexp_matches(raw, '^\\d{{1,2}} ') then regexp_extract(raw, '^(\\d{{1,2}}) (.*)$', 2) else raw end, '[\\t \\x{{b}}\\x{{c}}]+$', '') as \"text\" from l")
def printed_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of raw pages without their chrome, with their margin numbers."""
    l = P.print_lines(raw_pages(spark, d))
    return l.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("line_ord").cast("bigint").alias("line_ord"), "line_number", "text")


@R.add("rejoined_texts", "select hunk_id, regexp_replace(v1_text, '([\\p{L}\\p{N}_])-\\n([a-z])', '\\1\\2', 'g') v1_text, regexp_replace(v2_text, '([\\p{L}\\p{N}_])-\\n([a-z])', '\\1\\2', 'g') v2_text from pdf_hunks")
def rejoined_texts(spark: SparkSession, d: str) -> DataFrame:
    """Words broken at line ends joined inside whole texts."""
    return table(spark, d, "pdf_hunks").select("hunk_id", *(P.rejoin_soft_hyphens(F.col(c)).alias(c) for c in ("v1_text", "v2_text")))


def glyphs(spark: SparkSession, d: str) -> DataFrame:
    """Printed extracts glyph by glyph, blanks left as gaps; the sizes of lines differ."""
    l = table(spark, d, "documents").where("source = 'pdf_extract' and text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("n", "raw"))
    c = l.select("doc_id", "n", F.posexplode(F.split("raw", "")).alias("i", "ch")).where(~F.col("ch").rlike(r"^\p{Z}?$") & (F.col("ch") >= " "))
    size = F.lit(10.0) + F.col("n") % 3
    return c.select("doc_id", F.lit(1).alias("page"), (F.lit(100000.0) - 20 * F.col("n")).alias("bottom"), (6.0 * F.col("i")).alias("left"), (6.0 * F.col("i") + 5).alias("right"), F.expr("int(conv(hex(encode(ch, 'UTF-32')), 16, 10))").alias("cp"), size.alias("size"))


_GLYPHS = f"with l as ({_EXTRACT}), g as (select doc_id, line_ord, trim(regexp_replace(regexp_replace(raw, '\\p{{Z}}', ' ', 'g'), '[\\x00-\\x1f ]+', ' ', 'g')) t, 10.0 + line_ord % 3 size from l)"


@R.add("glyph_lines", _GLYPHS + " select doc_id, row_number() over (partition by doc_id order by line_ord) - 1 line_ord, t as \"text\", cast(size as double) glyph_size from g where t <> ''")
def glyph_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines put together again from glyphs, top line first."""
    l = P.glyph_lines(glyphs(spark, d))
    return l.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("line_ord").cast("bigint").alias("line_ord"), "text", "glyph_size")


@R.add("margin_sizes", _GLYPHS + ", m as (select doc_id, try_cast(nullif(regexp_extract(t, '^(\\d{1,2}) ', 1), '') as int) line_number, size from g) select doc_id, line_number, cast(max(size) as double) glyph_size from m where line_number is not null group by all having count(*) = 1")
def margin_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Glyph sizes by margin number; numbers met twice on a page tell nothing."""
    return P.margin_sizes(glyphs(spark, d)).select(F.col("doc_id").cast("bigint").alias("doc_id"), "line_number", "glyph_size")


@R.add("print_spans", f"""with l as ({_EXTRACT}), n as (select doc_id, line_ord, try_cast(nullif(regexp_extract(raw, '^(\\d{{1,2}}) (.*)$', 1), '') as int) line_number, regexp_replace(case when regexp_matches(raw, '^\\d{{1,2}} ') then regexp_extract(raw, '^(\\d{{1,2}}) (.*)$', 2) else raw end, '[\\t \\x{{b}}\\x{{c}}]+$', '') t from l),
s as (select *, coalesce(sum(length(t) + 8) over (partition by doc_id order by line_ord rows between unbounded preceding and 1 preceding), 0) a from n), k as (select doc_id, line_number, arg_max(a, line_ord) a, arg_max(a + length(t) + 7, line_ord) z from s where line_number is not null group by all),
r as (select doc_id, unnest([1, 3, 20]) start_line, unnest([4, 3, 90]) end_line from (select distinct doc_id from l))
select r.doc_id, start_line, end_line, cast(case when x.a is not null and y.z is not null then x.a end as bigint) start_char, cast(case when x.a is not null and y.z is not null then y.z end as bigint) end_char from r left join k x on x.doc_id = r.doc_id and x.line_number = start_line left join k y on y.doc_id = r.doc_id and y.line_number = end_line""")
def print_spans(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of printed lines placed in the full text of their document; ranges whose lines are not there have no place."""
    shown = P.rendered(P.print_lines(raw_pages(spark, d)))
    one = lambda a, z: F.struct(F.lit(1).alias("start_page"), F.lit(a).alias("start_line"), F.lit(1).alias("end_page"), F.lit(z).alias("end_line"))
    ranges = shown.select("doc_id").distinct().select("doc_id", F.inline(F.array(one(1, 4), one(3, 3), one(20, 90))))
    out = spans.range_spans(ranges, shown)
    return out.select(F.col("doc_id").cast("bigint").alias("doc_id"), "start_line", "end_line", F.col("start_char").cast("bigint").alias("start_char"), F.col("end_char").cast("bigint").alias("end_char"))


# --- bills as printed -----------------------------------------------------------------------------

PRINT_SQL = "with " + DOCS_SQL + f""", n as (select doc_id, node_ord, tag, coalesce(display_path, []) path, {norm_sql("coalesce(body_text, '')")} body, case when tag = 'section' then regexp_extract(coalesce(section_number, ''), '^\\d+') else '' end num,
 coalesce(list_filter(display_path, lambda x: regexp_matches(x, '^TITLE [IVXLC]+—'))[1], '') t, case when regexp_matches(coalesce(division_label, ''), '^Division [A-Z]: ') then division_label else '' end v from docs where tag = 'section' or tag like 'appropriations-%'),
m as (select *, coalesce(lag(t) over w, '') pt, coalesce(lag(v) over w, '') pv, case when tag <> 'section' then len(list_filter(path, lambda x: not regexp_matches(x, '^(TITLE|Division) '))) else 0 end depth from n where body <> '' window w as (partition by doc_id order by node_ord)),
b as (select *, t <> '' and (t <> pt or v <> pv) opens from m),
l as (select doc_id, node_ord, 1 j, upper(regexp_replace(v, '^(Division [A-Z]): ', '\\1—')) "text", 14.0 size, 'banner' kind, v, t from b where opens and v <> '' and v <> pv
 union all select doc_id, node_ord, 2, regexp_extract(t, '^TITLE [IVXLC]+'), 14.0, 'title', v, t from b where opens union all select doc_id, node_ord, 3, upper(regexp_replace(t, '^TITLE [IVXLC]+—', '')), 14.0, 'major', v, t from b where opens
 union all select doc_id, node_ord, 4, upper(path[len(path) - 1]), 10.0, 'agency', v, t from b where depth > 1 union all select doc_id, node_ord, 5, upper(path[len(path)]), 10.0, 'account', v, t from b where depth > 0
 union all select doc_id, node_ord, 6, 'SEC. ' || num || '.', 14.0, 'section', v, t from b where num <> '' union all select doc_id, node_ord, 7, body, 14.0, 'body', v, t from b),
f as (select *, row_number() over (partition by doc_id order by node_ord, j) - 1 ix, max(size = 10.0) over (partition by doc_id) sized from l)
"""


def printed_bills(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, page, line_ord, line_number, text, glyph_size): every version of every bill printed, headings above their text, 25 lines a page."""
    path = F.coalesce("display_path", F.array().cast("array<string>"))
    n = bill_docs(spark, d).where("tag = 'section' or tag like 'appropriations-%'").select(
        "doc_id", "node_ord", "tag", path.alias("path"), T.collapse(F.coalesce("body_text", F.lit(""))).alias("body"), F.when(F.col("tag") == "section", F.regexp_extract(F.coalesce("section_number", F.lit("")), r"^\d+", 0)).otherwise("").alias("num"),
        F.coalesce(F.get(F.filter(path, lambda x: x.rlike("^TITLE [IVXLC]+—")), F.lit(0)), F.lit("")).alias("t"), F.when(F.col("division_label").rlike("^Division [A-Z]: "), F.col("division_label")).otherwise("").alias("v"),
    ).where("body <> ''")
    w = Window.partitionBy("doc_id").orderBy("node_ord")
    n = n.withColumns({"pt": F.coalesce(F.lag("t").over(w), F.lit("")), "pv": F.coalesce(F.lag("v").over(w), F.lit(""))})
    opens = (F.col("t") != "") & ((F.col("t") != F.col("pt")) | (F.col("v") != F.col("pv")))
    depth = F.when(F.col("tag") != "section", F.size(F.filter("path", lambda x: ~x.rlike("^(TITLE|Division) ")))).otherwise(0)

    def line(when: Column, text: Column, size: float) -> Column:
        return F.when(when, F.struct(text.alias("text"), F.lit(size).alias("glyph_size")))

    made = F.array(
        line(opens & (F.col("v") != "") & (F.col("v") != F.col("pv")), F.upper(F.regexp_replace("v", "^(Division [A-Z]): ", "$1—")), BODY_SIZE), line(opens, F.regexp_extract("t", "^TITLE [IVXLC]+", 0), BODY_SIZE), line(opens, F.upper(F.regexp_replace("t", "^TITLE [IVXLC]+—", "")), BODY_SIZE),
        line(depth > 1, F.upper(F.try_element_at("path", F.lit(-2))), HEAD_SIZE), line(depth > 0, F.upper(F.try_element_at("path", F.lit(-1))), HEAD_SIZE), line(F.col("num") != "", F.concat(F.lit("SEC. "), "num", F.lit(".")), BODY_SIZE), line(F.lit(True), F.col("body"), BODY_SIZE),
    )
    each = n.select("doc_id", "node_ord", F.posexplode(F.filter(made, lambda x: x.isNotNull())).alias("j", "l"))
    each = each.withColumn("ix", F.row_number().over(Window.partitionBy("doc_id").orderBy("node_ord", "j")) - 1)
    return each.select("doc_id", (F.floor(F.col("ix") / LINES) + 1).cast("int").alias("page"), (F.col("ix") % LINES).alias("line_ord"), (F.col("ix") % LINES + 1).alias("line_number"), "l.text", "l.glyph_size")


def _flat(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    merged = cut(P.page_lines(printed_bills(spark, d)), "printed")
    return merged, cut(P.flat_lines(merged), "flat")


_ANCHORS = PRINT_SQL + """, a0 as (select doc_id, ix, cast(ix // 25 + 1 as int) page, cast(ix % 25 + 1 as int) line_number, kind, case kind when 'section' then replace("text", '.', '') else "text" end "text" from f where kind in ('title', 'section') or (kind in ('major', 'agency', 'account') and sized)),
a1 as (select * replace (case kind when 'section' then 'SEC. ' || regexp_extract("text", '\\d+') else "text" end as "text") from a0),
bn as (select doc_id, regexp_extract("text", '^DIVISION ([A-Z])', 1) letter, max(ix) ix, arg_max("text", ix) t from f where kind = 'banner' group by all), bl as (select doc_id, ix, 'Division ' || letter || ': ' || regexp_replace(t, '^[^—]*—', '') "label" from bn),
a as (select a1.*, coalesce("label", '') division, cast(row_number() over (partition by a1.doc_id order by a1.ix) as int) anchor_no from a1 asof left join bl on a1.doc_id = bl.doc_id and a1.ix >= bl.ix)
"""


def _anchors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    merged, flat = _flat(spark, d)
    return A.extract_anchors(merged, flat), flat


@R.add("bill_lines", PRINT_SQL + "select doc_id, ix flat_ix, \"text\", cast(size as double) glyph_size from f")
def bill_lines(spark: SparkSession, d: str) -> DataFrame:
    """Printed bills as one stream of lines a document."""
    return _flat(spark, d)[1].select("doc_id", F.col("flat_ix").cast("bigint").alias("flat_ix"), "text", "glyph_size")


@R.add("size_bands", PRINT_SQL + "select doc_id, 14.0::double body, 10.0::double heading_lo, 10.0::double heading_hi from f where sized group by doc_id")
def size_bands(spark: SparkSession, d: str) -> DataFrame:
    """Body and heading sizes of printed bills; bills without accounts have no headings of their own size."""
    return A.size_bands(printed_bills(spark, d))


@R.add("bill_anchors", _ANCHORS + 'select doc_id, anchor_no, page, line_number, kind, "text", division from a')
def bill_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Divisions, titles, departments, agencies, accounts and sections found in printed bills by size and order."""
    return _anchors(spark, d)[0]


@R.add("banner_labels", _ANCHORS + 'select doc_id, ix flat_ix, "label" from bl')
def banner_labels(spark: SparkSession, d: str) -> DataFrame:
    """Division banners with their names; of a letter met twice the last one."""
    return A.divisions(_flat(spark, d)[1]).select("doc_id", F.col("flat_ix").cast("bigint").alias("flat_ix"), "label")


_CRUMBS = _ANCHORS.rstrip() + """, tg as (select *, count(*) filter (kind = 'title') over (partition by doc_id order by anchor_no) tg from a),
up as (select *, last_value(case when kind = 'title' then "text" end ignore nulls) over w title, last_value(case when kind = 'major' then "text" end ignore nulls) over w major, last_value(case when kind = 'grouping' then "text" end ignore nulls) over w grp,
 last_value(case when kind in ('agency', 'grouping', 'section') then {'k': kind, 't': "text"} end ignore nulls) over w ag from tg window w as (partition by doc_id, tg order by anchor_no rows between unbounded preceding and 1 preceding))
"""


@R.add("bill_breadcrumbs", _CRUMBS + """select doc_id, anchor_no, array_to_string(list_filter(case when kind = 'title' then [division, "text"] else [division, title, major, case when kind = 'account' and ag.k = 'agency' then ag.t end, case when kind = 'section' then grp end, "text"] end, lambda x: coalesce(x, '') <> ''), ' > ') path_text from up""")
def bill_breadcrumbs(spark: SparkSession, d: str) -> DataFrame:
    """Where each heading of a printed bill stands."""
    return A.breadcrumbs(_anchors(spark, d)[0]).select("doc_id", "anchor_no", F.array_join("path", " > ").alias("path_text"))


@R.add("bill_blocks", _ANCHORS.rstrip() + f""", r as (select f.doc_id, f.ix, f."text", coalesce(a.anchor_no, 0) block_no, a.kind ak, a."text" atext, f.ix = a.ix at_anchor from f asof left join a on f.doc_id = a.doc_id and f.ix >= a.ix),
c as (select *, block_no > 0 and ((at_anchor and ak = 'title') or (regexp_matches("text", '\\p{{L}}') and not regexp_matches("text", '\\p{{Ll}}') and not regexp_matches("text", '^TITLE\\s+[IVXLC]+\\b') and not regexp_matches("text", '^SEC(TION)?\\.?\\s+\\d+') and len({amounts_sql('"text"')}) = 0)) chrome, max(block_no) over (partition by doc_id) last_no from r),
e as (select *, min(case when not chrome then ix end) over w lo, max(case when not chrome then ix end) over w hi from c window w as (partition by doc_id, block_no))
select doc_id, block_no, case when block_no = 0 and last_no > 0 then 'preamble' else any_value(ak) end kind, case when block_no = 0 and last_no > 0 then 'Front Matter' else any_value(atext) end anchor, cast(min(ix) // 25 + 1 as int) start_page, cast(min(ix) % 25 + 1 as int) start_line, cast(max(ix) // 25 + 1 as int) end_page, cast(max(ix) % 25 + 1 as int) end_line,
 string_agg("text", chr(10) order by ix) as "text" from e where lo is null or ix between lo and hi group by doc_id, block_no, last_no""")
def bill_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Printed bills cut into blocks below their headings, heading lines at a block's ends trimmed."""
    found, flat = _anchors(spark, d)
    b = B.blocks(flat, cut(found, "anchors"))
    return b.select("doc_id", "block_no", F.col("anchor.kind").alias("kind"), F.col("anchor.text").alias("anchor"), "start_page", "start_line", "end_page", "end_line", "text")


@R.add("anchor_blocks", _ANCHORS.rstrip() + """, s as (select doc_id, ix, length("text") n, coalesce(sum(length("text") + 8 + case when ix % 25 = 24 then 1 else 0 end) over (partition by doc_id order by ix rows between unbounded preceding and 1 preceding), 0) pos from f), z as (select doc_id, max(pos + 7 + n) z from s group by 1),
p as (select a.doc_id, anchor_no, s.pos from a join s using (doc_id, ix)) select doc_id, anchor_no, cast(pos as bigint) block_start, cast(coalesce(lead(pos) over (partition by doc_id order by anchor_no), z) as bigint) block_end from p join z using (doc_id)""")
def anchor_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The part of the full text that is a heading's own: up to the next heading."""
    merged, flat = _flat(spark, d)
    shown = P.rendered(merged)
    at = shown.groupBy("doc_id", "page", "line_number").agg(F.min("start_char").alias("start_char"))
    size = shown.groupBy("doc_id").agg(F.max("end_char").alias("size"))
    a = A.extract_anchors(merged, flat).join(at, ["doc_id", "page", "line_number"], "left").join(size, "doc_id")
    return spans.own_blocks(a, F.col("size")).select("doc_id", "anchor_no", F.col("block_start").cast("bigint").alias("block_start"), F.col("block_end").cast("bigint").alias("block_end"))


_WIDE = ["doc_id", "content_left", "content_right", "text"]


@R.add("column_widths", PRINT_SQL + "select doc_id, round(median(cast(36.0 + 6 * length(\"text\") as double)) - median(cast(36.0 + ix % 3 as double)), 6) width from f where regexp_matches(\"text\", '[a-z]') group by 1")
def column_widths(spark: SparkSession, d: str) -> DataFrame:
    """Width of the text column: median right less median left edge of prose lines."""
    l = _flat(spark, d)[1].withColumns({"content_left": F.lit(36.0) + F.col("flat_ix") % 3, "content_right": F.lit(36.0) + 6 * F.length("text")})
    return A.column_width(l.select(*_WIDE)).select("doc_id", F.round("width", 6).alias("width"))


# --- display strings ------------------------------------------------------------------------------


@R.add("block_keys", "select hunk_id, " + ", ".join(f"coalesce({s}_anchor, '(preamble)') || '::' || regexp_replace(substring(coalesce({s}_text, ''), 1, 80), '^{WS}|{WS}$', '', 'g') {s}_key" for s in ("v1", "v2")) + " from pdf_hunks")
def block_keys(spark: SparkSession, d: str) -> DataFrame:
    """The keys by which printed blocks are aligned."""
    return table(spark, d, "pdf_hunks").select("hunk_id", *(B.block_key(F.col(f"{s}_anchor"), F.coalesce(f"{s}_text", F.lit(""))).alias(f"{s}_key") for s in ("v1", "v2")))


_PLACE = "case when {0} is null then '—' when {1} = {2} then {1} else {1} || ' – ' || {2} end"
_END = "('p.' || {0}.{1}_page || case when {0}.{1}_line is null then '' else ' L' || {0}.{1}_line end)"


@R.add("place_strings", f"select hunk_id, {_PLACE.format('v1_range', _END.format('v1_range', 'start'), _END.format('v1_range', 'end'))} v1_place, {_PLACE.format('v2_range', _END.format('v2_range', 'start'), _END.format('v2_range', 'end'))} v2_place from pdf_hunks")
def place_strings(spark: SparkSession, d: str) -> DataFrame:
    """Printed ranges as readers see them."""
    from lexdelta import contract

    return table(spark, d, "pdf_hunks").select("hunk_id", *(contract.range_text(F.col(f"{s}_range")).alias(f"{s}_place") for s in ("v1", "v2")))


@R.add("breadcrumb_strings", "select node_id, array_to_string(display_path, ' › ') crumb from bill_nodes")
def breadcrumb_strings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bill_nodes").select("node_id", T.breadcrumb(F.col("display_path")).alias("crumb"))


@R.add("printed_covers", """with v as (select version_id, case lower(bill_type) when 'hr' then 'H. R.' when 's' then 'S.' when 'hjres' then 'H. J. RES.' when 'sjres' then 'S. J. RES.' end k, congress, bill_number, trim(regexp_replace(coalesce(official_title, ''), '\\s+', ' ', 'g')) t from bill_versions),
x as (select *, case when t = '' then '' else regexp_extract('To act on ' || t || ' for purposes.', '(?i)^(.+?\\bpurposes\\.)', 1) end y from v)
select version_id, cast(congress as varchar) congress, case when k is not null then replace(k, ' ', '') || ' ' || bill_number else '' end || case when y = '' then '' else case when k is not null then ' — ' else '' end || case when length(y) > 140 then rtrim(substring(y, 1, 137)) || '…' else y end end title from x""")
def printed_covers(spark: SparkSession, d: str) -> DataFrame:
    """Congress and title read from the cover of a printed bill, made here from the version's header."""
    v = table(spark, d, "bill_versions").withColumn("t", F.trim(F.regexp_replace(F.coalesce("official_title", F.lit("")), r"\s+", " ")))
    kind = F.create_map(*[F.lit(x) for kv in {"hr": "H. R.", "s": "S.", "hjres": "H. J. RES.", "sjres": "S. J. RES."}.items() for x in kv])[F.lower("bill_type")]
    number = F.coalesce(F.concat(kind, F.lit(" "), F.col("bill_number").cast("string")), F.lit(""))
    body = F.when(F.col("t") == "", F.lit("")).otherwise(F.concat(F.lit("To act on "), "t", F.lit(" for\npurposes.")))
    cover = F.concat(F.col("congress").cast("string"), F.lit("TH CONGRESS\n1ST SESSION\n"), number, F.lit("\nIN THE HOUSE\nA BILL\n"), body, F.lit("\n"))
    return v.select("version_id", T.printed_congress(cover).alias("congress"), T.printed_title(cover).alias("title"))
