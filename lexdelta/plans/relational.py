"""Queries of the single operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexdelta.functions import text as T
from lexdelta.functions import udfs
from lexdelta.operators import anchors as A
from lexdelta.operators import catalog, compare, spans, validation
from lexdelta.plans.registry import Registry
from lexdelta.plans.versions import LAST_SQL, SIDES_SQL, latest_nodes, sides
from lexdelta.sources import index as I
from lexdelta.sources import print_lines as P
from lexdelta.sources import reports as reports_
from lexdelta.sources.tables import table

R = Registry()
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
AMOUNT, NOTE = T.AMOUNT, T.ANNOTATION  # fixed values


def norm_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}', ' ', 'g'))"


def words_sql(c: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({c}, ''), '{WS}'), lambda w: w <> '')"


def amounts_sql(c: str) -> str:
    return f"list_transform(regexp_extract_all(regexp_replace(coalesce({c}, ''), '{NOTE}', '', 'g'), '{AMOUNT}'), lambda x: cast(regexp_replace(x, '[$,]', '', 'g') as bigint))"


def lines_of(df: DataFrame, key: str, c: str) -> DataFrame:
    """(key, line_ord, text): the lines of a text."""
    return df.where(F.col(c).isNotNull()).select(key, F.posexplode(F.split(c, "\n")).alias("line_ord", "text"))


def side_lines(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, line_ord, text): the lines of both sides of each archived hunk, ``v1-<id>`` and ``v2-<id>``."""
    h = table(spark, d, "pdf_hunks")
    one = lambda v: lines_of(h.withColumn("doc_id", F.concat(F.lit(f"{v}-"), F.col("hunk_id").cast("string"))), "doc_id", f"{v}_text")
    return one("v1").unionByName(one("v2"))


SIDE_LINES = "(select doc_id, generate_subscripts(l, 1) - 1 line_ord, unnest(l) as \"text\" from (select 'v1-' || hunk_id doc_id, string_split(v1_text, chr(10)) l from pdf_hunks where v1_text is not null union all select 'v2-' || hunk_id, string_split(v2_text, chr(10)) from pdf_hunks where v2_text is not null))"


def lines_sql(t: str, key: str, c: str) -> str:
    return f"(select {key}, generate_subscripts(l, 1) - 1 line_ord, unnest(l) as \"text\" from (select {key}, string_split({c}, chr(10)) l from {t} where {c} is not null))"


# --- scalar text --------------------------------------------------------------------------------


@R.add("normalize_text", f"select change_id, {norm_sql('old_text')} old_norm, {norm_sql('new_text')} new_norm from node_changes")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "node_changes").select("change_id", T.collapse("old_text").alias("old_norm"), T.collapse("new_text").alias("new_norm"))


@R.add("header_norm", f"select node_id, lower({norm_sql('header_text')}) header, case when contains(coalesce(division_label, ''), ':') then lower({norm_sql('regexp_replace(division_label, $$(?s)^[^:]*:$$, $$$$)')}) else '' end division from bill_nodes")
def header_norm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bill_nodes").select("node_id", T.header_norm("header_text").alias("header"), T.division_title("division_label").alias("division"))


@R.add("extract_amounts", " union all ".join(f"select change_id, '{c}' side, generate_subscripts(a, 1) - 1 as \"at\", unnest(a) amount from (select change_id, {amounts_sql(c)} a from node_changes)" for c in ("old_text", "new_text")))
def extract_amounts(spark: SparkSession, d: str) -> DataFrame:
    one = lambda c: table(spark, d, "node_changes").select("change_id", F.lit(c).alias("side"), F.posexplode(T.amounts(c)).alias("at", "amount"))
    return one("old_text").unionByName(one("new_text"))


@R.add("amount_flags", f"select change_id, list_sort({amounts_sql('old_text')}) <> list_sort({amounts_sql('new_text')}) amounts_changed, coalesce(regexp_matches(old_text, '{NOTE}'), false) or coalesce(regexp_matches(new_text, '{NOTE}'), false) annotated from node_changes")
def amount_flags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "node_changes").select("change_id", compare.amounts_changed(F.col("old_text"), F.col("new_text")).alias("amounts_changed"), (T.has_annotation("old_text") | T.has_annotation("new_text")).alias("annotated"))


@R.add("word_amounts", " union all ".join(f"select change_id, '{c}' side, cast(i as int) word_no, cast(regexp_replace(regexp_extract(w, '{AMOUNT}'), '[$,]', '', 'g') as bigint) amount from (select change_id, generate_subscripts(ws, 1) - 1 i, unnest(ws) w from (select change_id, {words_sql(f"regexp_replace({c}, '{NOTE}', '', 'g')")} ws from node_changes)) where regexp_matches(w, '{AMOUNT}')" for c in ("old_text", "new_text")))
def word_amounts(spark: SparkSession, d: str) -> DataFrame:
    """The first amount of each word, with the word's place."""
    one = lambda c: table(spark, d, "node_changes").select("change_id", F.lit(c).alias("side"), F.inline(T.word_amounts(c)))
    return one("old_text").unionByName(one("new_text"))


@R.add("unified_diff", f"""select change_id, case when o = n then '' else '--- old' || chr(10) || '+++ new' || chr(10) || '@@ -' || case when o = '' then '0,0' else '1' end || ' +' || case when n = '' then '0,0' else '1' end || ' @@' || case when o = '' then '' else chr(10) || '-' || o end || case when n = '' then '' else chr(10) || '+' || n end end diff
from (select change_id, {norm_sql("coalesce(old_text, '')")} o, {norm_sql("coalesce(new_text, '')")} n from node_changes)""")
def unified_diff(spark: SparkSession, d: str) -> DataFrame:
    o, n = (T.collapse(F.coalesce(c, F.lit(""))) for c in ("old_text", "new_text"))
    return table(spark, d, "node_changes").select("change_id", F.array_join(T.unified_diff(o, n), "\n").alias("diff"))


@R.add("money_format", """select hunk_id, i pair_no, case when o < 0 then '-$' else '$' end || format('{:,}', abs(o)) old_money, case when n - o > 0 then '+' else '' end || case when n - o < 0 then '-$' else '$' end || format('{:,}', abs(n - o)) delta,
 case when o = 0 then '—' else case when round((n - o) * 100.0 / o, 1) > 0 then '+' else '' end || printf('%.1f', round((n - o) * 100.0 / o, 1)) || '%' end percent
from (select hunk_id, generate_subscripts(amount_pairs, 1) - 1 i, unnest(amount_pairs).old o, unnest(amount_pairs).new n from pdf_hunks) where o is not null and n is not null and o <> n""")
def money_format(spark: SparkSession, d: str) -> DataFrame:
    """Real amount pairs of printed hunks as shown: old amount, difference, per cent."""
    p = table(spark, d, "pdf_hunks").select("hunk_id", F.posexplode("amount_pairs").alias("pair_no", "p"))
    o, n = F.col("p.old"), F.col("p.new")
    return p.where(o.isNotNull() & n.isNotNull() & (o != n)).select("hunk_id", "pair_no", T.money(o).alias("old_money"), T.delta(o, n).alias("delta"), T.delta_percent(o, n).alias("percent"))


@R.add("bill_labels", """select version_id, congress || '-' || lower(bill_type) || '-' || bill_number || ':' || version_label bill_key, trim(case bill_type when 'hr' then 'H.R.' when 's' then 'S.' when 'hjres' then 'H.J.Res.' when 'sjres' then 'S.J.Res.' when 'hconres' then 'H.Con.Res.' when 'sconres' then 'S.Con.Res.' when 'hres' then 'H.Res.' when 'sres' then 'S.Res.' else upper(bill_type) end || ' ' || bill_number) || case when coalesce(official_title, '') <> '' then ' — ' || official_title else '' end title,
 trim(regexp_replace(lower(version_label), '[^a-z0-9]+', '-', 'g'), '-') slug, (year(delivered_at) - 1789) // 2 + 1 congress_now from bill_versions""")
def bill_labels(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "bill_versions")
    key = T.bill_id(F.col("congress"), F.col("bill_type"), F.col("bill_number"), F.col("version_label"))
    return v.select("version_id", key.alias("bill_key"), T.bill_title(F.col("bill_type"), F.col("bill_number"), F.col("official_title")).alias("title"), T.slug(F.col("version_label")).alias("slug"), T.congress_of_year(F.year("delivered_at")).alias("congress_now"))


@R.add("parsed_ids", r"select node_id, regexp_extract(bill_id, '^([^-:]+)-([^-:]+)-([^-:]+)', 1) congress, regexp_extract(bill_id, '^([^-:]+)-([^-:]+)-([^-:]+)', 2) bill_type, regexp_extract(bill_id, '^([^-:]+)-([^-:]+)-([^-:]+)', 3) as \"number\", regexp_replace(display_path[1], '^TITLE\s+[^\s—]+—', '') title_header from bill_nodes where display_path[1] like 'TITLE %—%'".replace('\\"', '"'))
def parsed_ids(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "bill_nodes").withColumns({"x": T.parse_bill_id(F.col("bill_id")), "first": F.get("display_path", F.lit(0))}).where(F.col("first").like("TITLE %—%"))
    return n.select("node_id", "x.congress", "x.bill_type", "x.number", T.title_match_header(F.col("first")).alias("title_header"))


@R.add("account_names", "select account_id, trim(regexp_replace(lower(heading), '[^a-z0-9 ]', '', 'g')) as \"name\" from report_accounts")
def account_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "report_accounts").select("account_id", T.alnum_name(F.col("heading")).alias("name"))


@R.add("glyph_norm", "select hunk_id, " + ", ".join(f"replace(translate({c}, '‐‑‒–—―−‘’‚‛“”„‟', '-------''''''''\"\"\"\"'), '''''', '\"') {c}" for c in ("v1_text", "v2_text")) + " from pdf_hunks")
def glyph_norm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pdf_hunks").select("hunk_id", *(T.glyph_norm(F.col(c)).alias(c) for c in ("v1_text", "v2_text")))


# --- similarity ---------------------------------------------------------------------------------

_BAG = f"""with w as (select change_id, 'o' s, unnest({words_sql('old_text')}) w from node_changes where old_text is not null and new_text is not null union all select change_id, 'n', unnest({words_sql('new_text')}) from node_changes where old_text is not null and new_text is not null),
c as (select change_id, w, count(*) filter (s = 'o') o, count(*) filter (s = 'n') n from w group by all),
b as (select change_id, round(2.0 * sum(least(o, n)) / sum(o + n), 9) bag, round(2.0 * least(sum(o), sum(n)) / sum(o + n), 9) length_bound, round(cast(count(*) filter (o > 0 and n > 0) as double) / count(*), 9) jaccard from c group by change_id)"""


@R.add("bag_similarity", _BAG + " select change_id, bag, length_bound, jaccard, case when bag < 0.4 then 'below' when bag < 0.6 then 'between' else 'above' end class from b")
def bag_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Upper bounds of the word ratio (by bags, by lengths), the Jaccard index of words, and the class."""
    return catalog.bag_similarity(table(spark, d, "node_changes"), "change_id", "old_text", "new_text")


@R.add("edit_ratio")
def edit_ratio(spark: SparkSession, d: str) -> DataFrame:
    """The edit ratio of whole texts; without SQL, whose distance counts bytes."""
    c = table(spark, d, "node_changes").where("old_text is not null and new_text is not null")
    return c.select("change_id", F.round(catalog.edit_ratio(F.col("old_text"), F.col("new_text")), 9).alias("ratio"))


@R.add("token_jaccard", f"""with w as (select change_id, list_distinct({words_sql('lower(old_text)')}) a, list_distinct({words_sql('lower(new_text)')}) b from node_changes where old_text is not null and new_text is not null)
select change_id, round(case when len(a) + len(b) = 0 then 1.0 else cast(len(list_intersect(a, b)) as double) / (len(a) + len(b) - len(list_intersect(a, b))) end, 9) jaccard from w""")
def token_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """The Jaccard index of the words of both texts, case aside."""
    c = table(spark, d, "node_changes").where("old_text is not null and new_text is not null")
    return c.select("change_id", F.round(catalog.token_jaccard(F.col("old_text"), F.col("new_text")), 9).alias("jaccard"))


@R.add("casefold_ratio")
def casefold_ratio(spark: SparkSession, d: str) -> DataFrame:
    """The word ratio of lower-cased texts."""
    c = table(spark, d, "node_changes").where("old_text is not null and new_text is not null")
    return c.select("change_id", F.round(udfs.seq_ratio(F.lower("old_text"), F.lower("new_text")), 9).alias("ratio"))


@R.add("seq_ratio")
def seq_ratio(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "node_changes").where("old_text is not null and new_text is not null")
    return c.select("change_id", F.round(udfs.seq_ratio("old_text", "new_text"), 9).alias("ratio"))


@R.add("word_diff")
def word_diff(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "node_changes").where("old_text <> new_text").select("change_id", udfs.word_diff_html("old_text", "new_text").alias("html"))


@R.add("pair_amounts")
def pair_amounts(spark: SparkSession, d: str) -> DataFrame:
    c = compare.with_money(table(spark, d, "node_changes").withColumn("pair_id", F.col("bill_id")).withColumn("change_no", F.col("change_id")).drop("financial"))
    return compare.money_rows(c)


@R.add("rewrite_candidates", "with " + SIDES_SQL + f" select a.node_id removed_id, b.node_id added_id from sides a join sides b on a.pair_id = b.pair_id and a.match_path = b.match_path where a.side = 'old' and b.side = 'new' and length({norm_sql('a.body_text')}) > 50 and length({norm_sql('b.body_text')}) > 50")
def rewrite_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Long texts of one path in two neighbouring versions, every old one taken as removed and every new one as added."""
    n = sides(spark, d, "node_id").withColumnRenamed("pair_id", "bill_id").withColumn("change_id", F.col("node_id"))
    one = lambda side, kind, mine, other: n.where(F.col("side") == side).select("bill_id", "match_path", "change_id", F.lit(kind).alias("change_type"), F.col("body_text").alias(mine), F.lit(None).cast("string").alias(other))
    return catalog.rewrite_candidates(one("old", "removed", "old_text", "new_text").unionByName(one("new", "added", "new_text", "old_text")))


@R.add("similarity_histogram", _BAG + " select least(floor(bag * 10), 9) bin, count(*) n from b group by 1")
def similarity_histogram(spark: SparkSession, d: str) -> DataFrame:
    return catalog.histogram(bag_similarity(spark, d), "bag")


@R.add("producer_parity", "select change_type, count(*) filter (p = 'xml') n_xml, count(*) filter (p = 'pdf') n_pdf from (select 'xml' p, change_type from node_changes union all select 'pdf', change_type from pdf_hunks) group by 1")
def producer_parity(spark: SparkSession, d: str) -> DataFrame:
    return catalog.parity(table(spark, d, "node_changes"), table(spark, d, "pdf_hunks"))


@R.add("vocabulary_overlap", f"with v as (select 'xml' p, unnest({words_sql('lower(new_text)')}) w from node_changes union select 'pdf', unnest({words_sql('lower(v2_text)')}) from pdf_hunks), g as (select w, count(*) c, min(p) p from v group by w) select count(*) filter (c = 2) n_both, count(*) filter (c = 1 and p = 'xml') n_xml_only, count(*) filter (c = 1 and p = 'pdf') n_pdf_only from g")
def vocabulary_overlap(spark: SparkSession, d: str) -> DataFrame:
    return catalog.vocabulary_overlap(table(spark, d, "node_changes").select(F.lower("new_text").alias("t")), table(spark, d, "pdf_hunks").select(F.lower("v2_text").alias("t")))


# --- changes ------------------------------------------------------------------------------------


@R.add("change_summary", "select b.bill_id pair_id, t change_type, count(c.change_id) n from (select distinct bill_id from node_changes) b cross join (select unnest(['added', 'removed', 'modified', 'unchanged', 'moved']) t) left join node_changes c on c.bill_id = b.bill_id and c.change_type = t group by all")
def change_summary(spark: SparkSession, d: str) -> DataFrame:
    return compare.summary(table(spark, d, "node_changes").withColumnRenamed("bill_id", "pair_id"))


@R.add("change_filter", f"select change_id, change_type from node_changes where change_type <> 'unchanged' and contains(array_to_string(match_path, ' '), 'sec.') and list_sort({amounts_sql('old_text')}) <> list_sort({amounts_sql('new_text')})")
def change_filter(spark: SparkSession, d: str) -> DataFrame:
    return compare.filter_changes(table(spark, d, "node_changes"), "SEC.", financial=True).select("change_id", "change_type")


@R.add("find_in_view", "select change_id, (length(lower(new_text)) - length(replace(lower(new_text), 'shall', ''))) // 5 n_hits from node_changes where contains(lower(new_text), 'shall')")
def find_in_view(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences of a needle, whatever its case."""
    return catalog.find(table(spark, d, "node_changes"), "change_id", "new_text", "Shall")


@R.add("real_pairs", "select hunk_id, cast(len(list_filter(amount_pairs, lambda p: p.old is not null and p.new is not null and p.old <> p.new)) as int) n_real, cast(len(amount_pairs) as int) n_pairs from pdf_hunks where amount_pairs is not null")
def real_pairs(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "pdf_hunks").where("amount_pairs is not null")
    return h.select("hunk_id", F.size(compare.real_pairs(F.col("amount_pairs"))).alias("n_real"), F.size("amount_pairs").alias("n_pairs"))


@R.add("financial_counts", "select bill_id pair_id, count(*) filter (coalesce(financial.amounts_changed, false)) n_financial from node_changes group by 1")
def financial_counts(spark: SparkSession, d: str) -> DataFrame:
    return compare.financial_count(table(spark, d, "node_changes").withColumnRenamed("bill_id", "pair_id"))


# --- lines --------------------------------------------------------------------------------------


@R.add("hyphen_islands", f"""with l as {SIDE_LINES}, m as (select *, case when coalesce(regexp_matches(lag("text") over w, '[\\p{{L}}\\p{{N}}]-$'), false) and regexp_matches("text", '^\\p{{Ll}}') then 0 else 1 end f from l window w as (partition by doc_id order by line_ord)),
g as (select *, sum(f) over (partition by doc_id order by line_ord) g from m), k as (select doc_id, g, min(line_ord) a, max(line_ord) b from g group by all)
select g.doc_id, k.a line_ord, string_agg(case when g.line_ord < k.b then regexp_replace("text", '-$', '') else "text" end, '' order by g.line_ord) as "text" from g join k on g.doc_id = k.doc_id and g.g = k.g group by g.doc_id, k.a""")
def hyphen_islands(spark: SparkSession, d: str) -> DataFrame:
    """Lines broken inside a word joined."""
    return P.merge_hyphens(side_lines(spark, d), ["doc_id"], ["line_ord"]).select("doc_id", "line_ord", "text")


@R.add("running_offsets", f"""select doc_id, line_ord, coalesce(sum(length("text") + 8) over (partition by doc_id order by line_ord rows between unbounded preceding and 1 preceding), 0) start_char from {SIDE_LINES}""")
def running_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Where each line starts in the rendered text (five places for the number, two blanks, a line end)."""
    l = side_lines(spark, d).withColumns({"page": F.lit(1), "line_number": F.lit(None).cast("int")})
    return P.rendered(l).select("doc_id", "line_ord", "start_char")


def _heading_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines_of(table(spark, d, "documents").where("source = 'committee_report'"), "doc_id", "text").select(F.col("doc_id").alias("report_id"), F.col("line_ord").alias("line_no"), F.col("text").alias("line"))


@R.add("summary_accounts", r"""with l as (select doc_id report_id, generate_subscripts(l, 1) - 1 line_no, trim(unnest(l)) s from (select doc_id, string_split("text", chr(10)) l from documents where source = 'committee_report' and "text" is not null)),
h as (select *, case when s <> '' and not contains(s, '....') and not s like '(%' and not regexp_matches(s, '^(INCLUDING|LIMITATION|RESCISSION)\b') then s end solid from l),
a as (select *, last_value(solid ignore nulls) over (partition by report_id order by line_no rows between 7 preceding and 1 preceding) above from h)
select report_id, line_no, above heading, cast(replace(regexp_extract(s, '^Committee recommendation\.{2,}\s+\$?([\d,]+)\s*$', 1), ',', '') as bigint) committee_recommendation from a
where regexp_matches(s, '^Committee recommendation\.{2,}\s+\$?([\d,]+)\s*$') and length(regexp_replace(above, '\P{L}', '', 'g')) > 0 and length(regexp_replace(above, '\P{Lu}', '', 'g')) / cast(length(regexp_replace(above, '\P{L}', '', 'g')) as double) > 0.8""")
def summary_accounts(spark: SparkSession, d: str) -> DataFrame:
    """Accounts of the summary blocks in report narratives, with the heading above each."""
    return reports_.summary_accounts(_heading_lines(spark, d)).select("report_id", "line_no", "heading", "committee_recommendation")


@R.add("report_cells", r"""with t as (select row_id, list_filter(regexp_split_to_array(coalesce(cells_text, ''), '\s+'), lambda x: x <> '') t from comparative_rows),
c as (select row_id, generate_subscripts(t, 1) - 1 cell_no, unnest(t) x from t)
select row_id, cell_no, case when regexp_matches(x, '^\.{2,}$') or x like '(%' then null when regexp_matches(x, '^[+\-]?\(?-?[\d,]+\)?$') then case when x like '-%' then -1 else 1 end * cast(regexp_replace(x, '[^\d]', '', 'g') as bigint) end cell from c""")
def report_cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "comparative_rows").select("row_id", F.posexplode(reports_.cells(F.col("cells_text"))).alias("cell_no", "cell"))


# --- marks ----------------------------------------------------------------------------------------


@R.add("overlap_marks", f"""with l as (select doc_id, line_ord, coalesce(sum(length("text") + 1) over (partition by doc_id order by line_ord rows between unbounded preceding and 1 preceding), 0) s, length("text") n from {SIDE_LINES}), m as (select 'v1-' || hunk_id doc_id, hunk_id mark_id, v1_range.start_page s, v1_range.start_page + 10 * v1_range.start_line e from pdf_hunks union all select 'v2-' || hunk_id, hunk_id, v2_range.start_page, v2_range.start_page + 10 * v2_range.start_line from pdf_hunks)
select l.doc_id, line_ord row_id, mark_id, greatest(l.s, m.s) from_char, least(l.s + n, m.e) to_char from l join m on l.doc_id = m.doc_id and m.s < l.s + n and m.e > l.s where n > 0 and m.e > m.s""")
def overlap_marks(spark: SparkSession, d: str) -> DataFrame:
    """The part of each mark on each line it overlaps; marks are derived from the hunks' ranges."""
    w = Window.partitionBy("doc_id").orderBy("line_ord").rowsBetween(Window.unboundedPreceding, -1)
    l = side_lines(spark, d).withColumn("row_start", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)))
    rows = l.select("doc_id", F.col("line_ord").alias("row_id"), "row_start", (F.col("row_start") + F.length("text")).alias("row_end"))
    one = lambda v: table(spark, d, "pdf_hunks").select(F.concat(F.lit(f"{v}-"), F.col("hunk_id").cast("string")).alias("doc_id"), F.col("hunk_id").alias("mark_id"), F.col(f"{v}_range.start_page").alias("start_char"), (F.col(f"{v}_range.start_page") + 10 * F.col(f"{v}_range.start_line")).alias("end_char"))
    return spans.marks_on_rows(rows, one("v1").unionByName(one("v2")))


@R.add("accept_marks", """with recursive m as (select user_id doc_id, cast(floor(epoch(ts)) as bigint) s, event_id id from events), q as (select doc_id, min({'s': s, 'id': id}) x from m group by 1
 union all select q.doc_id, (select min({'s': m.s, 'id': m.id}) from m where m.doc_id = q.doc_id and m.s >= q.x.s + 86400) from q where (select min(m.s) from m where m.doc_id = q.doc_id and m.s >= q.x.s + 86400) is not null)
select doc_id, x.s start_char, x.s + 86400 end_char, x.id mark_id from q""")
def accept_marks(spark: SparkSession, d: str) -> DataFrame:
    """Events as marks of their user's timeline, overlapping ones dropped: first placement wins."""
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return spans.accept_marks(table(spark, d, "events").select(F.col("user_id").alias("doc_id"), at.alias("start_char"), (at + 86_400).alias("end_char"), F.col("event_id").alias("mark_id")))


# --- statistics over printed sizes (lineitem stands in for measured lines) -----------------------


@R.add("median_width", "select l_suppkey doc_id, round(median(l_extendedprice) - median(l_quantity), 6) width from lineitem group by 1")
def median_width(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_quantity").alias("content_left"), F.col("l_extendedprice").alias("content_right"), F.lit("a").alias("text"))
    return A.column_width(l).select("doc_id", F.round("width", 6).alias("width"))


@R.add("gap_clusters", "with s as (select distinct l_partkey, l_quantity q from lineitem), x as (select *, case when q - lag(q) over (partition by l_partkey order by q) > 3 then 1 else 0 end f from s), g as (select *, sum(f) over (partition by l_partkey order by q) c from x) select l_partkey doc_id, c cluster, count(*) n, min(q) lo, max(q) hi from g group by all")
def gap_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Values split where the gap to the next is more than 3."""
    return catalog.gap_clusters(table(spark, d, "lineitem").select(F.col("l_partkey").alias("doc_id"), F.col("l_quantity").alias("q")), "doc_id", "q", 3.0)


@R.add("coverage", "select l_orderkey doc_id, round(avg(case when l_returnflag = 'N' then 1.0 else 0.0 end), 9) coverage from lineitem group by 1")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line_number"), F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).alias("glyph_size"))
    return A.coverage(l).select("doc_id", F.round("coverage", 9).alias("coverage"))


# --- index ----------------------------------------------------------------------------------------

_IX = "with i as (select cast(s_suppkey as varchar) id, s_name \"name\", cast(s_nationkey as varchar) nation from supplier), b as (select cast(c_custkey as varchar) id, c_name \"name\", c_mktsegment segment from customer)"


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    return s.select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("nation")), c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))


@R.add("upsert_merge", _IX + ' select coalesce(b.id, i.id) id, coalesce(b."name", i."name") as "name", coalesce(b.segment, \'\') segment, coalesce(i.nation, \'\') nation from i full join b on i.id = b.id')
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    return I.upsert(*_index(spark, d), mode="merge")


@R.add("upsert_skip", _IX + ' select coalesce(i.id, b.id) id, coalesce(i."name", b."name") as "name", case when i.id is null then coalesce(b.segment, \'\') else \'\' end segment, coalesce(i.nation, \'\') nation from i full join b on i.id = b.id')
def upsert_skip(spark: SparkSession, d: str) -> DataFrame:
    return I.upsert(*_index(spark, d), mode="skip")


@R.add("new_and_known", _IX + " select id, case when id in (select id from i) then 'known' else 'new' end status from b")
def new_and_known(spark: SparkSession, d: str) -> DataFrame:
    i, b = _index(spark, d)
    return I.new_records(i, b).select("id", F.lit("new").alias("status")).unionByName(I.known_records(i, b).select("id", F.lit("known").alias("status")))


@R.add("rename_columns", _IX + ' select id, case when "name" = \'\' then nation else "name" end as "name" from i')
def rename_columns(spark: SparkSession, d: str) -> DataFrame:
    return I.rename(_index(spark, d)[0], {"nation": "name", "absent": "id"})


@R.add("prefix_lookup", "select version_id, bill_id id from bill_versions where starts_with(bill_id, '118-hr-1')")
def prefix_lookup(spark: SparkSession, d: str) -> DataFrame:
    return I.by_prefix(table(spark, d, "bill_versions").select("version_id", F.col("bill_id").alias("id")), 118, "hr", 1)


@R.add("dedup_first", "select congress, bill_type, bill_number, version_id from (select *, row_number() over (partition by congress, bill_type, bill_number order by delivered_at, version_id) k from bill_versions) where k = 1")
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return I.first_of(table(spark, d, "bill_versions"), ["congress", "bill_type", "bill_number"], ["delivered_at", "version_id"]).select("congress", "bill_type", "bill_number", "version_id")


@R.add("version_order", "select version_id, row_number() over (partition by bill_id order by coalesce(dt, m), version_label, version_id) chrono from (select *, cast(delivered_at as date) dt, max(cast(delivered_at as date)) over (partition by bill_id) m from bill_versions)")
def version_order(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "bill_versions").select("version_id", "bill_id", F.to_date("delivered_at").alias("date"), F.struct("version_label", "version_id").alias("type"))
    return I.version_order(v).select("version_id", "chrono")


@R.add("adjacent_versions", "select * from (select bill_id, version_no version_old, lead(version_no) over (partition by bill_id order by version_no) version_new from (select distinct bill_id, version_no from bill_versions)) where version_new is not null")
def adjacent_versions(spark: SparkSession, d: str) -> DataFrame:
    return I.adjacent_versions(table(spark, d, "bill_versions"))


@R.add("ingest_tasks", "select c congress, t bill_type from (select unnest(range(113, 120)) c) cross join (select unnest(['hr', 's', 'hjres', 'sjres']) t)")
def ingest_tasks(spark: SparkSession, d: str) -> DataFrame:
    return I.tasks(spark, 113, 119, ["hr", "s", "hjres", "sjres"]).select(F.col("congress").cast("bigint").alias("congress"), "bill_type")


# --- ground truth ---------------------------------------------------------------------------------


def _first(spark: SparkSession, d: str) -> DataFrame:
    return latest_nodes(spark, d).where("version = 1").withColumn("node_id", F.col("node_ord"))


_TRUTH = "with " + LAST_SQL + f""", n as (select bill_id, match_path, {amounts_sql('body_text')} a from last where ver = 1 and len(match_path) > 0),
ag as (select distinct bill_id, trim(regexp_replace(lower(match_path[1]), '[^a-z0-9 ]', '', 'g')) agency, unnest(a) amount from n),
pl as (select bill_id, match_path, amount from (select distinct bill_id, match_path, unnest(a) amount from n)),
v as (select *, trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9 ]', '', 'g')) t, trim(regexp_replace(lower(coalesce(bureau, '')), '[^a-z0-9 ]', '', 'g')) b from validation_defense),
p as (select validation_id, expected_amount x, amount m, row_number() over (partition by validation_id order by amount desc) i from v join pl on pl.bill_id = v.bill and pl.match_path = v.match_path where amount > 0 and amount <= expected_amount),
q as (select * from p where i <= 16),
s as (select validation_id from q where m = x union select a.validation_id from q a join q b on a.validation_id = b.validation_id and a.i < b.i where a.m + b.m = a.x union select a.validation_id from q a join q b on a.validation_id = b.validation_id and a.i < b.i join q c on c.validation_id = a.validation_id and b.i < c.i where a.m + b.m + c.m = a.x
 union select a.validation_id from q a join q b on a.validation_id = b.validation_id and a.i < b.i join q c on c.validation_id = a.validation_id and b.i < c.i join q e on e.validation_id = a.validation_id and c.i < e.i where a.m + b.m + c.m + e.m = a.x),
m as (select validation_id, bill, case when exists (select 1 from ag where ag.bill_id = v.bill and ag.amount = v.expected_amount and agency <> '' and (agency = v.t or agency = v.b)) then 'agency' when validation_id in (select validation_id from s) then 'component-sum' else 'unvalidated' end method from v)"""


@R.add("validate_accounts", _TRUTH + " select validation_id, method from m")
def validate_accounts(spark: SparkSession, d: str) -> DataFrame:
    return validation.validate(table(spark, d, "validation_defense"), _first(spark, d)).select("validation_id", "method")


@R.add("recall_rollup", _TRUTH + " select bill, count(*) n, count(*) filter (method <> 'unvalidated') n_validated, round(cast(count(*) filter (method <> 'unvalidated') as double) / count(*), 6) recall from m group by rollup (bill)")
def recall_rollup(spark: SparkSession, d: str) -> DataFrame:
    return validation.recall(validation.validate(table(spark, d, "validation_defense"), _first(spark, d)))


_ALNUM = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9 ]', '', 'g'))"
_TOKS = lambda c: f"list_filter(regexp_split_to_array({_ALNUM(c)}, ' +'), lambda w: w <> '')"


@R.add("account_paths", "with " + LAST_SQL + f""", n as (select bill_id, node_ord, match_path, {_ALNUM('match_path[len(match_path)]')} nn, {_TOKS("array_to_string(match_path, ' ')")} pt, {_TOKS('match_path[1]')} ft from last where ver = 1 and len(match_path) > 0),
a as (select validation_id k, bill, {_ALNUM("coalesce(excel_name, '')")} nh, {_TOKS("coalesce(bureau, '')")} bt, {_TOKS("coalesce(title, '')")} tt from validation_defense), ex as (select * from a join n on bill = bill_id and nh = nn),
pr as (select * from a join n on bill = bill_id where nh <> '' and k not in (select k from ex) and (contains(nn, nh) or contains(nh, nn))),
c as (select k, node_ord, match_path, len(list_intersect(bt, pt)) b, len(list_intersect(tt, ft)) t from (select * from ex union all select * from pr)),
r as (select *, row_number() over w rk, lead(b) over w nb, lead(t) over w nt from c window w as (partition by k order by b desc, t desc, node_ord))
select validation_id "key", array_to_string(r1.match_path, ' > ') path_text from validation_defense left join (select * from r where rk = 1 and (nb is null or nb <> b or nt <> t)) r1 on k = validation_id""")
def account_paths(spark: SparkSession, d: str) -> DataFrame:
    """The one bill path that bears each ground-truth account's name."""
    v = table(spark, d, "validation_defense").select(F.col("validation_id").alias("key"), F.col("bill").alias("bill_id"), "title", "bureau", F.col("excel_name").alias("name"))
    return validation.account_paths(v, _first(spark, d)).select("key", F.array_join("path", " > ").alias("path_text"))


# --- sets -----------------------------------------------------------------------------------------

_XA = f"select unnest({amounts_sql('new_text')}) amount from node_changes"
_PA = f"select unnest({amounts_sql('v2_text')}) amount from pdf_hunks"


def _amount_sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    one = lambda t, c: table(spark, d, t).select(F.explode(T.amounts(c)).alias("amount"))
    return one("node_changes", "new_text"), one("pdf_hunks", "v2_text")


@R.add("amounts_except", f"select amount from ({_XA}) except select amount from ({_PA})")
def amounts_except(spark: SparkSession, d: str) -> DataFrame:
    x, p = _amount_sets(spark, d)
    return x.subtract(p)


@R.add("amounts_intersect", f"select amount from ({_XA}) intersect select amount from ({_PA})")
def amounts_intersect(spark: SparkSession, d: str) -> DataFrame:
    x, p = _amount_sets(spark, d)
    return x.intersect(p)


@R.add("amounts_union", f"select amount, count(*) n from (({_XA}) union all ({_PA})) group by 1")
def amounts_union(spark: SparkSession, d: str) -> DataFrame:
    x, p = _amount_sets(spark, d)
    return x.unionByName(p).groupBy("amount").agg(F.count("*").alias("n"))


@R.add("top_amounts", f"select bill_id, amount, rk from (select bill_id, amount, row_number() over (partition by bill_id order by amount desc) rk from (select distinct bill_id, unnest({amounts_sql('new_text')}) amount from node_changes)) where rk <= 16")
def top_amounts(spark: SparkSession, d: str) -> DataFrame:
    """The sixteen largest distinct amounts of each bill, the pool of component sums."""
    a = table(spark, d, "node_changes").select("bill_id", F.explode(T.amounts("new_text")).alias("amount")).distinct()
    return a.withColumn("rk", F.row_number().over(Window.partitionBy("bill_id").orderBy(F.desc("amount")))).where("rk <= 16")


# --- views and names ------------------------------------------------------------------------------


@R.add("view_structural", "select change_id, change_type from node_changes where change_type <> 'modified'")
def view_structural(spark: SparkSession, d: str) -> DataFrame:
    return compare.view_filter(table(spark, d, "node_changes"), "structural").select("change_id", "change_type")


@R.add("version_paths", "select version_id, bill_id || '/' || version_no || '_' || case when trim(regexp_replace(lower(coalesce(version_label, '')), '[^a-z0-9]+', '-', 'g'), '-') = '' then 'unknown' else trim(regexp_replace(lower(version_label), '[^a-z0-9]+', '-', 'g'), '-') end || '.xml' path from bill_versions")
def version_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "bill_versions").select("version_id", T.version_path(F.col("bill_id"), F.col("version_no"), F.col("version_label")).alias("path"))


@R.add("heading_predicates", f"""select doc_id, line_ord, regexp_matches("text", '\\p{{L}}') and not regexp_matches("text", '\\p{{Ll}}') and not regexp_matches("text", '^TITLE\\s+[IVXLC]+\\b') and not regexp_matches("text", '^SEC(TION)?\\.?\\s+\\d+\\b') heading, regexp_matches("text", '[a-z]') lower_case, regexp_matches(trim("text"), '^\\(.*\\)$') in_parentheses, upper(list_last(regexp_split_to_array(trim("text"), '\\s+'))) in ('AND','OR','OF','FOR','TO','THE','A','AN','IN','ON','WITH','AT','BY') dangling from {SIDE_LINES}""")
def heading_predicates(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return side_lines(spark, d).select("doc_id", "line_ord", A.is_heading(t).alias("heading"), A.has_lowercase(t).alias("lower_case"), A.is_parenthetical(t).alias("in_parentheses"), A.dangles(t).alias("dangling"))


@R.add("searched_spans")
def searched_spans(spark: SparkSession, d: str) -> DataFrame:
    """Texts of archived changes looked up in the joined texts of their bill, old and new ones apart."""
    one = lambda c: table(spark, d, "node_changes").where(F.col(c).isNotNull()).select(F.concat("bill_id", F.lit(f":{c}")).alias("pair_id"), F.col("change_id").alias("change_no"), F.col(c).alias("target"))
    c = one("old_text").unionByName(one("new_text"))
    texts = c.groupBy("pair_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("change_no", "target"))), lambda x: x["target"]), "\n").alias("full_text"))
    return spans.search_spans(c, texts)
