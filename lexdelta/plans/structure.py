"""Queries of a document's structure: its tree, its full text and where things stand in it, for every version of every bill."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexdelta.operators import spans, tree
from lexdelta.plans.registry import Registry
from lexdelta.plans.relational import amounts_sql
from lexdelta.plans.versions import DOCS_SQL, bill_docs
from lexdelta.session import cut

R = Registry()

# --- trees ----------------------------------------------------------------------------------------

_SHOWN = "case when coalesce(display_text, '') <> '' then display_text else body_text end"
_ITEMS = "with " + DOCS_SQL + f""", it as (select doc_id, node_ord, coalesce(display_path, []) path, {amounts_sql(_SHOWN)} a, coalesce(header_text, '') h, case when tag = 'section' then coalesce(section_number, '') else '' end sec,
 case tag when 'appropriations-major' then 'major' when 'appropriations-intermediate' then 'agency' when 'appropriations-small' then 'account' when 'section' then 'section' when 'front-matter' then 'preamble' else 'account' end lv from docs),
p as (select * from it where len(path) > 0), e as (select doc_id, node_ord, unnest(list_transform(range(1, len(path) + 1), lambda k: path[1:k])) prefix from p), f as (select doc_id, prefix, min(node_ord) sort_ord from e group by all),
k as (select *, row_number() over (partition by doc_id, path order by node_ord) rk from p),
t as (select f.doc_id, prefix path, sort_ord, cast(len(prefix) as int) depth, coalesce(k.lv, case when regexp_matches(prefix[len(prefix)], '^Division [A-Z]($|[\\s:])') then 'division' when regexp_matches(prefix[len(prefix)], '(?i)^TITLE\\s+[IVXLCDM]+\\b') then 'title' else 'heading' end) lv, k.node_ord item_ord, coalesce(k.a, []) a, k.h, k.sec, true inner_node from f left join k on k.doc_id = f.doc_id and k.path = f.prefix and rk = 1
 union all select doc_id, path, node_ord, cast(len(path) as int), lv, node_ord, a, h, sec, false from k where rk > 1
 union all select doc_id, path, node_ord, 0, lv, node_ord, a, h, sec, false from it where len(path) = 0),
fm as (select *, coalesce(min(case when (depth = 1 or depth = 0) and lv in ('title', 'division') then sort_ord end) over w, min(case when depth = 1 then sort_ord end) over w, 1 << 30) lim from t window w as (partition by doc_id)),
g as (select doc_id, case when depth <= 1 and sort_ord < lim and item_ord is not null then ['Front Matter', case when h <> '' then h else sec end] else path end path, sort_ord, depth, lv, item_ord, a, depth <= 1 and sort_ord < lim front, inner_node from fm
 union all select doc_id, ['Front Matter'], min(sort_ord), 1, 'preamble', null, [], false, true from fm where depth <= 1 and sort_ord < lim group by doc_id)
"""


def _tree(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    items = tree.items_of(bill_docs(spark, d))
    return tree.build(items), items


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    return tree.group_front_matter(*_tree(spark, d))


@R.add("tree_nodes", _ITEMS + "select doc_id, array_to_string(path, ' > ') path_text, sort_ord, depth, lv as \"level\", item_ord from t")
def tree_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The structure of every version as an adjacency table."""
    return _tree(spark, d)[0].select("doc_id", F.array_join("path", " > ").alias("path_text"), "sort_ord", "depth", "level", "item_ord")


@R.add("tree_parents", _ITEMS + "select distinct doc_id, array_to_string(path, ' > ') path_text, case when len(path) > 1 then array_to_string(path[1:len(path) - 1], ' > ') end parent_text from t where len(path) > 0")
def tree_parents(spark: SparkSession, d: str) -> DataFrame:
    t = _tree(spark, d)[0].where(F.size("path") > 0)
    up = t.select("doc_id", F.col("node_id").alias("parent_id"), F.array_join("path", " > ").alias("parent_text"))
    return t.join(up, ["doc_id", "parent_id"], "left").select("doc_id", F.array_join("path", " > ").alias("path_text"), "parent_text").distinct()


@R.add("front_matter", _ITEMS + "select doc_id, array_to_string(path, ' > ') path_text, sort_ord, depth, lv as \"level\", item_ord, front from g")
def front_matter(spark: SparkSession, d: str) -> DataFrame:
    """The tree with what stands before the first title or division below one node."""
    return _grouped(spark, d).select("doc_id", F.array_join("path", " > ").alias("path_text"), "sort_ord", "depth", "level", "item_ord", (F.coalesce("parent_id", F.lit("")) == "front").alias("front"))


@R.add("tree_money", _ITEMS + " select doc_id, amount, count(*) n from (select doc_id, unnest(a) amount from it) group by all")
def tree_money(spark: SparkSession, d: str) -> DataFrame:
    """The amounts in the grouped tree: as many of each as in the document."""
    return _grouped(spark, d).select("doc_id", F.explode("own_amounts").alias("amount")).groupBy("doc_id", "amount").agg(F.count("*").alias("n"))


@R.add("money_conserved", "select cast('' as varchar) doc_id, cast(0 as bigint) amount, cast(0 as bigint) in_tree, cast(0 as bigint) in_items where false")
def money_conserved(spark: SparkSession, d: str) -> DataFrame:
    """Amounts the tree counts otherwise than its items: none."""
    t, items = _tree(spark, d)
    return tree.conservation(tree.group_front_matter(t, items), items)


def _placed(spark: SparkSession, d: str) -> DataFrame:
    t, items = _tree(spark, d)
    lines = cut(_lines(spark, d), "lines")
    return tree.placed(tree.group_front_matter(t, items), items, spans.body_spans(lines), spans.heading_spans(lines))


@R.add("tree_json")
def tree_json(spark: SparkSession, d: str) -> DataFrame:
    """The tree of every version of every bill, with the places of its nodes in the full text."""
    return tree.nested_json(_placed(spark, d))


# --- full text ------------------------------------------------------------------------------------

_LINES = "with " + DOCS_SQL + """, n as (select doc_id, node_ord, element_id, coalesce(display_path, []) path, coalesce(section_number, '') num, coalesce(header_text, '') hdr, coalesce(body_text, '') body, case when coalesce(display_text, '') <> '' then display_text else body_text end shown from docs),
h as (select *, case when num <> '' and len(path) > 0 then path[1:len(path) - 1] else path end h from n), l as (select *, coalesce(lag(h) over (partition by doc_id order by node_ord), []) p from h),
c as (select *, coalesce(list_min(list_filter(range(1, greatest(len(h), len(p)) + 2), lambda i: i > len(h) or i > len(p) or h[i] <> p[i])), 1) - 1 c from l),
r as (select doc_id, node_ord, i - c "at", element_id, h[i + 1] "text", case when i = 0 or upper(h[i + 1]) like 'TITLE %' then 'title' else 'account' end kind, h[i + 1] "label", true gap, 0 pre from (select *, unnest(range(c, len(h))) i from c)
 union all select doc_id, node_ord, 1000, element_id, hdr, null, null, false, 0 from c where len(path) = 0 and hdr <> ''
 union all select doc_id, node_ord, 1001, element_id, case when num <> '' then upper(num) || '.  ' else '' end || shown, case when num <> '' then 'section' else 'body' end, nullif(num, ''), true, case when num <> '' then length(num) + 3 else 0 end from c where body <> ''),
b as (select *, case when row_number() over w = 1 then 0 when gap or coalesce(lag(kind) over w in ('section', 'body'), false) then 1 else 0 end blank, row_number() over w rn from r window w as (partition by doc_id order by node_ord, "at")),
s as (select *, sum(length("text") + 1 + blank) over w - length("text") - 1 start_char, rn - 1 + sum(blank) over w line_no from b window w as (partition by doc_id order by rn))
"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return spans.serialise(bill_docs(spark, d))


@R.add("serialised_lines", _LINES + "select doc_id, cast(line_no as bigint) line_no, \"text\", kind, \"label\", cast(start_char as bigint) start_char, case when kind in ('section', 'body') then cast(start_char + pre as bigint) end body_start from s")
def serialised_lines(spark: SparkSession, d: str) -> DataFrame:
    """Full texts line by line: the part of each node's path that the node before had not, headers, bodies, with their places."""
    return _lines(spark, d).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "text", "kind", "label", F.col("start_char").cast("bigint").alias("start_char"), F.col("body_start").cast("bigint").alias("body_start"))


@R.add("full_texts", _LINES + "select doc_id, length(x) n_chars, md5(x) digest from (select doc_id, string_agg(case when blank > 0 then chr(10) else '' end || \"text\", chr(10) order by rn) x from s group by doc_id)")
def full_texts(spark: SparkSession, d: str) -> DataFrame:
    """Length and digest of every version's full text."""
    return spans.full_text(_lines(spark, d)).select("doc_id", F.length("full_text").cast("bigint").alias("n_chars"), F.md5("full_text").alias("digest"))


@R.add("section_list", _LINES + """select doc_id, "label", kind, cast(start_char as bigint) start_char, case when kind = 'title' and upper("label") like 'TITLE %' and not contains("label", '—') and lead(kind) over w = 'account' then lead("label") over w end descriptor from s where kind in ('title', 'account', 'section') window w as (partition by doc_id order by rn)""")
def section_list(spark: SparkSession, d: str) -> DataFrame:
    """The list of headings; a bare title is described by the account below it."""
    return spans.sections(_lines(spark, d)).withColumn("start_char", F.col("start_char").cast("bigint"))


@R.add("body_spans", _LINES + "select doc_id, element_id, cast(arg_max(start_char + pre, rn) as bigint) start_char, cast(arg_max(start_char + length(\"text\"), rn) as bigint) end_char from s where kind in ('section', 'body') and coalesce(element_id, '') <> '' group by all")
def body_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where each element's body stands in the serialised text of every version of every bill."""
    b = spans.body_spans(_lines(spark, d))
    return b.select("doc_id", "element_id", F.col("start_char").cast("bigint").alias("start_char"), F.col("end_char").cast("bigint").alias("end_char"))


_N = _LINES[_LINES.index("n as (select doc_id, node_ord, element_id"):].rstrip()


@R.add("tree_spans", _ITEMS.rstrip() + ", " + _N + """, bs as (select doc_id, element_id, arg_max(start_char + pre, rn) lo, arg_max(start_char + length("text"), rn) hi from s where kind in ('section', 'body') and coalesce(element_id, '') <> '' group by all),
hs as (select s.doc_id, c.h[1:s.level_no] path, min(start_char) lo from (select *, "at" + (select c.c from c where c.doc_id = s.doc_id and c.node_ord = s.node_ord) + 1 level_no from s where kind in ('title', 'account')) s join c on c.doc_id = s.doc_id and c.node_ord = s.node_ord group by all),
o as (select g.*, coalesce(bs.lo, hs.lo) lo, coalesce(bs.hi, hs.lo + length(g.path[len(g.path)])) hi from g left join docs on g.doc_id = docs.doc_id and g.item_ord = docs.node_ord left join bs on bs.doc_id = g.doc_id and bs.element_id = docs.element_id left join hs on hs.doc_id = g.doc_id and hs.path = g.path),
top as (select doc_id, min(lo) flo, max(hi) fhi from o where front group by 1)
select o.doc_id, array_to_string(o.path, ' > ') path_text, sort_ord, item_ord, cast(case when o.path = ['Front Matter'] and item_ord is null then flo else lo end as bigint) start_char, cast(case when o.path = ['Front Matter'] and item_ord is null then fhi else hi end as bigint) end_char from o left join top using (doc_id)""")
def tree_spans(spark: SparkSession, d: str) -> DataFrame:
    """The places of tree nodes in the full text: body, heading, or what stands below."""
    return _placed(spark, d).select("doc_id", F.array_join("path", " > ").alias("path_text"), "sort_ord", "item_ord", F.col("start_char").cast("bigint").alias("start_char"), F.col("end_char").cast("bigint").alias("end_char"))
