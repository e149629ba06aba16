"""Queries of the general training-data problems: units (1), nested records (2), snapshots (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexdelta.operators import nested, snapshots, units
from lexdelta.plans.registry import Registry
from lexdelta.sources.tables import table

R = Registry()


def _amounts(spark: SparkSession, d: str) -> DataFrame:
    return units.stated_amounts(table(spark, d, "report_accounts"), table(spark, d, "comparative_rows"), table(spark, d, "committee_reports"), table(spark, d, "validation_defense"))


# Every text that may name a unit is a row (source_table, row_key, rank, t) cut into words; the words decide. A label
# counts where its tail has unit words only, a report's opening by the sentences on its statement.
_P1 = r"""with raw as (
 select 'report_accounts' source_table, account_id row_key, 1 "rank", trim(regexp_replace(lower(amount_text), '[^0-9a-z.,$()-]+', ' ', 'g')) t from report_accounts
 union all select 'report_accounts', account_id, 2, lower(unit_note) from report_accounts union all select 'report_accounts', account_id, 3, lower(heading) from report_accounts
 union all select 'comparative_rows', row_id, 3, lower(item) from comparative_rows
 union all select 'validation_defense', validation_id, 2, lower(note) from validation_defense union all select 'validation_defense', validation_id, 3, lower(excel_name) from validation_defense),
fig as (select row_key, replace(regexp_extract(t, '^[$]? ?(-?[0-9][0-9,]*([.][0-9]+)?)', 1), ',', '') f, trim(regexp_replace(t, '^[$]? ?-?[0-9][0-9,]*([.][0-9]+)?', '')) rest from raw where "rank" = 1),
tails as (select * replace (case "rank" when 3 then coalesce(nullif(regexp_extract(t, '[\[(]([^\[\]()]*)[\])]\s*$', 1), ''), nullif(regexp_extract(t, ', (in [^,]*)$', 1), ''), regexp_extract(t, '--?([^-\[\]()]*)$', 1)) else t end as t) from raw where "rank" > 1 and t is not null),
head as (select report_pkg, unnest(string_split(regexp_replace(regexp_replace(head_text, '\s+', ' ', 'g'), '([.\])]) ', '\1' || chr(1), 'g'), chr(1))) t from committee_reports),
heads as (select report_pkg, lower(t) t from head where not regexp_matches(t, '[$] ?[1-9]') and (regexp_matches(t, '^[\[(]') or list_has_any(regexp_split_to_array(lower(t), '[^a-z]+'), ['statement', 'table', 'column', 'columns', 'figure', 'figures', 'amounts']))),
texts as (select source_table, cast(row_key as varchar) k, "rank", t from tails union all select 'head', report_pkg, 4, t from heads
 union all select 'report_accounts', cast(row_key as varchar), 1, case when rest in ('k', 'thou', 'thou.', 'thousand', 'thousand dollars') then 'thousand' when rest in ('m', 'mn', 'mil', 'mil.', 'million', 'million dollars') then 'million'
  when rest in ('b', 'bn', 'billion', 'billion dollars') then 'billion' when rest = 'dollars' then 'dollars' end from fig where f <> ''),
w as (select *, list_filter(string_split(regexp_replace(t, '[^a-z0-9$]+', ' ', 'g'), ' '), lambda x: x <> '') w from texts where t is not null),
named as (select source_table, k, "rank", case when "rank" = 3 and len(list_filter(w, lambda x: not regexp_matches(x, '^(in|of|the|all|are|amounts?|figures?|columns?|omitted|whole|actual|dollars|usd|(thous|mill|bill)(and|ion)s?|three|six|zeros|mn|mil|[$]|[$]?0+s?|[$][kmb]|[kmb][$])$'))) > 0 then null
 when list_has_any(w, ['usd', 'nearest', 'converted', 'not']) or regexp_matches(array_to_string(w, ' '), '(actual|whole) dollars') then 1
 when list_has_any(w, ['billion', 'billions', 'bn', '$b']) then 1000000000 when list_has_any(w, ['million', 'millions', 'mn', 'mil', '$m', '$mm', 'm$']) or list_has_all(w, ['six', 'zeros']) then 1000000
 when list_has_any(w, ['thousand', 'thousands', 'thou', '000s', '000', '$000', '$k', 'k$']) or list_has_all(w, ['three', 'zeros']) then 1000 when list_contains(w, 'dollars') then 1 end u from w),
best as (select source_table, k, min_by(u, "rank") u from named where u is not null and source_table <> 'head' group by all), said as (select k report_pkg, max(u) u from named where source_table = 'head' and u is not null group by 1),
a as (select 'report_accounts' source_table, row_key, try_cast(f as decimal(28,6)) f, 1 d from fig where f <> '' and rest in ('', 'dollars', 'k', 'thou', 'thou.', 'thousand', 'thousand dollars', 'm', 'mn', 'mil', 'mil.', 'million', 'million dollars', 'b', 'bn', 'billion', 'billion dollars')
 union all select 'comparative_rows', row_id, cast(committee_recommendation_thousands as decimal(28,6)), coalesce(said.u, 1000) from comparative_rows left join said using (report_pkg)
 union all select 'validation_defense', validation_id, cast(expected_amount as decimal(28,6)), 1 from validation_defense)
select distinct a.source_table, row_key, cast(round(f * coalesce(u, d), 0) as bigint) amount_dollars from a left join best on a.source_table = best.source_table and cast(row_key as varchar) = k where f is not null and coalesce(u, d) <> 1"""


@R.add("p1_found", _P1)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = units.harmonise(_amounts(spark, d), units.CONVENTIONS)
    return rows.where("factor <> 1 and amount is not null").select(F.col("source").alias("source_table"), F.col("key").alias("row_key"), F.col("amount").alias("amount_dollars")).distinct()


@R.add("p1_units")
def p1_units(spark: SparkSession, d: str) -> DataFrame:
    """All amounts, the unit of unmarked ones from the mixture alone, with its posterior."""
    rows = units.harmonise(_amounts(spark, d)).where("figure is not null")
    return rows.select(F.col("source").alias("source_table"), F.col("key").alias("row_key"), "factor", "unit_source", F.round("posterior", 6).alias("posterior"), "uncertain", F.col("amount").alias("amount_dollars"))


_NODES = """with recursive t as (select tree_id, json(payload) j from raw_trees where json_valid(payload)),
s as (select tree_id, 'v1' tree_side, coalesce(nullif(json_extract(j, '$.tree.v1'), 'null'), case when json_type(j, '$.tree') = 'ARRAY' then json_extract(j, '$.tree') end) v from t
 union all select tree_id, 'v2', nullif(json_extract(j, '$.tree.v2'), 'null') from t),
l as (select tree_id, tree_side, '' parent_pos, case when json_type(v) = 'ARRAY' then cast(v as json[]) else [v] end e from s where v is not null),
n as (
 select tree_id, tree_side, parent_pos, unnest(range(1, len(f) + 1)) ord, unnest(f) node from (select *, list_filter(e, lambda x: x is not null and json_type(x) = 'OBJECT') f from l)
 union all
 select tree_id, tree_side, pos, unnest(range(1, len(f) + 1)), unnest(f) from (
  select tree_id, tree_side, pos, list_filter(case when json_type(c) = 'ARRAY' then cast(c as json[]) else [c] end, lambda x: x is not null and json_type(x) = 'OBJECT') f from (
   select tree_id, tree_side, case when parent_pos = '' then cast(ord as varchar) else parent_pos || '.' || ord end pos, json_extract(node, '$.children') c from n) where c is not null)),
m as (select *, case when parent_pos = '' then cast(ord as varchar) else parent_pos || '.' || ord end node_pos from n)
"""


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return nested.explode_tree(table(spark, d, "raw_trees"), "tree_id", "payload")


@R.add("p2_found", _NODES + "select tree_id, tree_side, node_pos, parent_pos from m")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).select("tree_id", "tree_side", "node_pos", "parent_pos")


@R.add("p2_nodes", _NODES + "select tree_id, tree_side, node_pos, parent_pos, ord ordinal, json_extract_string(node, '$.label') as \"label\", json_extract_string(node, '$.level') as \"level\", json_extract_string(node, '$.source.division_label') division_label from m")
def p2_nodes(spark: SparkSession, d: str) -> DataFrame:
    rows = nested.node_table(_nodes(spark, d), "tree_id")
    return rows.select("tree_id", "tree_side", "node_pos", "parent_pos", F.col("ordinal").cast("bigint").alias("ordinal"), "label", "level", "division_label")


@R.add("p2_amounts", _NODES + "select tree_id, tree_side, node_pos, generate_subscripts(a, 1) amount_ord, cast(regexp_replace(json_extract_string(unnest(a), '$'), '[$, ]', '', 'g') as bigint) amount from (select *, cast(json_extract(node, '$.own_amounts') as json[]) a from m where json_type(node, '$.own_amounts') = 'ARRAY')")
def p2_amounts(spark: SparkSession, d: str) -> DataFrame:
    return nested.amount_table(_nodes(spark, d), "tree_id").select("tree_id", "tree_side", "node_pos", F.col("amount_ord").cast("bigint").alias("amount_ord"), "amount")


@R.add("p2_schema")
def p2_schema(spark: SparkSession, d: str) -> DataFrame:
    return nested.merged_schema(table(spark, d, "raw_trees"), "payload")


_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_LOW = lambda c: f"lower(trim(regexp_replace({c}, '{_WS}', ' ', 'g')))"
_P5 = rf"""with lab as (select bill_id, version_label, max(version_no) v from bill_versions where version_no is not null group by all),
n as (select n.bill_id, coalesce(n.version_no, lab.v) ver, case when contains(coalesce(division_label, ''), ':') then {_LOW("regexp_replace(division_label, '(?s)^[^:]*:', '')")} else '' end division_title,
  coalesce(array_to_string(list_transform(match_path, lambda x: {_LOW("coalesce(x, '')")}), ' > '), '') path_text,
  regexp_replace(coalesce(body_text, ''), '{_WS}', '', 'g') b, regexp_replace(coalesce(header_text, ''), '{_WS}', '', 'g') h, loaded_at, node_id
 from bill_nodes n left join lab on n.bill_id = lab.bill_id and n.version_label = lab.version_label),
r as (select bill_id, ver, division_title, path_text, b, h from (select *, row_number() over (partition by bill_id, ver, division_title, path_text order by loaded_at desc nulls last, node_id desc) k from n where ver is not null and bill_id is not null) where k = 1),
p as (select bill_id, ver o, lead(ver) over (partition by bill_id order by ver) w from (select distinct bill_id, ver from r)),
old as (select p.bill_id, o, w, division_title, path_text, b, h from p join r on r.bill_id = p.bill_id and r.ver = o where w is not null),
new as (select p.bill_id, o, w, division_title, path_text, b, h from p join r on r.bill_id = p.bill_id and r.ver = w where w is not null)
select coalesce(old.bill_id, new.bill_id) bill_id, coalesce(old.o, new.o) version_old, coalesce(old.w, new.w) version_new, coalesce(old.division_title, new.division_title) division_title, coalesce(old.path_text, new.path_text) path_text,
 case when old.bill_id is null then 'added' when new.bill_id is null then 'removed' else 'changed' end change_type
from old full join new on old.bill_id = new.bill_id and old.o = new.o and old.division_title = new.division_title and old.path_text = new.path_text
where old.bill_id is null or new.bill_id is null or old.b <> new.b or old.h <> new.h"""


@R.add("p5_found", _P5)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    rows = snapshots.node_rows(table(spark, d, "bill_nodes"), table(spark, d, "bill_versions"))
    return snapshots.snapshot_diff(rows, "bill_id", "version", ["division_title", "path_text"], "content", ["loaded_at", "node_id"])


@R.add("p5_summary", f"with f as ({_P5}) select bill_id, version_old, version_new, count(*) filter (change_type = 'added') n_added, count(*) filter (change_type = 'removed') n_removed, count(*) filter (change_type = 'changed') n_changed from f group by all")
def p5_summary(spark: SparkSession, d: str) -> DataFrame:
    n = lambda k: F.count_if(F.col("change_type") == k).alias(f"n_{k}")
    return p5_found(spark, d).groupBy("bill_id", "version_old", "version_new").agg(n("added"), n("removed"), n("changed"))
