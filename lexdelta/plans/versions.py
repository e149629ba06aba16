"""Queries of the comparison itself, over each two neighbouring versions of every bill in ``bill_nodes``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexdelta.operators import compare as C
from lexdelta.operators.snapshots import resolve_versions
from lexdelta.plans.registry import Registry
from lexdelta.session import cut
from lexdelta.sources.tables import table

R = Registry()

#: Nodes of every version, a node once a version: the one loaded last; as documents; as sides of two neighbouring versions.
LAST_SQL = r"""lab as (select bill_id, version_label, max(version_no) v from bill_versions where version_no is not null group by all),
vn as (select n.*, coalesce(n.version_no, lab.v) ver from bill_nodes n left join lab on n.bill_id = lab.bill_id and n.version_label = lab.version_label),
last as (select * from (select *, row_number() over (partition by bill_id, ver, node_ord order by loaded_at desc nulls last, node_id desc) k from vn where ver is not null) where k = 1)
"""
DOCS_SQL = LAST_SQL + ", docs as (select *, bill_id || ':' || ver doc_id from last)"
SIDES_SQL = LAST_SQL + """, st as (select * from (select bill_id, ver o, lead(ver) over (partition by bill_id order by ver) w from (select distinct bill_id, ver from vn where ver is not null and bill_id is not null)) where w is not null),
sides as (select st.bill_id || ':' || o || '-' || w pair_id, 'old' side, last.* from last join st on last.bill_id = st.bill_id and ver = o union all select st.bill_id || ':' || o || '-' || w, 'new', last.* from last join st on last.bill_id = st.bill_id and ver = w)
"""


KEEP = ["match_path", "display_path", "element_id", "body_text", "section_number", "division_label"]
SHOWN = ["tag", "header_text", "display_text"]


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A written table of keys, broadcast up to ``most`` rows; beyond that it is joined by shuffling."""
    return F.broadcast(df) if df.count() <= most else df


def resolved(spark: SparkSession, d: str) -> DataFrame:
    return resolve_versions(table(spark, d, "bill_nodes"), table(spark, d, "bill_versions"))


def latest_nodes(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Nodes of every version of each bill, a node once a version: the one loaded last."""
    lean = resolved(spark, d).select("bill_id", "version", "node_ord", "loaded_at", "node_id")
    w = Window.partitionBy("bill_id", "version", "node_ord").orderBy(F.desc("loaded_at"), F.desc("node_id"))
    # few rows are replaced by later loads: their ids are found on keys alone, and the texts are not shuffled
    replaced = small(cut(lean.withColumn("_rn", F.row_number().over(w)).where("_rn > 1").select("node_id"), "replaced"))
    rows = resolved(spark, d).join(replaced, "node_id", "left_anti")
    return rows.select("bill_id", "version", "node_ord", *KEEP, *SHOWN, *more)


def bill_docs(spark: SparkSession, d: str) -> DataFrame:
    """``latest_nodes`` as documents: a version of a bill each, ``doc_id`` being the bill and its version."""
    return latest_nodes(spark, d).withColumn("doc_id", F.concat_ws(":", "bill_id", "version"))


def steps(spark: SparkSession, d: str) -> DataFrame:
    """(pair_id, bill_id, old, new): each two neighbouring versions that a bill has nodes of, gaps in the numbers or not."""
    v = resolved(spark, d).where("bill_id is not null").select("bill_id", F.col("version").alias("old")).distinct()
    v = v.withColumn("new", F.lead("old").over(Window.partitionBy("bill_id").orderBy("old"))).where("new is not null")
    return v.select(F.concat("bill_id", F.lit(":"), "old", F.lit("-"), "new").alias("pair_id"), "bill_id", "old", "new")


def sides(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Nodes of each two neighbouring versions of each bill as the sides of one comparison."""
    side = lambda s: F.struct(F.col(s).alias("version"), F.lit(s).alias("side"))
    each = small(cut(steps(spark, d).select("pair_id", "bill_id", F.inline(F.array(side("old"), side("new")))), "steps"))
    return latest_nodes(spark, d, *more).join(each, ["bill_id", "version"]).select("pair_id", "side", "node_ord", *KEEP, *more)


@R.add("compare_changes")
def compare_changes(spark: SparkSession, d: str) -> DataFrame:
    """Every change between neighbouring versions of every bill: matched, classified, moves found."""
    return C.compare(sides(spark, d)).select("pair_id", "change_no", "change_type", F.array_join("match_path", " > ").alias("path_text"), "old_text", "new_text", "section_number", "element_id_old", "element_id_new", F.array_join("text_diff", "\n").alias("diff"))


@R.add("compare_summary")
def compare_summary(spark: SparkSession, d: str) -> DataFrame:
    return C.summary(C.compare(sides(spark, d)))


@R.add("compare_money")
def compare_money(spark: SparkSession, d: str) -> DataFrame:
    """The money table of every comparison."""
    return C.money_rows(C.with_money(C.compare(sides(spark, d))))


@R.add("compare_filter")
def compare_filter(spark: SparkSession, d: str) -> DataFrame:
    """Changes of money in sections."""
    return C.filter_changes(C.compare(sides(spark, d)), needle="SEC.", financial=True).select("pair_id", "change_no", "change_type")


@R.add("move_candidates")
def move_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = C.move_candidates(cut(C.classify(C.match_nodes(sides(spark, d))), "changes"))
    return c.select("pair_id", F.to_json("ro").alias("removed_ord"), F.to_json("ao").alias("added_ord"), F.round("sim", 9).alias("sim"))


@R.add("full_outer_match", "with " + SIDES_SQL + """, g as (select pair_id, match_path, count(*) filter (side = 'old') n_old, count(*) filter (side = 'new') n_new from sides group by all)
select pair_id, array_to_string(match_path, ' > ') path_text, n_old, n_new, case when n_old > 1 or n_new > 1 then 'collision' when n_old = 0 then 'only_new' when n_new = 0 then 'only_old' else 'one_to_one' end outcome from g""")
def full_outer_match(spark: SparkSession, d: str) -> DataFrame:
    """How each path of two neighbouring versions matches."""
    old, new = F.count_if(F.col("side") == "old"), F.count_if(F.col("side") == "new")
    g = C.side_nodes(sides(spark, d)).groupBy("pair_id", "match_path").agg(old.alias("n_old"), new.alias("n_new"))
    kind = F.when((F.col("n_old") > 1) | (F.col("n_new") > 1), "collision").when(F.col("n_old") == 0, "only_new").when(F.col("n_new") == 0, "only_old").otherwise("one_to_one")
    return g.select("pair_id", F.array_join("match_path", " > ").alias("path_text"), "n_old", "n_new", kind.alias("outcome"))


_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _norm(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{_WS}', ' ', 'g'))"


@R.add("one_to_one_status", "with " + SIDES_SQL + f""", g as (select pair_id, match_path, max(case when side = 'old' then {_norm('body_text')} end) o, max(case when side = 'new' then {_norm('body_text')} end) n from sides group by all having count(*) filter (side = 'old') = 1 and count(*) filter (side = 'new') = 1)
select pair_id, array_to_string(match_path, ' > ') path_text, o = n same, case when o <> n then '--- old' || chr(10) || '+++ new' || chr(10) || '@@ -' || case when o = '' then '0,0' else '1' end || ' +' || case when n = '' then '0,0' else '1' end || ' @@' || case when o = '' then '' else chr(10) || '-' || o end || case when n = '' then '' else chr(10) || '+' || n end else '' end diff from g""")
def one_to_one_status(spark: SparkSession, d: str) -> DataFrame:
    """Unified diffs of the paths both versions have once."""
    text = lambda side: F.max(F.when(F.col("side") == side, C.collapse("body_text")))
    n = lambda side: F.count_if(F.col("side") == side)
    g = C.side_nodes(sides(spark, d)).groupBy("pair_id", "match_path").agg(n("old").alias("a"), n("new").alias("b"), text("old").alias("o"), text("new").alias("n")).where("a = 1 and b = 1")
    return g.select("pair_id", F.array_join("match_path", " > ").alias("path_text"), (F.col("o") == F.col("n")).alias("same"), F.array_join(C.unified_diff(F.col("o"), F.col("n")), "\n").alias("diff"))
