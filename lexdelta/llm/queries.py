"""Queries of the text problems: look-alikes (3), near-duplicates (4), account matching (6), leakage (7), mixing (8), encodings (9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexdelta.llm import confusables, encodings, leakage, linkage, mixing, neardup
from lexdelta.operators.snapshots import resolve_versions
from lexdelta.plans.registry import Registry
from lexdelta.sources.tables import table

R = Registry()

_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
#: What is improper in a text, from the problem's words and Unicode's own classes. Raised letters and curly quotes are proper.
_ODD = (
    r"[\p{Cf}\x{34f}\x{115f}\x{1160}\x{3164}\x{fe00}-\x{fe0f}]|[\t\x0b\x0c\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"  # no width; blanks
    r"|[\x{300}-\x{36f}\x{1ab0}-\x{1aff}\x{1dc0}-\x{1dff}\x{20d0}-\x{20ff}\x{fe20}-\x{fe2f}]"  # accents apart
    r"|[\x{2100}-\x{2101}\x{2103}\x{2105}-\x{2107}\x{2109}-\x{2113}\x{2115}-\x{2116}\x{2119}-\x{211d}\x{2150}-\x{217f}\x{2460}-\x{24ea}\x{3250}-\x{33ff}\x{fb00}-\x{fb06}\x{ff01}-\x{ff9f}\x{ffe0}-\x{ffee}\x{1d400}-\x{1d7ff}\x{bc}-\x{be}\x{2026}\x{132}\x{133}\x{1c4}-\x{1cc}]"
    r"|\p{Latin}[\p{Greek}\p{Cyrillic}\p{Armenian}\p{Cherokee}]|[\p{Greek}\p{Cyrillic}\p{Armenian}\p{Cherokee}]\p{Latin}"  # letters of two scripts side by side
)
_P3 = " union all ".join(f"select '{t}' source_table, {k} row_key, '{f}' field_name from {t} where regexp_matches({f}, '{_ODD}')" for t, k, f in (("bill_nodes", "node_id", "body_text"), ("pdf_hunks", "hunk_id", "v1_text"), ("pdf_hunks", "hunk_id", "v2_text")))
_GRAMS = "list_distinct(list_transform(range(1, len(w) - {0}), lambda i: array_to_string(w[i:i + {1}], ' ')))"
_P4 = f"""with lab as (select bill_id, version_label, max(version_no) v from bill_versions where version_no is not null group by all),
t as (select 'body_text' field_name, node_id id, n.bill_id, {_WORDS.format("body_text")} w from bill_nodes n left join lab on n.bill_id = lab.bill_id and n.version_label = lab.version_label where coalesce(n.version_no, lab.v) = 1
 union all select 'old_text', change_id, bill_id, {_WORDS.format("old_text")} from node_changes where old_text is not null union all select 'new_text', change_id, bill_id, {_WORDS.format("new_text")} from node_changes where new_text is not null),
g as (select field_name, id, bill_id, {_GRAMS.format(1, 2)} s from t where len(w) >= 25), e as (select field_name, id, bill_id, len(s) n, unnest(s) x from g),
p as (select a.field_name, a.id id_a, b.id id_b, a.n na, b.n nb, count(*) c from e a join e b on a.field_name = b.field_name and a.x = b.x and a.id < b.id and a.bill_id <> b.bill_id group by all)
select field_name, id_a, id_b from p where cast(c as double) / (na + nb - c) >= 0.6"""
_P4_CLASSES = f"""with lab as (select bill_id, version_label, max(version_no) v from bill_versions where version_no is not null group by all),
t as (select 'body_text' field_name, node_id id, {_WORDS.format("body_text")} w from bill_nodes n left join lab on n.bill_id = lab.bill_id and n.version_label = lab.version_label where coalesce(n.version_no, lab.v) = 1 and body_text is not null
 union all select 'old_text', change_id, {_WORDS.format("old_text")} from node_changes where old_text is not null union all select 'new_text', change_id, {_WORDS.format("new_text")} from node_changes where new_text is not null),
c as (select field_name, id, min(id) over (partition by field_name, array_to_string(w, ' ')) rep, w from t where len(w) >= 25), e as (select field_name, id, len(s) n, unnest(s) x from (select field_name, id, {_GRAMS.format(1, 2)} s from c where id = rep)),
p as (select a.field_name, a.id id_a, b.id id_b, cast(count(*) as double) / (a.n + b.n - count(*)) sim from e a join e b on a.field_name = b.field_name and a.x = b.x and a.id < b.id group by a.field_name, a.id, b.id, a.n, b.n),
pairs as (select * from p where sim >= 0.6)
"""
_P7 = f"""with d as (select distinct doc_id, unnest({_GRAMS.format(16, 17)}) x from (select doc_id, {_WORDS.format('"text"')} w from documents where "text" is not null) where len(w) >= 18),
i as (select distinct item_id, unnest({_GRAMS.format(16, 17)}) x from (select item_id, {_WORDS.format('"text"')} w from eval_items where "text" is not null) where len(w) >= 18)
select distinct doc_id, item_id from d join i using (x)"""
# runs of matching 18-grams on one diagonal are one match
_AT = "select {0}, unnest(range(0, len(w) - 17)) p, unnest(list_transform(range(1, len(w) - 16), lambda i: array_to_string(w[i:i + 17], ' '))) x from (select {0}, {1} w from {2} where \"text\" is not null) where len(w) >= 18"
_P7_SPANS = f"""with d as ({_AT.format("doc_id", _WORDS.format('"text"'), "documents")}), i as ({_AT.format("item_id", _WORDS.format('"text"'), "eval_items")}),
m as (select doc_id, item_id, d.p, i.p q, d.p - row_number() over (partition by doc_id, item_id, d.p - i.p order by d.p) g from d join i using (x))
select doc_id, item_id, min(p) word_at, min(q) item_word_at, count(*) + 17 n_words from m group by doc_id, item_id, p - q, g"""


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """(source_table, row_key, field_name, text) of problem 3."""
    n = table(spark, d, "bill_nodes").select(F.lit("bill_nodes").alias("source_table"), F.col("node_id").alias("row_key"), F.lit("body_text").alias("field_name"), F.col("body_text").alias("text"))
    for f in ("v1_text", "v2_text"):
        n = n.unionByName(table(spark, d, "pdf_hunks").select(F.lit("pdf_hunks").alias("source_table"), F.col("hunk_id").alias("row_key"), F.lit(f).alias("field_name"), F.col(f).alias("text")))
    return n


@R.add("p3_found", _P3)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return confusables.improper(_texts(spark, d)).select("source_table", "row_key", "field_name")


@R.add("p3_clean")
def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    """The one form of each text that is not in it, and why."""
    return confusables.improper(_texts(spark, d)).select("source_table", "row_key", "field_name", "clean_text", "kinds")


@R.add("p3_groups")
def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return confusables.look_alike_groups(_texts(spark, d))


def first_version(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    nodes = table(spark, d, "bill_nodes").select("bill_id", "version_no", "version_label", *columns)
    return resolve_versions(nodes, table(spark, d, "bill_versions")).where("version = 1")


def _fields(spark: SparkSession, d: str) -> DataFrame:
    """(field, id, grp, text) of problem 4."""
    pick = lambda df, field, i: df.select(F.lit(field).alias("field"), F.col(i).alias("id"), F.col("bill_id").alias("grp"), F.col(field).alias("text"))
    changes = table(spark, d, "node_changes")
    return pick(first_version(spark, d, "node_id", "body_text"), "body_text", "node_id").unionByName(pick(changes, "old_text", "change_id")).unionByName(pick(changes, "new_text", "change_id"))


@R.add("p4_found", _P4)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.NearDuplicates(_fields(spark, d)).expanded().withColumnRenamed("field", "field_name")


@R.add("p4_pairs", _P4_CLASSES + "select field_name, id_a, id_b, round(sim, 6) similarity from pairs")
def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Near-duplicate representatives with their similarity."""
    found = neardup.NearDuplicates(_fields(spark, d))
    return found.pairs.select(F.col("field").alias("field_name"), F.col("a").alias("id_a"), F.col("b").alias("id_b"), F.round("similarity", 6).alias("similarity"))


@R.add("p4_members", _P4_CLASSES + "select c.field_name, c.id, rep class_id, (select count(*) from pairs where pairs.field_name = c.field_name and (id_a = rep or id_b = rep)) n_links from c")
def p4_members(spark: SparkSession, d: str) -> DataFrame:
    """Each text's class of exact copies and its number of near-duplicate classes."""
    found = neardup.NearDuplicates(_fields(spark, d))
    ends = found.pairs.select("field", F.explode(F.array("a", "b")).alias("rep")).groupBy("field", "rep").agg(F.count("*").alias("n_links"))
    return found.members.join(ends, ["field", "rep"], "left").select(F.col("field").alias("field_name"), "id", F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _links(spark: SparkSession, d: str) -> linkage.AccountLinks:
    nodes = first_version(spark, d, "node_id", "match_path", "header_text", "body_text")
    return linkage.AccountLinks(table(spark, d, "report_accounts"), nodes, table(spark, d, "validation_defense"))


@R.add("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).links().select("account_id", "other_table", "other_id")


@R.add("p6_links")
def p6_links(spark: SparkSession, d: str) -> DataFrame:
    """The matches with their confidence."""
    return _links(spark, d).links()


@R.add("p6_rules")
def p6_rules(spark: SparkSession, d: str) -> DataFrame:
    """What each rule resolved and its precision on labelled rows."""
    found = _links(spark, d)
    return found.all.groupBy("rule").agg(F.count("*").alias("n_resolved")).join(found.confidence(), "rule")


def _leaked(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


@R.add("p7_found", _P7)
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(_leaked(spark, d))


@R.add("p7_spans", _P7_SPANS)
def p7_spans(spark: SparkSession, d: str) -> DataFrame:
    """Every longest verbatim match of an item in a document, with its places and length."""
    return _leaked(spark, d)


@R.add("p7_clean", f"select doc_id, source from documents where doc_id is null or doc_id not in (select doc_id from ({_P7}))")
def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    """The corpus without the documents that hold leaked passages."""
    return leakage.without_leaks(table(spark, d, "documents"), _leaked(spark, d)).select("doc_id", "source")


def _mixture(spark: SparkSession, d: str) -> mixing.Mixture:
    return mixing.Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


@R.add("p8_mix")
def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixed documents, copy by copy, in shuffled order."""
    return _mixture(spark, d).mixed()


@R.add("p8_shares")
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of tokens of each source of each mix."""
    return _mixture(spark, d).shares()


def _mojibake(spark: SparkSession, d: str) -> encodings.Mojibake:
    return encodings.Mojibake(table(spark, d, "documents"))


@R.add("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _mojibake(spark, d).affected()


@R.add("p9_restored")
def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    """Affected documents with their text restored where that is possible."""
    return _mojibake(spark, d).restored()


@R.add("p9_words")
def p9_words(spark: SparkSession, d: str) -> DataFrame:
    """The garbled words of the corpus, their originals and the chain of encodings that made them."""
    return _mojibake(spark, d).garbled
