"""Queries of what is delivered: bill XML's head and body, status files and archives, the index, ground truth, uploads.

Files are made from the tables, written or packed, and read back, so what must come out is known from the tables.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexdelta.plans.registry import Registry
from lexdelta.session import shared_dir
from lexdelta.sources import index as I
from lexdelta.sources import xml_bills
from lexdelta.sources.tables import table

R = Registry()


def _escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _tag(name: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), *parts, F.lit(f"</{name}>"))


# --- bill XML -------------------------------------------------------------------------------------


def version_xml(spark: SparkSession, d: str) -> DataFrame:
    """(path, content): a short bill a delivered version; every third is an amendment document, every seventh has no body."""
    v = table(spark, d, "bill_versions")
    title = F.coalesce("official_title", F.lit(""))
    kind = F.when(F.lower("bill_type") == "s", F.lit("S. ")).otherwise(F.lit("H. R. "))
    form = _tag("form", _tag("congress", F.col("congress").cast("string"), F.lit("th CONGRESS")), _tag("legis-num", kind, F.col("bill_number").cast("string")), _tag("official-title", _escape(title)))
    body = _tag("legis-body", F.lit('<section id="x1"><enum>1.</enum><text>Text of '), F.col("version_id").cast("string"), F.lit(".</text></section>"))
    block = F.concat(F.lit("<engrossed-amendment-body><amendment><amendment-block>"), body, F.lit("</amendment-block></amendment></engrossed-amendment-body>"))
    content = F.when(F.col("version_id") % 7 == 0, _tag("bill", form)).when(F.col("version_id") % 3 == 0, _tag("amendment-doc", form, block)).otherwise(_tag("bill", form, body))
    return v.select(F.concat(F.lit("in/"), F.col("version_id").cast("string"), F.lit("_"), F.coalesce("version_label", F.lit("")), F.lit(".xml")).alias("path"), content.alias("content"))


_KIND = "case when lower(bill_type) = 's' then 's' else 'hr' end"
_TITLE = "regexp_replace(trim(regexp_replace(coalesce(official_title, ''), '\\s+', ' ', 'g')), ' (\\((?:[0-9]{1,2}|[a-z]{1,4}|[A-Z])\\))', '\\1', 'g')"


@R.add("bill_heads", f"select distinct 'in/' || version_id || '_' || coalesce(version_label, '') || '.xml' doc_id, congress, {_KIND} bill_type, bill_number, coalesce(version_label, '') version_label, {_TITLE} official_title from bill_versions where version_id % 7 <> 0")
def bill_heads(spark: SparkSession, d: str) -> DataFrame:
    """Congress, type, number, label and title read from documents."""
    n = xml_bills.parse_documents(version_xml(spark, d)).where("error is null")
    return n.select("doc_id", "congress", "bill_type", "bill_number", "version_label", "official_title").distinct()


@R.add("bill_fronts", f"""with b as (select 'in/' || version_id || '_' || coalesce(version_label, '') || '.xml' doc_id, version_id, congress, {_KIND} k, bill_number, {_TITLE} t from bill_versions where version_id % 7 <> 0),
n as (select doc_id, 1 o, 'front matter > masthead' path_text, congress || 'th CONGRESS' || chr(10) || case k when 's' then 'S. ' else 'H. R. ' end || bill_number body_text from b union all select doc_id, 2, 'front matter > official title', t from b where t <> ''
 union all select doc_id, 3, 'front matter > enacting clause', 'Be it enacted by the Senate and House of Representatives of the United States of America in Congress assembled,' from b union all select doc_id, 4, 'sec. 1', 'Text of ' || version_id || '.' from b)
select doc_id, cast(row_number() over (partition by doc_id order by o) - 1 as int) node_ord, path_text, body_text from n""")
def bill_fronts(spark: SparkSession, d: str) -> DataFrame:
    """Masthead, official title and enacting clause before the body, in bills and in amendment documents."""
    n = xml_bills.parse_documents(version_xml(spark, d)).where("error is null")
    return n.select("doc_id", "node_ord", F.array_join("match_path", " > ").alias("path_text"), "body_text")


@R.add("bill_errors", "select 'in/' || version_id || '_' || coalesce(version_label, '') || '.xml' doc_id, 'ValueError: no body in the document' error from bill_versions where version_id % 7 = 0")
def bill_errors(spark: SparkSession, d: str) -> DataFrame:
    """The dead letters: documents without a body."""
    return xml_bills.errors(xml_bills.parse_documents(version_xml(spark, d)))


@R.add("display_ladders", "select node_id, '(a) ' || trim(regexp_replace(coalesce(body_text, ''), '[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) || chr(10) || '    (1) Of which ' || node_id || '.' shown from bill_nodes where regexp_matches(body_text, '[^\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]')")
def display_ladders(spark: SparkSession, d: str) -> DataFrame:
    """Readable text of nested levels: a level a line, indented by depth."""
    sub = F.concat(F.lit("<subsection><enum>(a)</enum><text>"), _escape(F.col("body_text")), F.lit("</text><paragraph><enum>(1)</enum><text>Of which "), F.col("node_id").cast("string"), F.lit(".</text></paragraph></subsection>"))
    x = F.concat(F.lit("<bill><legis-body><section><enum>1.</enum>"), sub, F.lit("</section></legis-body></bill>"))
    docs = table(spark, d, "bill_nodes").where(F.col("body_text").rlike(r"[^\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")).select(F.col("node_id").cast("string").alias("path"), x.alias("content"))
    return xml_bills.parse_documents(docs).where("error is null").select(F.col("doc_id").cast("bigint").alias("node_id"), F.col("display_text").alias("shown"))


# --- status files and the index -------------------------------------------------------------------


def status_xml(spark: SparkSession, d: str) -> DataFrame:
    """(version_id, name, content): a bulk status document a delivered version."""
    v = table(spark, d, "bill_versions")
    items = lambda n: F.repeat(F.lit("<item><x/></item>"), n.cast("int"))
    n = F.col("version_id")
    body = _tag(
        "bill", _tag("congress", F.col("congress").cast("string")), _tag("type", F.upper("bill_type")), _tag("number", F.col("bill_number").cast("string")), _tag("title", _escape(F.coalesce("official_title", F.lit("")))),
        _tag("introducedDate", F.date_format("delivered_at", "yyyy-MM-dd")), _tag("latestAction", _tag("actionDate", F.date_format(F.date_add(F.to_date("delivered_at"), (n % 40).cast("int")), "yyyy-MM-dd")), _tag("text", F.lit("Became law"))),
        _tag("policyArea", _tag("name", F.lit("Ferries"))), _tag("actions", items(n % 4)), _tag("summaries", _tag("summary", _tag("text", F.repeat(F.lit("s"), (n % 9).cast("int"))))), _tag("textVersions", items(n % 3)), _tag("sponsors", items(F.lit(1))),
    )
    name = F.concat(F.lit("BILLSTATUS-"), F.col("congress").cast("string"), F.lower("bill_type"), F.col("bill_number").cast("string"), F.lit(".xml"))
    return v.select("version_id", name.alias("name"), _tag("billStatus", body).alias("content"))


_STATUS = """select congress || '-' || lower(bill_type) || '-' || bill_number id, nullif(trim(official_title), '') title, strftime(delivered_at, '%Y-%m-%d') "introducedDate", cast(version_id % 40 as int) "daysActive", cast(version_id % 4 as int) "actionCount", cast(version_id % 9 as int) "summaryLength", cast(version_id % 3 as int) "versionCount", 1 "sponsorCount" from bill_versions"""


@R.add("status_records", _STATUS)
def status_records(spark: SparkSession, d: str) -> DataFrame:
    """Index records read from status documents."""
    return I.status_records(status_xml(spark, d)).select("id", "title", "introducedDate", "daysActive", "actionCount", "summaryLength", "versionCount", "sponsorCount")


def _zipped(docs: DataFrame) -> DataFrame:
    """(path, content): the documents packed, an archive a congress; and a broken one."""
    import io
    import zipfile

    import pandas as pd

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, text in zip(pdf["name"], pdf["content"]):
                z.writestr(name, text)
        return pd.DataFrame({"path": [pdf["archive"].iloc[0]], "content": [out.getvalue()]})

    made = docs.groupBy("archive").applyInPandas(pack, "path string, content binary")
    broken = docs.sparkSession.createDataFrame([("broken.zip", b"no archive")], made.schema)
    return made.unionByName(broken)


@R.add("unzipped_members", "select 'c' || congress || '.zip' archive, version_id || '.xml' \"name\", true is_whole from bill_versions union all select 'broken.zip', null, false")
def unzipped_members(spark: SparkSession, d: str) -> DataFrame:
    """Members of ZIP archives; a broken archive is one row that says so."""
    v = table(spark, d, "bill_versions").select("version_id", F.concat(F.lit("c"), F.col("congress").cast("string"), F.lit(".zip")).alias("archive"))
    docs = status_xml(spark, d).drop("name").join(v, "version_id").withColumn("name", F.concat(F.col("version_id").cast("string"), F.lit(".xml")))
    m = I.unzip(_zipped(docs))
    return m.select("archive", "name", (F.col("error").isNull() & F.col("content").startswith("<billStatus>") & F.col("content").endswith("</billStatus>")).alias("is_whole"))


@R.add("ingested_index", """with b as (select congress || '-' || lower(bill_type) || '-' || bill_number id, max(version_id) v from bill_versions group by 1), k as (select id, row_number() over (order by id) n from b)
select b.id, case when n % 2 = 0 then 'old' else coalesce(nullif(trim(official_title), ''), '') end title, case when n % 2 = 0 then '' else '1' end "sponsorCount" from b join k using (id) join bill_versions on version_id = v""")
def ingested_index(spark: SparkSession, d: str) -> DataFrame:
    """Status members put into an index that knows every second bill already; known ones are skipped before they are parsed."""
    from pyspark.sql import Window

    s = status_xml(spark, d)
    last = s.groupBy("name").agg(F.max_by("content", "version_id").alias("content"))
    ids = table(spark, d, "bill_versions").select(F.concat_ws("-", F.col("congress").cast("string"), F.lower("bill_type"), F.col("bill_number").cast("string")).alias("id")).distinct()
    known = ids.withColumn("n", F.row_number().over(Window.orderBy("id"))).where("n % 2 = 0").select("id", F.lit("old").alias("title"))
    return I.ingest(known, last, "skip").select("id", "title", "sponsorCount")


def _scratch(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"lexdelta-{name}-{uuid.uuid4().hex}")


@R.add("index_round_trip", "select cast(version_id as varchar) id, coalesce(official_title, '') title, coalesce(bill_id, '') bill_id, try_cast(bill_number as bigint) \"number\" from bill_versions")
def index_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The index written as CSV and read back: quotes, line ends and empty values stay, numbers are told by their look."""
    path = _scratch(spark, "csv")
    v = table(spark, d, "bill_versions").select(F.col("version_id").alias("id"), F.col("official_title").alias("title"), "bill_id", F.col("bill_number").alias("number"))
    I.write_csv(v, path)
    return I.read_csv(spark, path).withColumn("number", I.as_number(F.col("number"))).select("id", "title", "bill_id", "number")


@R.add("ground_truth", "select bill, version, fy, chamber, title, bureau, excel_name, array_to_string(match_path, ' > ') path_text, expected_amount from validation_defense")
def ground_truth(spark: SparkSession, d: str) -> DataFrame:
    """Ground-truth accounts written as one file a bill and read back."""
    path = _scratch(spark, "truth")
    v = table(spark, d, "validation_defense")
    accounts = F.collect_list(F.struct("bill", "version", "fy", "chamber", "title", "bureau", "excel_name", "match_path", "expected_amount"))
    v.groupBy("bill").agg(accounts.alias("accounts")).select(F.to_json(F.struct(F.lit("made").alias("source"), F.lit("").alias("note"), "accounts")).alias("value"), F.col("bill").alias("of")).write.partitionBy("of").text(path)
    return I.read_ground_truth(spark, path).select("bill", "version", "fy", "chamber", "title", "bureau", "excel_name", F.array_join("match_path", " > ").alias("path_text"), "expected_amount")


@R.add("upload_checks", """with f as (select doc_id, case doc_id % 4 when 0 then '%PDF-1.7 ' || "text" when 1 then chr(10) || '<bill>' || "text" when 2 then "text" else '<x>' end c from documents where "text" is not null)
select doc_id, case when starts_with(c, '%PDF-') then 'pdf' when starts_with(ltrim(c, chr(10) || ' '), '<') then 'xml' end kind, case when octet_length(encode(c)) > 900 then 'too large' when not (starts_with(c, '%PDF-') or starts_with(ltrim(c, chr(10) || ' '), '<')) then 'unknown kind' end error from f""")
def upload_checks(spark: SparkSession, d: str) -> DataFrame:
    """Uploads told by their first bytes and size."""
    k = F.col("doc_id") % 4
    c = F.when(k == 0, F.concat(F.lit("%PDF-1.7 "), "text")).when(k == 1, F.concat(F.lit("\n<bill>"), "text")).when(k == 2, F.col("text")).otherwise("<x>")
    f = table(spark, d, "documents").where("text is not null").select("doc_id", F.encode(c, "UTF-8").alias("content")).withColumn("length", F.length("content"))
    return I.valid_uploads(f, 900).select("doc_id", "kind", "error")


# --- reports --------------------------------------------------------------------------------------


def printed_statement(spark: SparkSession, d: str) -> DataFrame:
    """(report_id, line_no, line): the comparative statement of each report printed from its rows, a title and a bureau where they change."""
    from pyspark.sql import Window

    w = Window.partitionBy("report_pkg").orderBy("line_no", "row_id")
    c = table(spark, d, "comparative_rows").where("report_pkg is not null and item is not null and cells_text is not null").withColumn("n", F.row_number().over(w))
    item = F.regexp_replace("item", r"[.\s]+$", "")
    rows = c.where(item != "").select(F.col("report_pkg").alias("report_id"), (F.col("n") * 2).alias("line_no"), F.concat(F.lit("  "), item, F.lit("........  "), "cells_text").alias("line"))
    head = c.select(F.col("report_pkg").alias("report_id")).distinct().select("report_id", F.lit(0).alias("line_no"), F.lit("COMPARATIVE STATEMENT OF NEW BUDGET (OBLIGATIONAL) AUTHORITY").alias("line"))
    return rows.unionByName(head)


@R.add("statement_rows", r"""with c as (select report_pkg, regexp_replace(item, '[.\s]+$', '') item, cells_text, 2 * row_number() over (partition by report_pkg order by line_no, row_id) line_no from comparative_rows where report_pkg is not null and item is not null and cells_text is not null),
t as (select *, list_filter(regexp_split_to_array(cells_text, '\s+'), lambda x: x <> '')[3] x from c where item <> '' and regexp_matches(cells_text, '\d'))
select report_pkg report_id, cast(line_no as int) line_no, trim(item) item, case when x like '-%' then -1 else 1 end * cast(regexp_replace(x, '[^\d]', '', 'g') as bigint) committee_recommendation_thousands from t where regexp_matches(x, '^[+\-]?\(?-?[\d,]+\)?$') and not x like '(%' and regexp_matches(x, '\d')""")
def statement_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of printed comparative statements: item and third column."""
    from lexdelta.sources import reports

    return reports.comparative_rows(printed_statement(spark, d)).select("report_id", "line_no", "item", "committee_recommendation_thousands")
