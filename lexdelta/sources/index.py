"""The bill metadata index: CSV in and out, look-ups, upserts, column changes, and the bulk status files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The columns the bulk ingest writes.
STATUS_COLUMNS = (
    "id", "title", "introducedDate", "lastActionDate", "daysActive", "status", "policyArea", "historySize",
    "summaryLength", "actionCount", "versionCount", "budgetEstimateCount", "amendmentCount", "relatedBillsCount", "committeeCount", "sponsorCount",
)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The index as strings, absent values ``""``; without a column ``id`` it is no index."""
    df = spark.read.option("header", "true").option("quote", '"').option("escape", '"').option("multiLine", "true").option("inferSchema", "false").csv(path)
    if "id" not in df.columns:
        raise ValueError("the index has no column 'id'")
    return df.na.fill("")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select(*(F.col(c).cast("string").alias(c) for c in df.columns)).write.mode(mode).option("header", "true").option("quote", '"').option("escape", '"').csv(path)


def as_number(c: Column) -> Column:
    """What looks like an integer as one, else NULL."""
    return F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c).try_cast("bigint"))


def new_records(index: DataFrame, batch: DataFrame) -> DataFrame:
    return batch.join(index.select("id").distinct(), "id", "left_anti")


def known_records(index: DataFrame, batch: DataFrame) -> DataFrame:
    return batch.join(index.select("id").distinct(), "id", "left_semi")


def by_prefix(index: DataFrame, congress: int, bill_type: str | None = None, number: int | None = None) -> DataFrame:
    """Ids that *begin* with the prefix: ``119-hr-1`` finds ``119-hr-10`` too."""
    parts = [str(congress), *([bill_type] if bill_type is not None else []), *([str(number)] if bill_type is not None and number is not None else [])]
    return index.where(F.col("id").startswith("-".join(parts)))


def by_id(index: DataFrame, congress: int, bill_type: str, number: int) -> DataFrame:
    return index.where(F.col("id") == f"{congress}-{bill_type}-{number}")


def upsert(index: DataFrame, batch: DataFrame, mode: str = "merge", order: str | None = None) -> DataFrame:
    """``batch`` put into ``index`` by ``id``: ``skip`` keeps known records, ``merge`` overwrites the batch's columns in them.

    Columns that are new to one side are ``""`` there; the batch's columns come first. A record without id stops it.
    Merging overwrites with empty values too. Of several records of a known id the last counts, by ``order`` or as read;
    several of a new id are all put in. One window over the batch and one full outer join, both on ``id``.
    """
    if mode not in ("skip", "merge"):
        raise ValueError("mode is 'skip' or 'merge'")
    at = F.col(order) if order else F.monotonically_increasing_id()
    b = batch.select(*(F.col(c).cast("string").alias(c) for c in batch.columns), at.alias("_at")).withColumn("id", F.when(F.coalesce("id", F.lit("")) == "", F.raise_error(F.lit("a record has no id"))).otherwise(F.col("id")))
    b = b.withColumn("_from_last", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("_at")))).drop("_at")
    i = index.select(*(F.col(c).cast("string").alias(c) for c in index.columns))
    columns = [*batch.columns, *(c for c in index.columns if c not in batch.columns)]
    j = i.alias("i").join(b.alias("b"), F.col("i.id") == F.col("b.id"), "full")
    known = F.col("i.id").isNotNull()
    j = j.where(~known | F.coalesce(F.col("b._from_last") == 1, F.lit(True)))

    def pick(c: str) -> Column:
        old = F.coalesce(F.col(f"i.{c}"), F.lit("")) if c in i.columns else F.lit("")
        if c not in b.columns:
            return old.alias(c)
        new = F.coalesce(F.col(f"b.{c}"), F.lit(""))
        stays = F.col("b.id").isNull() | (known & F.lit(mode == "skip"))
        return F.when(stays, old).otherwise(new).alias(c)

    return j.select(*map(pick, columns))


def rename(index: DataFrame, renames: dict[str, str]) -> DataFrame:
    """Columns renamed; a value already under the new name stays unless it is empty."""
    for old, new in renames.items():
        if old in index.columns:
            have = F.nullif(F.col(new), F.lit("")) if new in index.columns else F.lit(None).cast("string")
            index = index.withColumn(new, F.coalesce(have, F.col(old), F.lit(""))).drop(old)
    return index


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def version_order(versions: DataFrame) -> DataFrame:
    """Adds ``chrono``: versions of a bill by date, those without one last, then by type."""
    w = Window.partitionBy("bill_id")
    date = F.coalesce("date", F.max("date").over(w))
    return versions.withColumn("_d", date).withColumn("chrono", F.row_number().over(w.orderBy("_d", "type"))).drop("_d")


def adjacent_versions(versions: DataFrame) -> DataFrame:
    """(bill_id, version_old, version_new) of neighbouring version numbers."""
    w = Window.partitionBy("bill_id").orderBy("version_no")
    return versions.select("bill_id", "version_no").distinct().select("bill_id", F.col("version_no").alias("version_old"), F.lead("version_no").over(w).alias("version_new")).where("version_new is not null")


def tasks(spark: SparkSession, first: int, last: int, types: list[str]) -> DataFrame:
    """(congress, bill_type), newest congress first: what a bulk ingest goes through."""
    c = spark.range(first, last + 1).select(F.col("id").cast("int").alias("congress"))
    return c.select("congress", F.explode(F.array(*map(F.lit, types))).alias("bill_type")).orderBy(F.desc("congress"), "bill_type")


def status_records(docs: DataFrame, content: str = "content") -> DataFrame:
    """The sixteen index columns of bulk status documents (STRING ``content``), read with XPath in the JVM."""
    x = lambda p: F.nullif(F.trim(F.xpath_string(content, F.lit(p))), F.lit(""))
    n = lambda p: F.xpath_number(content, F.lit(f"count({p})")).cast("int")
    begin, latest = F.to_date(x("//bill/introducedDate")).alias("b"), F.to_date(x("//bill/latestAction/actionDate")).alias("l")
    number = F.coalesce(x("//bill/number"), x("//bill/billNumber"))
    kind = F.lower(F.coalesce(x("//bill/type"), x("//bill/billType")))
    return docs.select(
        F.concat_ws("-", x("//bill/congress"), kind, number).alias("id"), x("//bill/title").alias("title"), x("//bill/introducedDate").alias("introducedDate"), x("//bill/latestAction/actionDate").alias("lastActionDate"),
        F.datediff(latest, begin).alias("daysActive"), x("//bill/latestAction/text").alias("status"), x("//bill/policyArea/name").alias("policyArea"), n("//bill/actions/item").alias("historySize"),
        F.length(F.coalesce(x("//bill/summaries/summary[1]/text"), x("//bill/summaries/billSummaries/item[1]/text"), F.lit(""))).alias("summaryLength"), n("//bill/actions/item").alias("actionCount"), n("//bill/textVersions/item").alias("versionCount"),
        n("//bill/cboCostEstimates/item").alias("budgetEstimateCount"), n("//bill/amendments/amendment").alias("amendmentCount"), n("//bill/relatedBills/item").alias("relatedBillsCount"), n("//bill/committees/item").alias("committeeCount"), n("//bill/sponsors/item").alias("sponsorCount"),
    )


def unzip(archives: DataFrame) -> DataFrame:
    """(archive, name, content STRING) of the members of ZIP archives (path, content BINARY), one archive at a time; broken ones give an ``error`` row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, data in zip(b["path"], b["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                        for name in z.namelist():
                            if not name.endswith("/"):
                                yield pd.DataFrame({"archive": [path], "name": [name], "content": [z.read(name).decode("utf-8", "replace")], "error": [None]})
                except (zipfile.BadZipFile, TypeError) as e:
                    yield pd.DataFrame({"archive": [path], "name": [None], "content": [None], "error": [str(e)]})

    return archives.select("path", "content").mapInPandas(run, "archive string, name string, content string, error string")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return unzip(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path))


def ingest(index: DataFrame, members: DataFrame, mode: str = "merge") -> DataFrame:
    """Archive members into the index; with ``skip`` known bills are left out before anything is parsed."""
    ident = F.regexp_extract("name", r"(\d+)([a-z]+)(\d+)\.xml$", 0)
    m = members.where("content is not null").withColumn("id", F.regexp_replace(F.regexp_replace(ident, r"\.xml$", ""), r"^(\d+)([a-z]+)(\d+)$", "$1-$2-$3"))
    if mode == "skip":
        m = m.join(index.select("id").distinct(), "id", "left_anti")
    return upsert(index, status_records(m), mode)


def valid_uploads(files: DataFrame, most: int = 150 * 1024 * 1024) -> DataFrame:
    """Adds ``kind`` (xml, pdf) and ``error`` to files (path, length, content): too large, or neither kind by its first bytes."""
    head = F.decode(F.substring("content", 1, 64), "ISO-8859-1")
    kind = F.when(head.startswith("%PDF-"), "pdf").when(F.regexp_replace(head, r"^(?:ï»¿)?\s*", "").startswith("<"), "xml")
    return files.withColumn("kind", kind).withColumn("error", F.when(F.col("length") > most, "too large").when(F.col("kind").isNull(), "unknown kind"))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Accounts of ground-truth files ``{source, note, accounts[]}``."""
    schema = "source string, note string, accounts array<struct<bill:string,version:string,fy:string,chamber:string,title:string,bureau:string,excel_name:string,match_path:array<string>,expected_amount:bigint>>"
    raw = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    return raw.select("source", F.explode("accounts").alias("a")).select("source", "a.*")
