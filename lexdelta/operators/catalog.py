"""Surveys over archived changes: similarity classes, histograms, parity of producers, vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexdelta.functions.text import collapse, words


def similarity_class(sim: Column) -> Column:
    return F.when(sim < 0.4, "below").when(sim < 0.6, "between").otherwise("above")


def bag_similarity(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, bag, length_bound, jaccard, class) of two-sided pairs: the bag and length bounds of the word ratio, and the word sets' Jaccard index."""
    two = pairs.where(F.col(old).isNotNull() & F.col(new).isNotNull())
    w = two.select(key, F.explode(F.concat(F.transform(words(old), lambda x: F.struct(x.alias("w"), F.lit(1).alias("o"), F.lit(0).alias("n"))), F.transform(words(new), lambda x: F.struct(x.alias("w"), F.lit(0).alias("o"), F.lit(1).alias("n"))))).alias("x"))
    c = w.groupBy(key, F.col("x.w").alias("w")).agg(F.sum("x.o").alias("o"), F.sum("x.n").alias("n"))
    both = F.sum(F.col("o") + F.col("n"))
    out = c.groupBy(key).agg(
        F.round(2.0 * F.sum(F.least("o", "n")) / both, 9).alias("bag"), F.round(2.0 * F.least(F.sum("o"), F.sum("n")) / both, 9).alias("length_bound"),
        F.round(F.count_if((F.col("o") > 0) & (F.col("n") > 0)).cast("double") / F.count("*"), 9).alias("jaccard"),
    )
    return out.withColumn("class", similarity_class(F.col("bag")))


def edit_ratio(a: Column, b: Column, most: int | None = None) -> Column:
    """1 less the edit distance as a share of the longer text; 1 for equal texts, 0 where one is empty.

    Whole texts count; ``most`` cuts both to so many characters, as surveys of very long texts may want.
    """
    x, y = (a, b) if most is None else (F.substring(a, 1, most), F.substring(b, 1, most))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))


def token_jaccard(a: Column, b: Column) -> Column:
    """The Jaccard index of the lower-cased word sets; 1 where both are empty."""
    x, y = (F.array_distinct(words(F.lower(c))) for c in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def rewrite_candidates(changes: DataFrame, longer_than: int = 50) -> DataFrame:
    """(removed_id, added_id): removed and added texts of one bill and path, both longer than 50 characters."""
    side = lambda kind, c, i: changes.where((F.col("change_type") == kind) & (F.length(collapse(c)) > longer_than)).select("bill_id", "match_path", F.col("change_id").alias(i))
    return side("removed", "old_text", "removed_id").join(side("added", "new_text", "added_id"), ["bill_id", "match_path"]).select("removed_id", "added_id")


def histogram(rows: DataFrame, c: str, bins: int = 10) -> DataFrame:
    return rows.groupBy(F.least(F.floor(F.col(c) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))


def parity(xml: DataFrame, pdf: DataFrame) -> DataFrame:
    """(change_type, n_xml, n_pdf): totals by type of the two producers."""
    both = xml.select("change_type", F.lit("xml").alias("p")).unionByName(pdf.select("change_type", F.lit("pdf").alias("p")))
    return both.groupBy("change_type").agg(F.count_if(F.col("p") == "xml").alias("n_xml"), F.count_if(F.col("p") == "pdf").alias("n_pdf"))


def vocabulary_overlap(xml: DataFrame, pdf: DataFrame) -> DataFrame:
    """(n_both, n_xml_only, n_pdf_only) of the distinct words of two columns ``t``."""
    one = lambda df, p: df.select(F.explode(words("t")).alias("w")).select("w", F.lit(p).alias("p"))
    g = one(xml, 1).unionByName(one(pdf, 2)).groupBy("w").agg(F.bit_or("p").alias("p"))
    return g.agg(F.count_if(F.col("p") == 3).alias("n_both"), F.count_if(F.col("p") == 1).alias("n_xml_only"), F.count_if(F.col("p") == 2).alias("n_pdf_only"))


def find(rows: DataFrame, key: str, c: str, needle: str) -> DataFrame:
    """(key, n_hits) of rows that hold ``needle`` (two characters at least), case aside."""
    if len(needle) < 2:
        return rows.select(key, F.lit(0).alias("n_hits")).limit(0)
    low, n = F.lower(F.col(c)), needle.lower()
    hits = F.floor((F.length(low) - F.length(F.replace(low, F.lit(n), F.lit("")))) / len(n))
    return rows.where(F.contains(low, F.lit(n))).select(key, hits.alias("n_hits"))


def gap_clusters(rows: DataFrame, key: str, c: str, gap: float) -> DataFrame:
    """(key, cluster, n, lo, hi): distinct values split where the step to the next is more than ``gap``."""
    w = Window.partitionBy(key).orderBy(c)
    x = rows.select(key, c).distinct().withColumn("_f", F.when(F.col(c) - F.lag(c).over(w) > gap, 1).otherwise(0))
    x = x.withColumn("cluster", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(key, "cluster").agg(F.count("*").alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi"))
