"""Accounts of the ground truth looked up in what was read from the bills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexdelta.functions.text import alnum_name, amounts


def amounts_by_path(nodes: DataFrame) -> DataFrame:
    """(bill_id, match_path, pool): the distinct amounts of each path."""
    each = nodes.where(F.size("match_path") > 0).select("bill_id", "match_path", F.explode(amounts("body_text")).alias("a"))
    return each.groupBy("bill_id", "match_path").agg(F.collect_set("a").alias("pool"))


def amounts_by_agency(nodes: DataFrame) -> DataFrame:
    """(bill_id, agency, amount): distinct amounts below each normalised first path element."""
    return nodes.where(F.size("match_path") > 0).select("bill_id", alnum_name(F.get("match_path", F.lit(0))).alias("agency"), F.explode(amounts("body_text")).alias("amount")).where("agency <> ''").distinct()


def has_component_sum(pool: Column, target: Column, most: int = 16) -> Column:
    """Whether one to four of the ``most`` largest distinct amounts in (0, target] add up to the target."""
    p = F.slice(F.sort_array(F.filter(F.array_distinct(pool), lambda a: (a > 0) & (a <= target)), asc=False), 1, most)
    idx = lambda: F.transform(p, lambda a, i: F.struct(a.alias("s"), i.alias("i")))
    grow = lambda level: F.flatten(F.transform(level, lambda x: F.transform(F.filter(F.transform(p, lambda a, i: F.struct(a.alias("s"), i.alias("i"))), lambda y: (y["i"] > x["i"]) & (y["s"] + x["s"] <= target)), lambda y: F.struct((y["s"] + x["s"]).alias("s"), y["i"].alias("i")))))
    one = idx()
    two = grow(one)
    three = grow(two)
    four = grow(three)
    hit = lambda level: F.exists(level, lambda x: x["s"] == target)
    return F.coalesce(hit(one) | hit(two) | hit(three) | hit(four), F.lit(False))


def validate(truth: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ``method`` to ground-truth rows (validation_id, bill, title, bureau, match_path, expected_amount).

    ``agency``: the amount stands below an agency named like the title or the bureau; else ``component-sum``: it is the
    sum of amounts of the account's own node; else ``unvalidated``.
    """
    by_agency = amounts_by_agency(nodes)
    names = truth.select("validation_id", F.col("bill").alias("bill_id"), F.col("expected_amount").alias("amount"), F.explode(F.array_distinct(F.filter(F.array(alnum_name(F.coalesce("title", F.lit(""))), alnum_name(F.coalesce("bureau", F.lit("")))), lambda n: n != ""))).alias("agency"))
    seen = names.join(by_agency, ["bill_id", "agency", "amount"], "left_semi").select("validation_id").distinct().withColumn("_a", F.lit(True))
    out = truth.join(seen, "validation_id", "left")
    paths = amounts_by_path(nodes).withColumnRenamed("bill_id", "bill")
    out = out.join(paths, ["bill", "match_path"], "left")
    method = F.when(F.col("_a"), "agency").when(F.col("pool").isNotNull() & has_component_sum(F.col("pool"), F.col("expected_amount")), "component-sum").otherwise("unvalidated")
    return out.withColumn("method", method).drop("_a", "pool")


def recall(validated: DataFrame, by: str = "bill") -> DataFrame:
    """(by, n, n_validated, recall) of each group and, with NULL, over all."""
    ok = F.count_if(F.col("method") != "unvalidated")
    return validated.rollup(by).agg(F.count("*").alias("n"), ok.alias("n_validated"), F.round(ok / F.count("*"), 6).alias("recall"))


def account_paths(accounts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ``path`` to accounts (key, bill_id, title, bureau, name): the path of the one node of that name, or NULL.

    Equal names first, else names that contain one another; of several nodes the one that shares most words with bureau, then
    title, unless two share as many. Names are compared within a bill.
    """
    toks = lambda c: F.filter(F.split(alnum_name(F.coalesce(c, F.lit(""))), " +"), lambda w: w != "")
    a = accounts.select("key", "bill_id", alnum_name(F.coalesce("name", F.lit(""))).alias("nh"), toks("bureau").alias("bt"), toks("title").alias("tt"))
    n = nodes.where(F.size("match_path") > 0).select("bill_id", "node_id", "match_path", alnum_name(F.element_at("match_path", -1)).alias("nn"))
    n = n.withColumns({"pt": toks(F.array_join("match_path", " ")), "ft": toks(F.get("match_path", F.lit(0)))})
    exact = a.join(n, (a["bill_id"] == n["bill_id"]) & (a["nh"] == n["nn"])).drop(n["bill_id"])
    rest = a.join(exact.select("key").distinct(), "key", "left_anti").where("nh <> ''")
    part = rest.join(n, "bill_id").where(F.contains("nn", F.col("nh")) | F.contains("nh", F.col("nn")))
    score = F.struct(F.size(F.array_intersect("bt", "pt")).alias("b"), F.size(F.array_intersect("tt", "ft")).alias("t"))
    cands = exact.select("key", "node_id", "match_path", score.alias("s")).unionByName(part.select("key", "node_id", "match_path", score.alias("s")))
    w = Window.partitionBy("key").orderBy(F.desc("s"), "node_id")
    ranked = cands.withColumns({"rk": F.row_number().over(w), "next": F.lead("s").over(w)}).where("rk = 1 and (next is null or next <> s)")
    return accounts.join(ranked.select("key", F.col("match_path").alias("path")), "key", "left")


def markdown(recalls: list[dict]) -> str:
    """A recall table as text; a line a jurisdiction, so the input is the rolled-up result."""
    rows = sorted(recalls, key=lambda r: (r["bill"] is None, r["bill"] or ""))
    return "\n".join(["| jurisdiction | validated | recall |", "|---|---|---|", *(f"| {r['bill'] or 'all'} | {r['n_validated']} / {r['n']} | {r['recall'] * 100:.1f} % |" for r in rows)])
