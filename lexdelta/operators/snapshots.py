"""Differences between consecutive full snapshots, found by comparing Merkle trees.

Every row of a snapshot is reduced to its key and a 64-bit hash of its content before anything is
shuffled, and the newest row of a key is found with map-side combination, so a group that holds a
third of all rows is spread over its keys. Digests are XORs, so they are pre-aggregated too. Digests are compared from the root down, and rows are compared
only in leaves whose digests differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexdelta.functions.text import division_title, path_text, strip_ws
from lexdelta.session import cut

LEAVES, FAN = 64, 8


def resolve_versions(nodes: DataFrame, versions: DataFrame) -> DataFrame:
    """``nodes`` with column ``version``: version_no, else the number its label has in ``versions``.

    Rows whose label is unknown too have no version and are left out. Only rows without a number
    take part in the join.
    """
    numbered = nodes.where(F.col("version_no").isNotNull()).withColumn("version", F.col("version_no"))
    labels = (
        versions.where("bill_id is not null and version_label is not null and version_no is not null")
        .groupBy("bill_id", "version_label")
        .agg(F.max("version_no").alias("version"))
    )
    named = nodes.where(F.col("version_no").isNull()).join(labels, ["bill_id", "version_label"])
    return numbered.unionByName(named)


def node_rows(nodes: DataFrame, versions: DataFrame) -> DataFrame:
    """(bill_id, version, division_title, path_text, content, loaded_at, node_id), content being a hash."""
    blank = F.lit("")
    lean = nodes.select(
        "bill_id", "version_no", "version_label", "loaded_at", "node_id",
        division_title("division_label").alias("division_title"),
        path_text("match_path").alias("path_text"),
        F.xxhash64(strip_ws(F.coalesce("body_text", blank)), strip_ws(F.coalesce("header_text", blank))).alias("content"),
    )
    return resolve_versions(lean, versions).where("bill_id is not null").drop("version_no", "version_label")


def snapshot_diff(rows: DataFrame, group: str, version: str, key: list[str], content: str, newest: list[str], leaves: int = LEAVES, fan: int = FAN) -> DataFrame:
    """(group, version_old, version_new, *key, change_type) for each two neighbouring versions of a group.

    ``content`` is a 64-bit hash of what makes a row differ. Of several rows of one key in a version
    the one with the greatest ``newest`` counts, NULL counting as the least. Rows without group or
    version are left out; NULL in a key is a key of its own. An empty table gives no rows, and so
    does a group with one version. Other columns of ``rows`` are not read.
    """
    k = [f"_k{i}" for i in range(len(key))]
    lean = rows.select(
        F.col(group).alias("_g"), F.col(version).alias("_v"), *(F.col(c).alias(n) for c, n in zip(key, k)),
        F.col(content).alias("_h"), F.struct(*newest).alias("_at"),
    ).where("_g is not null and _v is not null")
    lean = lean.withColumn("_leaf", F.pmod(F.xxhash64(*k), F.lit(leaves)).cast("int"))
    # the one pass over the rows; what is compared below are hashes, read back from the shared folder
    latest = cut(lean.groupBy("_g", "_leaf", "_v", *k).agg(F.max_by("_h", "_at").alias("_h")), "latest")

    row_hash = F.xxhash64(*k, "_h")
    leaf = latest.groupBy("_g", "_leaf", "_v").agg(F.bit_xor(row_hash).alias("_d"), F.count("*").alias("_n"))
    leaf = leaf.withColumn("_b", F.floor(F.col("_leaf") / fan).cast("int"))
    branch = leaf.groupBy("_g", "_b", "_v").agg(F.bit_xor(F.xxhash64("_leaf", "_d", "_n")).alias("_d"))
    root = branch.groupBy("_g", "_v").agg(F.bit_xor(F.xxhash64("_b", "_d")).alias("_d"))

    # versions of one group are few, so this window never holds many rows
    order = Window.partitionBy("_g").orderBy("_v")
    pairs = root.select("_g", F.col("_v").alias("_old"), F.lead("_v").over(order).alias("_new"), "_d", F.lead("_d").over(order).alias("_dn"))
    pairs = pairs.where("_new is not null and _d <> _dn").select("_g", "_old", "_new")

    def differing(digests: DataFrame, at: list[str], within: DataFrame, on: list[str]) -> DataFrame:
        both = digests.join(within, on).where("_v = _old or _v = _new").groupBy(*dict.fromkeys([*on, *at]), "_old", "_new")
        one = both.agg(F.max(F.when(F.col("_v") == F.col("_old"), F.col("_d"))).alias("_a"), F.max(F.when(F.col("_v") == F.col("_new"), F.col("_d"))).alias("_z"))
        return one.where(~F.col("_a").eqNullSafe(F.col("_z"))).drop("_a", "_z")

    branches = differing(branch, ["_g", "_b"], pairs, ["_g"])
    leaf_hash = leaf.select("_g", "_b", "_leaf", "_v", F.xxhash64("_d", "_n").alias("_d"))
    leaves_off = differing(leaf_hash, ["_g", "_b", "_leaf"], branches, ["_g", "_b"]).drop("_b")

    side = latest.join(leaves_off, ["_g", "_leaf"]).where("_v = _old or _v = _new")
    one = side.groupBy("_g", "_leaf", "_old", "_new", *k).agg(
        F.max(F.when(F.col("_v") == F.col("_old"), F.col("_h"))).alias("_a"), F.max(F.when(F.col("_v") == F.col("_new"), F.col("_h"))).alias("_z")
    )
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_z").isNull(), "removed").when(F.col("_a") != F.col("_z"), "changed")
    return one.withColumn("change_type", kind).where("change_type is not null").select(
        F.col("_g").alias(group), F.col("_old").alias("version_old"), F.col("_new").alias("version_new"), *(F.col(n).alias(c) for c, n in zip(key, k)), "change_type"
    )
