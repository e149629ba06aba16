"""Two versions of a document compared: match nodes, classify, find moves, read the money.

Input is one table of nodes: ``pair_id`` (which comparison), ``side`` (``old``/``new``), ``node_ord``
(document order within its version), ``match_path`` ARRAY<STRING>, ``body_text`` and what ``NODE``
lists. One comparison and a corpus of them are the same plan; everything is keyed by ``pair_id``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexdelta.functions import kernels as K
from lexdelta.functions import udfs
from lexdelta.functions.text import amounts, collapse, division_title, has_annotation, unified_diff
from lexdelta.session import cut, spread

NODE = ("node_ord", "display_path", "element_id", "body_text", "section_number", "division_label")
TYPES = ("added", "removed", "modified", "unchanged", "moved")


def side_nodes(nodes: DataFrame) -> DataFrame:
    """Only the columns comparisons read, NULL texts as ``""``; rows without pair or side are left out."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return nodes.where("pair_id is not null and side in ('old', 'new')").select(
        "pair_id", "side", F.coalesce("match_path", F.array().cast("array<string>")).alias("match_path"), F.col("node_ord").cast("int").alias("node_ord"), "display_path", blank("element_id"), blank("body_text"), blank("section_number"), blank("division_label")
    )


def match_nodes(nodes: DataFrame) -> DataFrame:
    """(pair_id, match_path, path_ord, k, old NODE, new NODE): full outer match by path, one side NULL where absent.

    A path with at most one node a side pairs at once, in one aggregation. Other paths are collision
    groups, bounded by how often one document repeats a path, and are paired by division and text.
    ``path_ord`` is the path's first place: old nodes in order, then new ones.
    """
    n = side_nodes(nodes)
    node, old, new = F.struct(*NODE), F.col("side") == "old", F.col("side") == "new"
    place = F.when(old, F.col("node_ord")).otherwise(F.col("node_ord") + F.lit(1 << 30))
    groups = n.groupBy("pair_id", "match_path").agg(
        F.sort_array(F.collect_list(F.when(old, node))).alias("olds"), F.sort_array(F.collect_list(F.when(new, node))).alias("news"), F.min(place).alias("path_ord")
    )
    single = (F.size("olds") <= 1) & (F.size("news") <= 1)
    plain = groups.where(single).select("pair_id", "match_path", "path_ord", F.lit(0).alias("k"), F.get("olds", F.lit(0)).alias("old"), F.get("news", F.lit(0)).alias("new"))
    hard = groups.where(~single).withColumn("ij", _collision_udf(_division_texts("olds"), _division_texts("news")))
    hard = hard.select("pair_id", "match_path", "path_ord", F.posexplode("ij").alias("k", "p"), "olds", "news")
    hard = hard.select("pair_id", "match_path", "path_ord", "k", F.get("olds", F.col("p.i")).alias("old"), F.get("news", F.col("p.j")).alias("new"))
    return plain.unionByName(hard)


def _division_texts(c: str) -> Column:
    return F.transform(c, lambda x: F.struct(division_title(x["division_label"]).alias("d"), collapse(x["body_text"]).alias("t")))


def _pairs_series(olds: pd.Series, news: pd.Series) -> pd.Series:
    pick = lambda s: [(x["d"], x["t"]) for x in s]
    return pd.Series([[{"i": i, "j": j} for i, j in K.pair_collisions(pick(o), pick(n))] for o, n in zip(olds, news)], dtype=object)


def _collision_udf(olds: Column, news: Column) -> Column:
    return F.pandas_udf(_pairs_series, "array<struct<i:int,j:int>>")(olds, news)


def classify(matches: DataFrame, split_below: float = K.SPLIT_BELOW) -> DataFrame:
    """Changes before moves: (pair_id, change_ord, match_path, change_type, old NODE, new NODE, text_diff).

    Equal texts (white space aside) are unchanged and never reach Python; a pair less similar than
    ``split_below`` is two changes, removed then added.
    """
    rows = matches.withColumns({"o": collapse("old.body_text"), "n": collapse("new.body_text")})
    rows = rows.withColumn("differ", F.coalesce(F.col("o") != F.col("n"), F.lit(False)))
    # one pass over all pairs: equal ones reach Python as NULL
    asked = lambda c: F.when(F.col("differ"), F.col(c))
    rows = rows.withColumn("near", F.when(F.col("differ"), udfs.reaches(split_below)(asked("o"), asked("n"))).otherwise(True))
    rows = rows.withColumn("part", F.explode(F.when(F.col("near"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    first = F.col("part") == 0
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("differ"), "unchanged").when(F.col("near"), "modified").when(first, "removed").otherwise("added")
    return rows.select(
        "pair_id", "match_path", kind.alias("change_type"), F.when(F.col("near") | first, F.col("old")).alias("old"), F.when(F.col("near") | ~first, F.col("new")).alias("new"),
        F.when(F.col("differ") & F.col("near"), unified_diff(F.col("o"), F.col("n"))).alias("text_diff"), F.struct("path_ord", "k", "part").alias("change_ord"),
    )


def _bag(texts: DataFrame, ident: str) -> DataFrame:
    """(pair_id, ident, size, tok, ...): the words of a text, repeated ones numbered so that a bag is a set."""
    w = texts.select("pair_id", ident, F.split("norm", " ").alias("ws"))
    each = w.select("pair_id", ident, F.size("ws").alias("size"), F.explode("ws").alias("w")).groupBy("pair_id", ident, "size", "w").agg(F.count("*").alias("c"))
    return each.select("pair_id", ident, "size", F.explode(F.transform(F.sequence(F.lit(1), F.col("c").cast("int")), lambda k: F.xxhash64("w", k))).alias("tok"))


def move_candidates(changes: DataFrame, threshold: float = K.MOVE_FROM) -> DataFrame:
    """(pair_id, ro, ao, sim): removed and added texts of one pair whose ratio reaches ``threshold``.

    Two texts of similarity t share at least t/(2-t) of the larger one's words, so it is enough to join on
    the rarest words of each (a prefix filter that loses nothing); lengths and then the exact ratio decide. Of pairs of
    empty texts, which all have ratio 1, only those are given that the assignment takes.
    """
    side = lambda kind, node, o: changes.where(F.col("change_type") == kind).select("pair_id", F.col("change_ord").alias(o), collapse(f"{node}.body_text").alias("norm"))
    gone, come = side("removed", "old", "ro"), side("added", "new", "ao")
    # empty texts are wholly alike: the ones that greedy assignment takes are the last with the last, and so on
    last = lambda df, o: df.where("norm = ''").withColumn("nth", F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc(o)))).drop("norm")
    empty = last(gone, "ro").join(last(come, "ao"), ["pair_id", "nth"]).select("pair_id", "ro", "ao", F.lit(1.0).alias("sim"))
    removed, added = gone.where("norm <> ''"), come.where("norm <> ''")
    r, a = _bag(removed, "ro"), _bag(added, "ao")
    freq = r.select("pair_id", "tok").unionByName(a.select("pair_id", "tok")).groupBy("pair_id", "tok").agg(F.count("*").alias("df"))
    need = threshold / (2 - threshold)
    # without the small number, sizes whose share is a whole number of words (35, 63, 70) may be rounded up by one
    at_least = lambda size: F.ceil(F.lit(need) * size - 1e-9)

    def prefix(bag: DataFrame, ident: str) -> DataFrame:
        w = Window.partitionBy("pair_id", ident).orderBy("df", "tok")
        ranked = bag.join(freq, ["pair_id", "tok"]).withColumn("rk", F.row_number().over(w))
        return ranked.where(F.col("rk") <= F.col("size") - at_least(F.col("size")) + 1).select("pair_id", "tok", ident, F.col("size").alias(f"{ident}_size"))

    pairs = prefix(r, "ro").join(prefix(a, "ao"), ["pair_id", "tok"])
    short, long_ = F.least("ro_size", "ao_size"), F.greatest("ro_size", "ao_size")
    pairs = pairs.where(2.0 * short >= threshold * (short + long_)).select("pair_id", "ro", "ao").distinct()
    texts = pairs.join(removed.withColumnRenamed("norm", "rt"), ["pair_id", "ro"]).join(added.withColumnRenamed("norm", "at"), ["pair_id", "ao"])
    return texts.withColumn("sim", udfs.seq_ratio_move("rt", "at")).where(F.col("sim") >= threshold).select("pair_id", "ro", "ao", "sim").unionByName(empty)


def assign_moves(candidates: DataFrame) -> DataFrame:
    """(pair_id, ro, ao, rank): greedy one-to-one pairs, best first, later ones first on ties.

    The input of one comparison is its similar removed/added pairs, far fewer than its nodes.
    """

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        key = lambda x: (x["path_ord"], x["k"], x["part"])
        ros, aos = ({key(x): x for x in pdf[c]} for c in ("ro", "ao"))
        ri, ai = ({k: n for n, k in enumerate(sorted(d))} for d in (ros, aos))
        made = K.greedy_pairs((s, ri[key(r)], ai[key(a)]) for r, a, s in zip(pdf["ro"], pdf["ao"], pdf["sim"]))
        rs, as_ = sorted(ros), sorted(aos)
        return pd.DataFrame({"pair_id": pdf["pair_id"].iloc[0], "ro": [ros[rs[i]] for _, i, _ in made], "ao": [aos[as_[j]] for _, _, j in made], "rank": range(len(made)), "sim": [s for s, _, _ in made]})

    order = candidates.schema["ro"].dataType.simpleString()
    return spread(candidates, "pair_id").groupBy("pair_id").applyInPandas(greedy, f"pair_id {candidates.schema['pair_id'].dataType.simpleString()}, ro {order}, ao {order}, rank int, sim double")


def find_moves(changes: DataFrame, threshold: float = K.MOVE_FROM, most_pairs: int = 100_000_000, most_texts: int = 20_000) -> DataFrame:
    """(pair_id, ro, ao, rank, sim): removed and added changes that are one moved text, in the order they are claimed.

    A comparison with at most ``most_pairs`` pairs of removed and added texts, and ``most_texts`` texts, is one group: its
    pairs are bounded, compared and claimed at once. Larger ones find their candidates by joins over all tasks. Both give
    the same moves.
    """
    some = changes.where("change_type in ('removed', 'added')")
    r, a = F.count_if(F.col("change_type") == "removed"), F.count_if(F.col("change_type") == "added")
    size = some.groupBy("pair_id").agg(r.alias("r"), a.alias("a")).where("r > 0 and a > 0")
    large = size.where((F.col("r") * F.col("a") > most_pairs) | (F.col("r") + F.col("a") > most_texts)).select("pair_id")
    order, pair = changes.schema["change_ord"].dataType.simpleString(), changes.schema["pair_id"].dataType.simpleString()
    text = F.when(F.col("change_type") == "removed", F.col("old.body_text")).otherwise(F.col("new.body_text"))
    place = "path_ord", "k", "part"
    lean = some.select("pair_id", "change_type", *(F.col(f"change_ord.{c}").alias(c) for c in place), collapse(text).alias("t"))

    def of_pair(rows: list[tuple]) -> list[tuple]:
        gone, come = ([r for r in rows if r[1] == kind] for kind in ("removed", "added"))
        if not gone or not come:
            return []
        made = K.greedy_pairs(K.similar_texts([r[-1] for r in gone], [r[-1] for r in come], threshold))
        return [(rows[0][0], *gone[i][2:5], *come[j][2:5], n, ratio) for n, (ratio, i, j) in enumerate(made)]

    def claim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # many pairs are small, so they are told apart here and not handed over one by one
        names, kind = ["pair_id", *(f"{s}{n}" for s in "ra" for n in range(3)), "rank", "sim"], None

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found)) or [()] * len(names)
            kinds = [kind, *[pa.int32()] * 7, pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

        held: list[tuple] = []  # the pair that the last batch left open
        for batch in batches:
            kind, found = batch.schema.field(0).type, []
            for key, group in groupby(zip(*(c.to_pylist() for c in batch.columns)), key=itemgetter(0)):
                if held and held[0][0] != key:
                    found += of_pair(held)
                    held = []
                held += group
            yield batch_of(found)
        if held:
            yield batch_of(of_pair(held))

    spot = lambda s: F.struct(*(F.col(f"{s}{n}").alias(c) for n, c in enumerate(place))).cast(order).alias(f"{s}o")
    shape = f"pair_id {pair}, r0 int, r1 int, r2 int, a0 int, a1 int, a2 int, rank int, sim double"
    grouped = lambda df: spread(df, "pair_id").sortWithinPartitions("pair_id", *place).mapInArrow(claim, shape).select("pair_id", spot("r"), spot("a"), "rank", "sim")
    if large.isEmpty():
        return grouped(lean)
    small = grouped(lean.join(large, "pair_id", "left_anti"))
    return small.unionByName(assign_moves(move_candidates(some.join(large, "pair_id", "left_semi"), threshold)))


def numbered(changes: DataFrame, moves: DataFrame) -> DataFrame:
    """(pair_id, change_no, change_ord, ro, ao): the order in which changes are given, from 1 within a pair.

    Changes that are part of a move are left out; moves (``ro`` and ``ao`` set) come last, as they were claimed. Keys only:
    no text is sorted here.
    """
    gone = moves.select("pair_id", F.explode(F.array("ro", "ao")).alias("change_ord"))
    none = F.lit(None).cast(changes.schema["change_ord"].dataType)
    stay = changes.select("pair_id", "change_ord").join(gone, ["pair_id", "change_ord"], "left_anti").select("pair_id", F.lit(0).alias("last"), F.col("change_ord").alias("at"), "change_ord", none.alias("ro"), none.alias("ao"))
    moved = moves.select("pair_id", F.lit(1).alias("last"), F.struct(F.col("rank").alias("path_ord"), F.lit(0).alias("k"), F.lit(0).alias("part")).alias("at"), none.alias("change_ord"), "ro", "ao")
    w = Window.partitionBy("pair_id").orderBy("last", "at")
    return stay.unionByName(moved).select("pair_id", F.row_number().over(w).alias("change_no"), "change_ord", "ro", "ao")


def changes_table(changes: DataFrame, moves: DataFrame) -> DataFrame:
    """The flat form of changes, removed and added ones re-linked where they are moves. Texts are joined to their numbers by key."""
    order = numbered(changes, moves)
    left = changes.join(order.where("ro is null").select("pair_id", "change_ord", "change_no"), ["pair_id", "change_ord"]).drop("change_ord")
    old = changes.where("change_type = 'removed'").select("pair_id", F.col("change_ord").alias("ro"), "match_path", "old")
    new = changes.where("change_type = 'added'").select("pair_id", F.col("change_ord").alias("ao"), "new")
    m = order.where("ro is not null").select("pair_id", "change_no", "ro", "ao").join(old, ["pair_id", "ro"]).join(new, ["pair_id", "ao"])
    o, n = collapse("old.body_text"), collapse("new.body_text")
    m = m.select("pair_id", "match_path", F.lit("moved").alias("change_type"), "old", "new", F.when(o != n, unified_diff(o, n)).alias("text_diff"), "change_no")
    either = lambda a, b, f: F.coalesce(F.nullif(F.col(f"{a}.{f}"), F.lit("")), F.col(f"{b}.{f}"))
    return left.unionByName(m).select(
        "pair_id", "change_no", "change_type", "match_path", F.col("old.display_path").alias("display_path_old"), F.col("new.display_path").alias("display_path_new"),
        F.col("old.body_text").alias("old_text"), F.col("new.body_text").alias("new_text"), "text_diff", F.coalesce(either("new", "old", "section_number"), F.col("new.section_number"), F.col("old.section_number")).alias("section_number"),
        F.coalesce("old.element_id", F.lit("")).alias("element_id_old"), F.coalesce("new.element_id", F.lit("")).alias("element_id_new"),
    )


def compare(nodes: DataFrame, **bounds: int) -> DataFrame:
    """All changes between the old and new nodes of each pair. An empty table gives no changes.

    Changes are read several times below, so they and the moves among them are written once to the shared folder.
    ``bounds`` are those of ``find_moves``.
    """
    changes = cut(classify(match_nodes(nodes)), "changes")
    return changes_table(changes, cut(find_moves(changes, **bounds), "moves"))


def summary(changes: DataFrame) -> DataFrame:
    """(pair_id, change_type, n): all five types of each pair, zeros included."""
    n = changes.groupBy("pair_id").pivot("change_type", list(TYPES)).count().na.fill(0)
    return n.select("pair_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, TYPES)), F.array(*TYPES))).alias("change_type", "n"))


def filter_changes(changes: DataFrame, needle: str | None = None, financial: bool = False, include_unchanged: bool = False) -> DataFrame:
    """The changes kept by the command line's filters; the needle is compared in lower case with the joined path."""
    out = changes if include_unchanged else changes.where("change_type <> 'unchanged'")
    if needle:
        out = out.where(F.contains(F.array_join("match_path", " "), F.lit(needle.lower())))
    return out.where(amounts_changed(F.col("old_text"), F.col("new_text"))) if financial else out


def amounts_changed(old: Column, new: Column) -> Column:
    """Whether the two multisets of amounts differ."""
    return F.array_sort(amounts(old)) != F.array_sort(amounts(new))


def with_money(changes: DataFrame) -> DataFrame:
    """Adds ``financial``: NULL without amounts on either side, else amounts, pairs and flags.

    Amounts, change and notes stay in the JVM; only rows that have an amount go to Python for pairing.
    """
    c = changes.withColumns({"_a": amounts("old_text"), "_z": amounts("new_text")})
    some = (F.size("_a") > 0) | (F.size("_z") > 0)
    flag = has_annotation("old_text") | has_annotation("new_text")
    kind = "struct<old_amounts:array<bigint>,new_amounts:array<bigint>,amounts_changed:boolean,paired_amounts:array<struct<old:bigint,new:bigint>>,has_amendment_annotations:boolean>"
    paid = c.where(some).withColumn("_p", udfs.pair_amounts("old_text", "new_text"))
    paid = paid.withColumn("financial", F.struct(F.col("_a").alias("old_amounts"), F.col("_z").alias("new_amounts"), (F.array_sort("_a") != F.array_sort("_z")).alias("amounts_changed"), F.col("_p").alias("paired_amounts"), flag.alias("has_amendment_annotations")).cast(kind)).drop("_p")
    free = c.where(~some).withColumn("financial", F.lit(None).cast(kind))
    return paid.unionByName(free).drop("_a", "_z")


def real_pairs(pairs: Column) -> Column:
    """Pairs with both sides that differ."""
    return F.filter(pairs, lambda p: p["old"].isNotNull() & p["new"].isNotNull() & (p["old"] != p["new"]))


def financial_count(changes: DataFrame) -> DataFrame:
    return changes.groupBy("pair_id").agg(F.count_if(F.coalesce(F.col("financial.amounts_changed"), F.lit(False))).alias("n_financial"))


def money_rows(changes: DataFrame) -> DataFrame:
    """The money table: a row a pair of amounts, with difference and per cent."""
    each = changes.select("pair_id", "change_no", "change_type", F.posexplode("financial.paired_amounts").alias("at", "p"))
    return each.select("pair_id", "change_no", "change_type", F.col("at").alias("pair_no"), F.col("p.old").alias("old_amount"), F.col("p.new").alias("new_amount"), (F.col("p.new") - F.col("p.old")).alias("delta"))


def view_filter(changes: DataFrame, mode: str = "all") -> DataFrame:
    """What a reader's view shows: ``all``, ``financial`` (with real amount pairs) or ``structural`` (not merely modified)."""
    if mode == "financial":
        return changes.where(F.size(real_pairs(F.col("financial.paired_amounts"))) > 0)
    return changes.where("change_type <> 'modified'") if mode == "structural" else changes
