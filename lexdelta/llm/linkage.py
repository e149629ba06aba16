"""Records of one real-world thing matched across tables without a shared key, by a cascade of rules.

Attributes are brought to comparable keys (title, bureau, name in several degrees of looseness,
printed amount). Each pass joins exactly on a weaker combination of keys; a record is resolved where
the combination names one entity only, and resolved records are taken out by an anti-join
before the next pass. A rule's confidence is its precision on records whose match is labelled,
smoothed by one success and one failure.

Ambiguous key values are dropped when the target side is pre-aggregated, so no pass makes more
rows than it is given, however often a name occurs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexdelta.functions.text import header_norm
from lexdelta.operators.units import label_factor, printed_amount, stated_factor
from lexdelta.session import cut

# Abbreviations met in account names.
ABBREVIATIONS = {
    "res": "reserve", "log": "logistics", "constr": "construction", "rsch": "research", "n": "northern", "proc": "procurement", "trng": "training",
    "so": "southern", "terr": "territorial", "cmd": "command", "modern": "modernization", "oper": "operation", "maint": "maintenance", "insp": "inspection",
    "acq": "acquisition", "rest": "restoration", "repl": "replacement",
}
_SMALL = ("and", "of", "the", "for")

#: Combinations of keys from strong to weak. t: title, b: bureau, v: amount, q: amount within a sixth, n: name's
#: words, l: name's letters, e: letters with one more or less, w: words but one, i: initials, p: openings of words.
PASSES = (("tbn", "bn", "tnv", "nv", "tnq", "nq"), ("bl", "lv", "ev", "be", "teq", "eq"), ("bw", "wv", "twq", "bi", "iv", "bpv", "pv", "tn", "n"))


def name_words(c: Column) -> Column:
    """The words of an account's name without qualifiers, abbreviations written out, small words left out."""
    s = F.lower(F.coalesce(c, F.lit("")))
    s = F.regexp_replace(s, r"[\[(][^\[\]()]*[\])]", " ")
    s = F.regexp_replace(s, r"-{1,2} *(?:continued|(?:in )?(?:thousands|millions)(?: of dollars)?)", " ")
    s = F.regexp_replace(s, r",? in (?:whole dollars|thousands|millions)$", " ")
    for short, long_ in ABBREVIATIONS.items():
        s = F.regexp_replace(s, rf"\b{short}\.", f"{long_} ")
    return F.filter(F.regexp_extract_all(s, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda w: ~w.isin(*_SMALL))


def keyed(df: DataFrame, title: Column, bureau: Column, name: Column, amount: Column, digits: Column) -> DataFrame:
    """``df`` with the key columns of ``RULES``; absent attributes give NULL keys, which match nothing.

    ``digits`` is how many last digits of ``amount`` are not printed; a key of a coarser printing is
    added for each degree up to tens of millions, so figures printed in different units can meet.
    """
    df = df.withColumns({"_w": name_words(name), "_amt": F.abs(amount), "_dig": digits})
    # a name's letters are the sum of their numbers, so their order does not count, and one more or less is a sum too
    number = lambda c: F.pmod(F.xxhash64(c), F.lit(_SUM))
    letters = F.filter(F.split(F.array_join("_w", ""), ""), lambda c: c != "")
    df = df.withColumn("_l", letters).withColumns({"n": F.when(F.size("_w") > 0, F.array_join(F.array_sort("_w"), " ")), "l": F.when(F.size("_l") > 0, F.aggregate("_l", F.lit(0).cast("bigint"), lambda a, c: F.pmod(a + number(c), F.lit(_SUM))))})
    alphabet = F.array(*map(F.lit, "abcdefghijklmnopqrstuvwxyz"))
    fewer = F.transform(F.array_distinct("_l"), lambda c: F.pmod(F.col("l") - number(c) + F.lit(_SUM), F.lit(_SUM)))
    more = F.transform(alphabet, lambda c: F.pmod(F.col("l") + number(c), F.lit(_SUM)))
    bureau_words = F.filter(F.regexp_extract_all(F.lower(bureau), F.lit(r"(\p{L}+)"), F.lit(1)), lambda w: ~w.isin(*_SMALL))
    less_one = lambda w: F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.array_join(F.array_sort(F.filter(w, lambda x, j: j != i - 1)), " "))
    return df.withColumns({
        "t": F.when(F.trim(title) != "", header_norm(title)),
        "b": F.when(F.size(bureau_words) > 0, F.array_join(F.array_sort(bureau_words), " ")),
        "v": F.when(F.col("_amt") > 0, F.transform(F.filter(F.array(*map(F.lit, (3, 4, 5, 6, 7))), lambda r: r >= F.col("_dig")), lambda r: F.concat_ws(":", r.cast("string"), F.round(F.col("_amt") / F.pow(F.lit(10.0), r)).cast("bigint").cast("string")))),
        "q": F.when(F.col("_amt") > 0, F.expr("array(floor(ln(_amt) / ln(1.15)), floor(ln(_amt) / ln(1.15)) + 1)")),
        "e": F.when(F.size("_l") > 4, F.concat(F.array("l"), fewer, more)),
        "w": F.when(F.size("_w") > 2, F.array_append(less_one(F.col("_w")), F.col("n"))),
        "i": F.when(F.size("_w") > 1, F.array_join(F.array_sort(F.transform("_w", lambda x: x.substr(1, 1))), "")),
        "p": F.when(F.size("_w") > 0, F.array_distinct(F.transform("_w", lambda x: x.substr(1, 3)))),
    }).drop("_w", "_l", "_amt", "_dig")


KEYS = ("t", "b", "v", "q", "n", "l", "e", "w", "i", "p")
_MANY = {"v", "q", "e", "w", "p"}
_SUM = 1 << 61


def _keys(rules: tuple[str, ...], first: int, left: bool, scope: str = "scope") -> Column:
    """ARRAY<STRUCT<r, k>>: the key combinations of ``rules``, numbered from ``first`` and hashed with number and scope.

    The left side has its finest amount key only, and all names one letter away; the right side, which has more rows, all
    amount keys and the name as it is.
    """
    finest, parts = left, []
    for r, rule in enumerate(rules, first):
        rule = rule if left else rule.replace("e", "l")
        many = [c for c in rule if c in _MANY and not (c == "v" and finest)]
        names = ", ".join(f"x_{c}" if c in many else "v[0]" if c == "v" else c for c in rule)
        expr = f"struct({r} as r, xxhash64({scope}, {r}, {names}) as k)"
        for depth, c in enumerate(many):
            expr = f"transform({c}, x_{c} -> {expr})" if depth == 0 else f"flatten(transform({c}, x_{c} -> {expr}))"
        expr = expr if many else f"array({expr})"
        there = " and ".join(f"{c} is not null" for c in (scope, *rule))
        parts.append(f"if({there}, {expr}, array())")
    return F.expr(f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0])


def cascade(left: DataFrame, right: DataFrame, passes: tuple[tuple[str, ...], ...] = PASSES) -> DataFrame:
    """(lid, rid, rule): the entity ``rid`` of ``right`` that each record ``lid`` of ``left`` is resolved to, at most one.

    Both sides have ``scope`` (records match within a scope only), their identifier and the key
    columns; ``right`` may have several rows an entity. The rules of one pass are tried in order in one
    join, and what a pass resolves is taken out before the next. Unresolved records have no row. A
    NULL scope matches nothing.
    """
    done, todo, at = [], left, 0
    for rules in passes:
        # a rule without amount does not join records of different bureaus
        free = [at + n for n, rule in enumerate(rules) if "v" in rule or "q" in rule]
        bureau = F.when(F.col("b").isNotNull(), F.xxhash64("b")).alias("b")
        # numbers only from here on, so that aggregation is by hash and rows are short
        single = right.select("rid", bureau, F.explode(_keys(rules, at, False)).alias("x")).groupBy(F.col("x.k").alias("k")).agg(F.min("rid").alias("rid"), F.max("rid").alias("_z"), F.min("b").alias("_b")).where("rid = _z")
        mine = todo.select("lid", bureau, F.explode(_keys(rules, at, True)).alias("x")).select("lid", "b", "x.r", "x.k")
        fits = F.col("r").isin(free) | F.col("b").isNull() | F.col("_b").isNull() | (F.col("b") == F.col("_b"))
        per = mine.join(single, "k").where(fits).groupBy("lid", "r").agg(F.min("rid").alias("rid"), F.max("rid").alias("_z")).where("rid = _z")
        best = per.groupBy("lid").agg(F.min_by("rid", "r").alias("rid"), F.min("r").alias("r"))
        names = F.array(*map(F.lit, rules))
        hit = cut(best.select("lid", "rid", F.get(names, F.col("r") - at).alias("rule")), "pass")
        done.append(hit)
        todo = todo.join(hit.select("lid"), "lid", "left_anti")
        at += len(rules)
    return reduce(DataFrame.unionByName, done)


def rule_confidence(matches: DataFrame, labels: DataFrame) -> DataFrame:
    """(rule, n_labelled, n_right, confidence) from labelled pairs (lid, rid); a rule without labels gets 1/2."""
    judged = matches.join(labels.select("lid", F.col("rid").alias("_true")), "lid", "left")
    n, right = F.count("_true"), F.count_if(F.col("rid") == F.col("_true"))
    return judged.groupBy("rule").agg(n.alias("n_labelled"), right.alias("n_right")).withColumn("confidence", F.round((F.col("n_right") + 1) / (F.col("n_labelled") + 2), 6))


def _vote(left: DataFrame, right: DataFrame, rules: tuple[str, ...] = ("tbn", "bnv", "tnv", "bn", "nv", "bl", "bw")) -> DataFrame:
    """(source, scope): the target that most keys speak for, of the keys that only one target has."""
    one = lambda d, i: d.select(i, F.explode(_keys(rules, 0, True, "congress")).alias("x")).select(i, "x.k").distinct()
    single = one(right, "target").groupBy("k").agg(F.min("target").alias("target"), F.max("target").alias("_z")).where("target = _z")
    sums = one(left, "source").join(single, "k").groupBy("source", "target").agg(F.count("*").alias("w"))
    return sums.groupBy("source").agg(F.max_by("target", F.struct("w", "target")).alias("scope"))


class AccountLinks:
    """Report accounts matched with the nodes of bills and with ground-truth rows.

    ``nodes`` (node_id, bill_id, match_path, header_text, body_text) are all nodes of first versions, whatever they
    are; rows of one path are one entity. NULL attributes match nothing; repeated rows each get their match; empty tables give
    no matches; other columns are not read.
    """

    def __init__(self, accounts: DataFrame, nodes: DataFrame, truth: DataFrame) -> None:
        figure, beside = printed_amount(F.col("amount_text"))
        factor = F.coalesce(beside, stated_factor(F.col("unit_note")), label_factor(F.col("heading")), F.lit(1))
        decimals = F.length(F.regexp_extract("amount_text", r"\.(\d+)", 1))
        a = accounts.where("account_id is not null").select(F.col("account_id").alias("lid"), F.col("report_pkg").alias("source"), F.regexp_extract("report_pkg", r"^CRPT-(\d+)", 1).alias("congress"), "title", "bureau", "heading", (figure * factor).cast("double").alias("amount"), (F.log10(factor.cast("double")) - decimals).cast("int").alias("digits"))
        self.accounts = cut(keyed(a, F.col("title"), F.col("bureau"), F.col("heading"), F.col("amount"), F.col("digits")).select("lid", "source", "congress", *KEYS), "accounts")

        first = F.regexp_extract("body_text", r"\$(\d[\d,]*)", 1)
        path = F.transform("match_path", lambda x: header_norm(x))
        n = nodes.select("node_id", F.col("bill_id").alias("scope"), F.split("bill_id", "-")[0].alias("congress"), path.alias("path"), "header_text", F.regexp_replace(first, ",", "").try_cast("double").alias("amount"))
        bureau = F.when(F.size("path") > 2, F.get("path", F.lit(1)))
        name = F.when(F.trim("header_text") != "", F.col("header_text")).otherwise(F.element_at("path", -1))
        n = keyed(n, F.get("path", F.lit(0)), bureau, name, F.col("amount"), F.lit(0)).withColumn("pathkey", F.array_join("path", " > "))
        n = cut(n.select("node_id", "scope", "congress", "pathkey", *KEYS), "nodes")
        entity = n.groupBy("scope", "pathkey").agg(F.min("node_id").cast("bigint").alias("rid"))
        self.nodes = n.join(entity, ["scope", "pathkey"])

        noted = F.coalesce(stated_factor(F.col("note")), label_factor(F.col("excel_name")), F.lit(1))
        v = truth.where("validation_id is not null").select(F.col("validation_id").alias("lid"), F.col("bill").alias("scope"), F.split("bill", "-")[0].alias("congress"), "title", "bureau", "excel_name", "match_path", (F.col("expected_amount") * noted).cast("double").alias("amount"), F.log10(noted.cast("double")).cast("int").alias("digits"))
        v = keyed(v, F.col("title"), F.col("bureau"), F.col("excel_name"), F.col("amount"), F.col("digits"))
        self.truth = cut(v.select("lid", "scope", "congress", F.array_join(F.transform("match_path", lambda x: header_norm(x)), " > ").alias("pathkey"), *KEYS), "truth")

        left = self.accounts.select("source", "congress", *KEYS)
        right = self.nodes.select(F.col("scope").alias("target"), "congress", *KEYS).unionByName(self.truth.select(F.col("scope").alias("target"), "congress", *KEYS))
        #: (source, scope): the bill each report is on
        self.bills = cut(_vote(left, right), "bills")

        scoped = self.accounts.join(self.bills, "source")
        lefts = scoped.select(F.concat(F.lit("a"), F.col("lid").cast("string")).alias("lid"), "scope", *KEYS).unionByName(self.truth.select(F.concat(F.lit("v"), F.col("lid").cast("string")).alias("lid"), "scope", *KEYS))
        self.resolved = cascade(lefts, self.nodes.select("rid", "scope", *KEYS))

        # accounts that no bill node shows: ground-truth rows are matched with the accounts themselves
        mine = scoped.withColumn("aid", F.concat(F.lit("a"), F.col("lid").cast("string"))).join(self.resolved.select(F.col("lid").alias("aid"), "rid"), "aid", "left")
        own = -1 - F.abs(F.xxhash64("scope", "n") % F.lit(1 << 62))  # below all node ids
        mine = mine.withColumn("rid", F.coalesce("rid", own))
        open_truth = self.truth.select(F.concat(F.lit("v"), F.col("lid").cast("string")).alias("lid"), "scope", *KEYS).join(self.resolved.select("lid"), "lid", "left_anti")
        late = cascade(open_truth, mine.select("rid", "scope", *KEYS), (tuple(r for rules in PASSES for r in rules),))
        self.entities = cut(mine.select(F.col("lid").alias("account_id"), "rid", F.col("aid")), "entities")
        self.all = self.resolved.unionByName(late)

    def confidence(self) -> DataFrame:
        """Each rule's smoothed precision on the ground-truth rows with a known path that it resolved to a node.

        Matches with accounts that no node shows have no label and are not counted.
        """
        paths = self.nodes.select("scope", "pathkey", "rid").distinct()
        labels = self.truth.where("pathkey is not null").join(paths, ["scope", "pathkey"]).select(F.concat(F.lit("v"), F.col("lid").cast("string")).alias("lid"), "rid")
        return rule_confidence(self.resolved.where(F.col("lid").startswith("v")), labels)

    def links(self) -> DataFrame:
        """(account_id, other_table, other_id, confidence), the confidence being that of the weaker rule used."""
        conf = self.confidence().select("rule", "confidence")
        scored = self.all.join(F.broadcast(conf), "rule", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.5)))  # a row a rule
        mine = self.entities.join(scored.select(F.col("lid").alias("aid"), F.col("confidence").alias("ca")), "aid", "left")
        to_nodes = mine.join(self.nodes.select("rid", F.col("node_id").alias("other_id")), "rid").select("account_id", F.lit("bill_nodes").alias("other_table"), "other_id", F.col("ca").alias("confidence"))
        rows = scored.where(F.col("lid").startswith("v")).select("rid", F.expr("cast(substring(lid, 2) as bigint)").alias("other_id"), F.col("confidence").alias("cv"))
        to_truth = mine.join(rows, "rid").select("account_id", F.lit("validation_defense").alias("other_table"), "other_id", F.least(F.coalesce("ca", "cv"), "cv").alias("confidence"))
        return to_nodes.unionByName(to_truth).distinct()
