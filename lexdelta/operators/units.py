"""One quantity recorded in different units: read the unit from words, else from a mixture.

``stated_factor`` reads a unit from text. ``harmonise`` looks at a row's own texts in order, then
at a neighbouring text; where neither names a unit it assigns one by a log-scale mixture whose
components are one distribution of true values, offset by the known conversion factors, with what
the source is known to print in as prior weight. A row gets the posterior of its unit and a flag
where that posterior is low.

Rows that state their unit take part in the fit with that unit given. A source is fitted to a histogram
counted over all its rows, so no input of the fit grows with the data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexdelta.functions.text import collapse

FACTORS = (1, 1_000, 1_000_000, 1_000_000_000)

# Words that name a unit. Whole dollars come first, as such words may name the other
# units too ("rounded to the nearest thousand").
_DOLLARS = r"(?:\b(?:actual|whole) dollars\b|\bnot (?:in |cut to )?thousands\b|\bto dollars\b|\bnearest (?:thousand|million)\b|^usd$|^(?:in )?dollars$)"
_BILLION = r"(?:\bbillions?\b|\bbn\b|\$b\b|\bnine zeros\b|\$?000,?000,?000s?\b)"
_MILLION = r"(?:\bmillions?\b|\bmil\b|\bmn\b|\$mm?\b|\bm\$|\bsix zeros\b|\$?\b000,?000s?\b)"
_THOUSAND = r"(?:\bthousands?\b|\bthou\b|\$k\b|\bk\$|\bthree zeros\b|\$?\b000s?\b)"
#: Words a unit note may hold besides the unit; anything else between brackets is a qualifier.
_NOTE = r"^(?:amounts?|figures?|columns?|all|are|is|in|of|the|dollars?|usd|whole|actual|omitted|thousands?|millions?|billions?|thou|mil|mn|bn|\$k|\$mm?|\$b|k\$|m\$|\$|\$?000(?:,?000)*s?|three|six|nine|zeros|\s)+$"


def stated_factor(c: Column) -> Column:
    """Conversion factor named anywhere in a note that is known to speak of units; NULL without one."""
    t = F.regexp_replace(collapse(F.lower(c)), r"^[\[(\s]+|[\])\s.]+$", "")
    return (
        F.when(t.rlike(_DOLLARS), 1).when(t.rlike(_BILLION), 1_000_000_000).when(t.rlike(_MILLION), 1_000_000).when(t.rlike(_THOUSAND), 1_000)
    ).cast("bigint")


def label_factor(c: Column) -> Column:
    """Factor named in what trails an account's name: a bracket, ``--…`` or ``, in …`` made of unit words only."""
    low = collapse(F.lower(c))
    tails = F.concat(
        F.regexp_extract_all(low, F.lit(r"[\[(]([^\[\]()]*)[\])]"), F.lit(1)),
        F.regexp_extract_all(low, F.lit(r"-{1,2} *([^-\[\]()]*)$"), F.lit(1)),
        F.regexp_extract_all(low, F.lit(r",\s*(in [^,\[\]()]*)$"), F.lit(1)),
    )
    found = F.filter(F.transform(F.filter(tails, lambda x: F.trim(x).rlike(_NOTE)), stated_factor), lambda x: x.isNotNull())
    return F.get(found, F.lit(0))


def statement_factor(c: Column) -> Column:
    """Factor a report's opening names for its statement: a bracketed note, or a sentence on its columns or figures.

    Sentences that hold amounts of their own do not speak of the statement.
    """
    parts = F.split(collapse(F.coalesce(c, F.lit(""))), r"(?<=[.\])])\s+")
    own = r"\$\s?[1-9]"
    about = r"(?i)\b(?:statement|table|columns?|figures?|amounts)\b"
    notes = F.filter(parts, lambda s: ~s.rlike(own) & (s.rlike(about) | s.rlike(r"^\s*[\[(][^\[\]()]*[\])]\.?\s*$")))
    found = F.filter(F.transform(notes, stated_factor), lambda x: x.isNotNull())
    return F.get(found, F.lit(0))


def printed_amount(c: Column) -> tuple[Column, Column]:
    """(figure DECIMAL, factor named beside it) of an amount as printed; both NULL where the text is no plain amount."""
    t = F.lower(collapse(c))
    shape = r"^\$?\s*(-?\d[\d,]*(?:\.\d+)?)\s*(billion|bn|b|million|mil|mn|m|thousand|thou|k)?\.?\s*(dollars)?$"
    ok = t.rlike(shape)
    word = F.regexp_extract(t, shape, 2)
    figure = F.when(ok, F.regexp_replace(F.regexp_extract(t, shape, 1), ",", "").try_cast("decimal(28,6)"))
    factor = (
        F.when(word.isin("billion", "bn", "b"), 1_000_000_000).when(word.isin("million", "mil", "mn", "m"), 1_000_000)
        .when(word.isin("thousand", "thou", "k"), 1_000).when(F.regexp_extract(t, shape, 3) != "", 1)
    )
    return figure, F.when(ok, factor).cast("bigint")


def _log_like(x: np.ndarray, m: float, s: float, weight: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(weight) - 0.5 * ((x - m) / s) ** 2 - math.log(s)


def fit_mixture(centres: np.ndarray, counts: np.ndarray, offsets: Sequence[float], known: np.ndarray | None = None, known_counts: np.ndarray | None = None, prior: Sequence[float] | None = None, rounds: int = 200) -> dict:
    """EM for printed = true − offset, true ~ N(mu, sigma), over a histogram of log10 values.

    ``known`` are true log values (of rows that state their unit): they take part in mu and sigma with their
    component given, however few they are. ``prior`` is the share each component is expected to have; it counts as
    much as all open rows together. Of several starts the likeliest end wins. Without open rows the weights are
    the prior's, or equal.
    """
    off, n = np.asarray(offsets, float), float(np.sum(counts))
    known, known_counts = (np.zeros(0) if x is None else np.asarray(x, float) for x in (known, known_counts))
    sure = float(known_counts.sum())
    expected = np.full(len(off), 1 / len(off)) if prior is None else np.asarray(prior, float) / np.sum(prior)
    pseudo = 0.0 if prior is None else n
    if n + sure == 0:
        return {"mu": 0.0, "sigma": 1.0, "weights": expected.tolist()}
    true = centres[:, None] + off[None, :]

    def run(m: float, s: float) -> tuple[float, float, float, np.ndarray]:
        weight, level = expected, -np.inf
        for _ in range(rounds):
            like = _log_like(true, m, s, weight)
            top = like.max(1, keepdims=True)
            each = np.exp(like - top)
            total = each.sum(1, keepdims=True)
            post = each / total * counts[:, None]
            if n:
                weight = (post.sum(0) + pseudo * expected) / (n + pseudo)
            m = float(((post * true).sum() + (known * known_counts).sum()) / (n + sure))
            spread = (post * (true - m) ** 2).sum() + (known_counts * (known - m) ** 2).sum()
            s = max(0.05, math.sqrt(float(spread / (n + sure))))
            before, level = level, float(((np.log(total) + top)[:, 0] * counts).sum() + (known_counts * (-0.5 * ((known - m) / s) ** 2 - math.log(s))).sum())
            if level - before < 1e-9 * abs(level):
                break
        return level, m, s, weight

    starts = [float((known * known_counts).sum() / sure)] if sure else []
    if n:
        middle = centres[min(np.searchsorted(np.cumsum(counts), n / 2), len(centres) - 1)]
        starts += [middle + o for o in off]
    _, m, s, weight = max((run(x, s) for x in starts for s in (0.3, 0.6, 1.0)), key=lambda r: r[0])
    return {"mu": m, "sigma": s, "weights": weight.tolist()}


def fit_sources(rows: DataFrame, conventions: dict[str, int] | None = None, factors: Sequence[int] = FACTORS, bin_width: float = 0.02) -> DataFrame:
    """(source, mu, sigma, weights): the mixture of each source, from rows (source, log, stated).

    A source is a histogram of at most a few thousand bins before it reaches Python, whatever its number of rows.
    """
    conventions, offsets = dict(conventions or {}), [math.log10(f) for f in factors]
    bins = rows.where("log is not null").groupBy("source", "stated", F.round(F.col("log") / bin_width).cast("int").alias("bin")).agg(F.count("*").alias("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        source = pdf["source"].iloc[0]
        said = pdf["stated"].notna()
        known, open_ = pdf[said], pdf[~said]
        true = known["bin"].to_numpy(float) * bin_width + np.log10(known["stated"].to_numpy(float))
        given = conventions.get(source)
        prior = None if given is None else [float(f == given) * len(factors) * 1e6 + 1 for f in factors]
        m = fit_mixture(open_["bin"].to_numpy(float) * bin_width, open_["n"].to_numpy(float), offsets, true, known["n"].to_numpy(float), prior)
        return pd.DataFrame({"source": [source], "mu": [m["mu"]], "sigma": [m["sigma"]], "weights": [m["weights"]]})

    # bins come in any order; sorted, the sums are the same on every attempt
    return bins.groupBy("source").applyInPandas(lambda p: fit(p.sort_values(["stated", "bin"])), "source string, mu double, sigma double, weights array<double>")


def harmonise(rows: DataFrame, conventions: dict[str, int] | None = None, factors: Sequence[int] = FACTORS, sure: float = 0.95, bin_width: float = 0.02, small: int = 10_000) -> DataFrame:
    """Rows (source, key, figure DECIMAL, own BIGINT, near BIGINT) with their amount in the common unit.

    A stated unit (own, then near) counts; every other row gets the unit of the highest posterior under its
    source's mixture, in which the source's convention is the prior weight. Adds ``factor``, ``unit_source`` (own, near,
    mixture), ``posterior`` of that factor, ``uncertain`` and ``amount`` BIGINT. A row whose figure is NULL has no
    amount; it and a zero have no logarithm, so they get the likeliest unit of their source, flagged. A source
    without any figure has its convention, else the first factor. Repeated rows stay, a NULL source is a source; an
    empty table stays empty. Up to ``small`` sources the mixtures are broadcast, beyond that joined.
    """
    conventions = conventions or {}
    stated = F.coalesce("own", "near")
    rows = rows.withColumn("_log", F.when(F.abs("figure") > 0, F.log10(F.abs(F.col("figure").cast("double")))))
    models = fit_sources(rows.select("source", F.col("_log").alias("log"), stated.alias("stated")), conventions, factors, bin_width)
    few = models.limit(small + 1).collect()
    if len(few) <= small:
        models = F.broadcast(rows.sparkSession.createDataFrame(few, models.schema))
    models = models.withColumnsRenamed({"source": "_source", "mu": "_mu", "sigma": "_sigma", "weights": "_weights"})
    rows = rows.join(models, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")

    def by_factor(each) -> Column:
        return F.array(*[each(j, math.log10(f)) for j, f in enumerate(factors)])

    weight = lambda j: F.get("_weights", F.lit(j))
    likes = by_factor(lambda j, off: F.log(weight(j) + F.lit(1e-300)) - F.lit(0.5) * F.pow((F.coalesce("_log", F.col("_mu") - off) + F.lit(off) - F.col("_mu")) / F.col("_sigma"), 2.0))
    rows = rows.withColumn("_likes", likes)
    units_ = F.array(*[F.lit(int(f)).cast("bigint") for f in factors])
    guess = F.get(units_, (F.array_position("_likes", F.array_max("_likes")) - 1).cast("int"))
    given = F.create_map(*[F.lit(x) for kv in conventions.items() for x in (kv[0], int(kv[1]))]).cast("map<string,bigint>")[F.col("source")] if conventions else F.lit(None).cast("bigint")
    rows = rows.withColumn("factor", F.coalesce(stated, guess, given, F.lit(factors[0])).cast("bigint"))
    source = F.when(F.col("own").isNotNull(), "own").when(F.col("near").isNotNull(), "near").otherwise("mixture")
    at = (F.array_position(units_, F.col("factor")) - 1).cast("int")
    top = F.array_max("_likes")
    total = F.aggregate("_likes", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    posterior = F.when(F.col("_log").isNotNull() & (at >= 0), F.exp(F.get(F.col("_likes"), at) - top) / total)
    rows = rows.withColumns({"unit_source": source, "posterior": posterior})
    uncertain = ~F.col("unit_source").isin("own", "near") & (F.coalesce("posterior", F.lit(0.0)) < sure)
    amount = F.round(F.col("figure") * F.col("factor"), 0).try_cast("bigint")
    return rows.withColumns({"uncertain": uncertain, "amount": amount}).drop("_log", "_likes", "_mu", "_sigma", "_weights")


#: What an account table's figures are in when nothing says otherwise.
CONVENTIONS = {"report_accounts": 1, "comparative_rows": 1_000, "validation_defense": 1}


def stated_amounts(accounts: DataFrame, comparative: DataFrame, reports: DataFrame, truth: DataFrame) -> DataFrame:
    """(source, key, figure, own, near) of the three account tables; rows that state no amount have a NULL figure."""
    figure, beside = printed_amount(F.col("amount_text"))
    a = accounts.select(F.lit("report_accounts").alias("source"), F.col("account_id").alias("key"), figure.alias("figure"), F.coalesce(beside, stated_factor(F.col("unit_note")), label_factor(F.col("heading"))).alias("own"), F.lit(None).cast("bigint").alias("near"))
    head = reports.select(F.col("report_pkg").alias("_pkg"), statement_factor(F.col("head_text")).alias("near")).where("_pkg is not null").groupBy("_pkg").agg(F.max("near").alias("near"))
    c = comparative.select(F.lit("comparative_rows").alias("source"), F.col("row_id").alias("key"), F.col("committee_recommendation_thousands").cast("decimal(28,6)").alias("figure"), label_factor(F.col("item")).alias("own"), F.col("report_pkg").alias("_pkg"))
    c = c.join(head, "_pkg", "left").select("source", "key", "figure", "own", "near")
    t = truth.select(F.lit("validation_defense").alias("source"), F.col("validation_id").alias("key"), F.col("expected_amount").cast("decimal(28,6)").alias("figure"), F.coalesce(stated_factor(F.col("note")), label_factor(F.col("excel_name"))).alias("own"), F.lit(None).cast("bigint").alias("near"))
    return a.unionByName(c).unionByName(t)
