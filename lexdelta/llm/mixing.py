"""Mixing sources to target shares of tokens by Poisson replication.

Each document of a source is repeated a number of times drawn from a Poisson distribution whose
mean is the source's repetition rate, by inverting the distribution at a hash of the document and
a seed: the draw needs no state, no shuffle and comes out the same on every attempt. The distribution
is cut at the source's cap, and its parameter is raised so that the mean stays the rate.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexdelta.session import cut

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: how the public byte-level vocabulary splits text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(_id, _source, n_tokens) of whole texts; NULL and empty texts have no tokens.

    The vocabulary is read on the driver's machine and sent to the executors as a file of the job.
    """
    docs.sparkSession.sparkContext.addFile(os.path.join(tokenizers, vocabulary))
    key = docs.schema[doc_id].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(SparkFiles.get(vocabulary)).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["_id", "_source", "n_tokens"])

    lean = docs.select(F.col(doc_id), F.col(source).cast("string"), F.col(text).cast("string"))
    return lean.mapInArrow(count, f"_id {key}, _source string, n_tokens bigint")


def poisson_cdf(rate: float, cap: int) -> list[float]:
    """P(X <= j) for j < cap of min(Poisson, cap) with mean ``rate``; all zero where every draw is the cap."""
    if cap <= 0 or rate <= 0:
        return [1.0] * max(cap, 1)
    if rate >= cap * (1 - 1e-9):
        return [0.0] * cap
    j = np.arange(cap)
    factorials = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, cap)))])

    def cdf(lam: float) -> np.ndarray:
        return np.minimum(1.0, np.cumsum(np.exp(j * math.log(lam) - lam - factorials)))  # terms by logarithm: no rate is too high

    mean = lambda lam: cap - float(cdf(lam).sum())  # noqa: E731  E[min(X, cap)] = sum over j < cap of P(X > j)
    low, high = 1e-300, max(1.0, rate)
    while mean(high) < rate:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < rate else (low, mid)
    return cdf((low + high) / 2).tolist()


def plan_rates(targets: list[dict], tokens: dict[str, int], total: int | None = None) -> list[dict]:
    """The repetition rate of each (mix_name, source).

    Without ``total`` a mix is made as large as its shares allow with no source over its cap; with it,
    sources that would be over their cap are held there. Sources without tokens cannot be reached;
    the shares of the others are kept in proportion.
    """
    out = []
    for mix in sorted({t["mix_name"] for t in targets}):
        rows = [t for t in targets if t["mix_name"] == mix]
        live = [t for t in rows if tokens.get(t["source"], 0) > 0 and (t["target_share"] or 0) > 0 and (t["max_repeats"] or 0) > 0]
        share = sum(t["target_share"] for t in live)
        size = total if total is not None else min((t["max_repeats"] * tokens[t["source"]] * share / t["target_share"] for t in live), default=0)
        for t in rows:
            rate = min(t["max_repeats"], size * t["target_share"] / share / tokens[t["source"]]) if t in live else 0.0
            cap = int(t["max_repeats"] or 0)
            out.append({"mix_name": mix, "source": t["source"], "target_share": t["target_share"], "max_repeats": cap, "rate": float(rate), "cdf": poisson_cdf(rate, cap) if t in live else [1.0] * max(cap, 1)})
    return out


class Mixture:
    """Documents mixed to the shares in ``targets`` (mix_name, source, target_share, max_repeats).

    ``targets`` is a small stated table and is read whole. Documents of sources that no mix names, and
    of no source, are left out; repeated document ids draw the same count; an empty corpus gives an
    empty mix with reached shares of 0.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", total: int | None = None, seed: int = 7, tokenizers: str = TOKENIZERS) -> None:
        self.spark, self.seed = docs.sparkSession, seed
        self.counts = cut(token_counts(docs, doc_id, source, text, tokenizers), "tokens")
        wanted = [r.asDict() for r in targets.select("mix_name", "source", "target_share", "max_repeats").where("mix_name is not null and source is not null").distinct().collect()]
        named = targets.select(F.col("source").alias("_source")).where("_source is not null").distinct()
        sums = self.counts.join(named, "_source").groupBy("_source").agg(F.sum("n_tokens").alias("n")).collect()  # a row a named source
        self.rates = plan_rates(wanted, {r["_source"]: r["n"] for r in sums})
        self.docs = docs.select(F.col(doc_id).alias("_id"), F.col(source).cast("string").alias("_source"), F.col(text).alias("_text"))

    def _drawn(self, rows: DataFrame) -> DataFrame:
        """``rows`` once for each mix that names their source, with the number of copies ``_n``."""
        table = self.spark.createDataFrame([(r["mix_name"], r["source"], r["cdf"]) for r in self.rates], "_mix string, _source string, _cdf array<double>")
        out = rows.join(F.broadcast(table) if sum(len(r["cdf"]) for r in self.rates) <= 1_000_000 else table, "_source")
        u = F.shiftrightunsigned(F.xxhash64("_id", "_mix", F.lit(self.seed)), 11) / F.lit(float(1 << 53))
        out = out.withColumn("_u", u)
        return out.withColumn("_n", F.size(F.filter("_cdf", lambda c: c <= F.col("_u")))).drop("_cdf", "_u")

    def mixed(self) -> DataFrame:
        """(mix_name, source, doc_id, copy_no, text), shuffled over the whole mix by a seeded hash."""
        rows = self._drawn(self.docs).where("_n > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_n"))))
        rows = rows.withColumn("_at", F.xxhash64("_id", "_mix", "copy_no", F.lit(self.seed + 1)))
        rows = rows.select(F.col("_mix").alias("mix_name"), F.col("_source").alias("source"), F.col("_id").alias("doc_id"), "copy_no", F.col("_text").alias("text"), "_at")
        return rows.repartition("_at").sortWithinPartitions("_at").drop("_at")

    def shares(self) -> DataFrame:
        """(mix_name, source, target_share, reached_share, n_tokens, mean_repeats) from the token counts alone."""
        per = self._drawn(self.counts).groupBy("_mix", "_source").agg(F.sum(F.col("n_tokens") * F.col("_n")).alias("t"), F.avg("_n").alias("m"))
        plan = self.spark.createDataFrame([(r["mix_name"], r["source"], float(r["target_share"] or 0), r["max_repeats"]) for r in self.rates], "mix_name string, source string, target_share double, max_repeats int")
        out = plan.join(per, (plan["mix_name"] == per["_mix"]) & (plan["source"] == per["_source"]), "left").withColumn("n_tokens", F.coalesce("t", F.lit(0)))
        sums = out.groupBy("mix_name").agg(F.sum("n_tokens").alias("_all"))
        out = out.join(sums, "mix_name").withColumn("reached_share", F.when(F.col("_all") > 0, F.col("n_tokens") / F.col("_all")).otherwise(0.0))
        return out.select("mix_name", "source", "target_share", F.round("reached_share", 6).alias("reached_share"), "n_tokens", F.round(F.coalesce("m", F.lit(0.0)), 6).alias("mean_repeats"), "max_repeats")
