"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import random_key, spread_rank, stored

#: Groups of input partitions that are dealt separately; bounds the matrix at ORIGINS x shards counts.
ORIGINS = 2048


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Number of good items among ``draws`` drawn without replacement; any size.

    numpy draws up to a thousand million items.  Beyond, the distribution is inverted over twelve standard
    deviations around its mean, its ratios of neighbouring probabilities being simple fractions.
    """
    total = good + bad
    if total < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws)) if draws else 0
    low, high = max(0, draws - bad), min(good, draws)
    mean = draws * good / total
    spread = math.sqrt(max(1.0, mean * (bad / total) * (total - draws) / (total - 1)))
    low, high = max(low, int(mean - 12 * spread)), min(high, int(mean + 12 * spread) + 1)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    log_p = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.exp(log_p - log_p.max())
    return low + int(np.searchsorted(np.cumsum(p), rng.random() * p.sum()))


def multivariate(rng: np.random.Generator, colours: np.ndarray, draws: int) -> np.ndarray:
    """How many of each colour are among ``draws`` items taken without replacement."""
    out = np.zeros(len(colours), dtype=np.int64)
    rest = int(colours.sum())
    for i, c in enumerate(colours):
        rest -= int(c)
        out[i] = hypergeometric(rng, int(c), rest, draws) if rest else draws
        draws -= int(out[i])
    return out


def communication_matrix(rows: np.ndarray, capacities: np.ndarray, seed: int) -> np.ndarray:
    """matrix[p, s]: rows that partition p sends to shard s, as under one uniform permutation of all rows.

    Row sums are ``rows`` and column sums ``capacities``: each partition in turn draws, without replacement, from
    the places that the earlier ones have left.
    """
    left = np.array(capacities, dtype=np.int64)
    out = np.zeros((len(rows), len(left)), dtype=np.int64)
    for p, n in enumerate(rows):
        out[p] = multivariate(np.random.default_rng([seed, p]), left, int(n))
        left -= out[p]
    return out


def shuffle_into_shards(df: DataFrame, n_shards: int, keep: list[str], seed: int = 7) -> DataFrame:
    """Deal all rows into ``n_shards`` shards whose row counts differ by at most one, in uniformly random order.

    Adds ``shard`` (int) and ``slot`` (bigint, gapless from 0 in each shard) to the columns ``keep``.  Rows are
    told apart by their place in the input, so nulls, ties and repeated rows are dealt like any other; an empty
    table gives an empty result, and with fewer rows than shards the last shards stay empty.  The first pass is
    written to the shared folder, so that a lost executor cannot change the deal.
    """
    spark = df.sparkSession
    tagged = stored(df.select(*keep)
                      .withColumn("_row", F.monotonically_increasing_id())
                      .withColumn("_origin", F.pmod(F.spark_partition_id(), F.lit(ORIGINS)).cast("int")), "deal")
    counts = {r["_origin"]: r["n"] for r in tagged.groupBy("_origin").agg(F.count(F.lit(1)).alias("n")).collect()}
    origins = sorted(counts)
    total = sum(counts.values())
    capacities = np.array([(total + n_shards - 1 - s) // n_shards for s in range(n_shards)])
    matrix = communication_matrix(np.array([counts[o] for o in origins], dtype=np.int64), capacities, seed)
    bounds = spark.createDataFrame([(o, np.cumsum(m).tolist()) for o, m in zip(origins, matrix)], "_o int, _bounds array<bigint>")
    keyed = tagged.withColumn("_k1", random_key(seed, F.col("_row"))).withColumn("_k2", random_key(seed + 1, F.col("_row")))
    local = spread_rank(keyed, ["_origin"], "_k1", ["_row"], total, rank="_place")
    sent = (local.join(F.broadcast(bounds), F.col("_origin") == F.col("_o"))   # ORIGINS x n_shards counts at most
                 .withColumn("shard", F.expr("size(filter(_bounds, x -> x <= _place))")))
    return spread_rank(sent.drop("_o", "_bounds"), ["shard"], "_k2", ["_row"], total, rank="slot").select(*keep, "shard", "slot")


def shard_documents(docs: DataFrame, n_shards: int = 40, seed: int = 7) -> DataFrame:
    """Shard documents: doc_id, size (UTF-8 bytes + 16), text_crc32, law, shard, slot, grown_shard.

    A null or empty text has size 16 and checksum 0.  The law is ``rows``.
    Other columns of the input are ignored.
    """
    slim = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("bigint").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    out = shuffle_into_shards(slim, n_shards, ["doc_id", "size", "text_crc32"], seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
