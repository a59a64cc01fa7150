"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import n_words, random_key, spread_rank, stored
from tidepanel.llm.sharding import multivariate

#: Words in a block where documents aren't to be split: more than any document has.
WHOLE = 1 << 40
#: Neighbouring documents of a shard that are written together.
RUN = 5_000
#: A document is taken at most so many times.
MOST = 3


def targets(sizes: dict, weights=(1, 2, 3), most: int = MOST) -> dict:
    """Words per source: shares of the total by weight, none above ``most`` times its size.

    Sources in code-point order, null last, take the weights in turn; what a capped source leaves is shared again
    by weight among the others until none is above its cap.
    """
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, rest = {}, list(names), Fraction(sum(sizes.values()))
    while free:
        unit = rest / sum(weight[s] for s in free)
        over = [s for s in free if unit * weight[s] > most * sizes[s]]
        if not over:
            return out | {s: unit * weight[s] for s in free}
        for s in over:
            out[s] = Fraction(most * sizes[s])
            rest -= out[s]
        free = [s for s in free if s not in out]
    return out


def splitting_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """counts[shard, source]: blocks of each source in each shard, near-equal shards, as under a uniform shuffle.

    The shards are halved again and again; the left half's share of the node's blocks is drawn from the node's
    quotas without replacement, so the counts of the leaves add up to the quotas exactly.
    """
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    nodes = [(0, shards, np.array(quotas, dtype=np.int64))]
    while nodes:
        low, high, q = nodes.pop()
        if high - low == 1:
            out[low] = q
            continue
        mid = (low + high) // 2
        left = multivariate(np.random.default_rng([seed, low, high]), q, int(q.sum()) * (mid - low) // (high - low))
        nodes += [(low, mid, left), (mid, high, q - left)]
    return out


def source_plan(slim: DataFrame, weights) -> tuple[DataFrame, int]:
    """One row per source: size, target, full copies and words to draw beyond them; and the number of documents.

    Only one aggregate row per source reaches the driver.
    """
    stats = slim.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    sizes = {r["source"]: int(r["size"]) for r in stats}
    plan = []
    for s, t in targets(sizes, weights).items():
        words = round(t)
        full = words // sizes[s] if sizes[s] else 0
        plan.append((s, sizes[s], float(t), full, words - full * sizes[s]))
    schema = "p_source string, source_size bigint, target double, full int, more bigint"
    return slim.sparkSession.createDataFrame(plan, schema), sum(r["n"] for r in stats)


def mix(docs: DataFrame, keep=("doc_id",), shards: int = 32, weights=(1, 2, 3), block_words: int = WHOLE, seed: int = 11, cut: bool = True) -> tuple[DataFrame, DataFrame]:
    """(documents, blocks) of the mix.

    documents: the columns ``keep`` plus ``_row``, source, size, source_size and target.  blocks, one row
    per block and time it is taken: _row, source, copy, start (word), words, shard, slot.  A block is a whole document
    unless ``block_words`` is less than its size.  A source whose target
    is T and size S gives every block T div S times, and T mod S further words from its blocks in random order.  With
    ``cut`` the last one is cut where the target is met: words taken differ from the target by rounding only; else it
    is taken whole or left, whichever is nearer to the target.  Null or empty
    texts have size 0, give no block and stay in documents; a null source is a source of its own; repeated rows
    are separate documents.  A source without words has target 0.

    Draws hang on what a row holds (``keep``, source, text) and its number among identical rows, so reruns agree
    however the input is split.
    """
    spark = docs.sparkSession
    told = docs.select(*keep, "source", n_words(F.col("text")).alias("size"), F.xxhash64(*keep, "source", "text").alias("_hash"))
    alike = told.groupBy(*keep, "source", "size", "_hash").agg(F.count(F.lit(1)).alias("_n"))
    slim = stored(alike.withColumn("_same", F.explode(F.expr("sequence(1, _n)"))).drop("_n").withColumn("_row", F.monotonically_increasing_id()), "mix")
    plan, total = source_plan(slim, weights)
    plan = stored(plan, "plan")
    known = slim.join(plan, F.col("source").eqNullSafe(F.col("p_source")), "left").drop("p_source")
    own = ("_hash", "_same", "block")                    # what draws and ties hang on; _row only joins
    pieces = (known.where("size > 0")
                   .select("_row", "_hash", "_same", "source", "size", "full", "more",
                           F.explode(F.expr(f"sequence(0, cast((size - 1) div {block_words} as int))")).alias("block"))
                   .withColumn("start", F.col("block").cast("bigint") * block_words)
                   .withColumn("words", F.least(F.col("size") - F.col("start"), F.lit(block_words)))
                   .withColumn("key", random_key(seed, *map(F.col, own))))
    beyond = spread_rank(pieces.where("more > 0"), ["source"], "key", own, total, weight="words")
    last = F.least(F.col("words"), F.col("more") - F.col("before"))
    drawn = beyond.where("before < more").withColumn("words", last) if cut else beyond.where("2 * (more - before) >= words")
    drawn = drawn.withColumn("copy", F.col("full")).drop("rank", "before")
    full = pieces.where("full > 0").withColumn("copy", F.explode(F.expr("sequence(0, full - 1)")))
    taken = stored(full.unionByName(drawn).select("_row", "_hash", "_same", "source", "block", "copy", "start", "words"), "taken")

    quotas = {r["source"]: r["n"] for r in taken.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(quotas, key=lambda s: (s is None, s or ""))
    counts = splitting_tree(np.array([quotas[s] for s in names], dtype=np.int64), shards, seed)
    bounds = stored(spark.createDataFrame([(s, np.cumsum(counts[:, i]).tolist()) for i, s in enumerate(names)], "b_source string, bounds array<bigint>"), "bounds")
    blocks = sum(quotas.values())
    own = (*own, "copy")
    again = taken.withColumn("key", random_key(seed + 1, *map(F.col, own)))
    ranked = spread_rank(again, ["source"], "key", own, blocks)
    dealt = (ranked.join(bounds, F.col("source").eqNullSafe(F.col("b_source")))
                   .withColumn("shard", F.expr("size(filter(bounds, x -> x <= rank))"))
                   .withColumn("key", random_key(seed + 2, *map(F.col, own))))
    placed = spread_rank(dealt.drop("bounds", "b_source", "rank"), ["shard"], "key", own, blocks, rank="slot")
    return known.drop("full", "more", "_hash", "_same"), placed.select("_row", "source", "copy", "start", "words", "shard", "slot")


def taken_per_document(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """Words the mix takes of each document, repeats counted, and where it puts them: _row, taken and ``places``
    (shard, slot, copy, start, words), in order; no places for a document that isn't taken."""
    sums = blocks.groupBy(F.col("_row").alias("_r")).agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("shard", "slot", "copy", "start", "words"))).alias("places"))
    return (documents.join(sums, F.col("_row") == F.col("_r"), "left")
                     .withColumns({"taken": F.coalesce("taken", F.lit(0)).cast("bigint"), "places": F.coalesce("places", F.array())}).drop("_r"))


def first_words(text, n):
    """The text up to and with its n-th word."""
    rest = F.regexp_replace(text, r"^[\x20\x09-\x0D]+", "")
    return F.rtrim(F.substring(rest, F.lit(1), F.length(rest) - F.length(F.element_at(F.split(rest, r"[\x20\x09-\x0D]+", n + 1), (n + 1).cast("int")))))


def mixed_documents(docs: DataFrame, shards: int = 32, weights=(1, 2, 3), seed: int = 11, cut: bool = False) -> DataFrame:
    """The mix itself: a row of ``docs`` for every time a document is taken, with its shard and slot, in runs of RUN
    neighbours of a shard, in the order of the slots.

    Documents stay whole: the one at which its source's target is met is taken or left, whichever is nearer.  With
    ``cut`` it ends after the word that meets the target. Columns are those of ``docs`` plus shard and slot (which
    replace columns of these names); documents that the mix doesn't take are left out.
    """
    key = F.xxhash64("doc_id", "text", "source")
    documents, blocks = mix(docs.select("source", "text", key.alias("_key")), ["_key"], shards, weights, seed=seed, cut=cut)
    rows = documents.select(F.col("_row").alias("_r"), "_key", "size")
    chosen = blocks.join(rows, F.col("_row") == F.col("_r")).select(F.col("_key").alias("_k"), *[F.col(c).alias(f"_mix_{c}") for c in ("size", "words", "shard", "slot")])
    once = docs.withColumn("_key", key).dropDuplicates(["_key"])         # equal rows are chosen by the same key
    if cut:
        whole = F.col("_mix_words") == F.col("_mix_size")
        text = F.when(whole, F.col("text")).otherwise(first_words(F.col("text"), F.col("_mix_words").cast("int")))
    else:
        text = F.col("text")
    out = once.join(chosen, F.col("_key") == F.col("_k")).withColumn("text", text)
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    placed = out.select(*own, F.col("_mix_shard").alias("shard"), F.col("_mix_slot").alias("slot"))
    run = F.floor(F.col("slot") / RUN)                   # a shard may be larger than a task
    return placed.repartition("shard", run).sortWithinPartitions("shard", "slot")
