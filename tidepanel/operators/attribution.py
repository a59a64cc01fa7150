"""Exact attributions of tree-ensemble predictions: Shapley values of every row, from all paths of all trees.

For one leaf the value of a set of known features is the leaf's prediction times, per feature on its path, one or zero
if the feature is known (whether the row takes the path there) and the share of training rows that take it if not.
That is a product, so its Shapley values depend on the row only by which path features it meets: one table per leaf,
looked up for whole batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.operators.selection import family
from tidepanel.session import scratch_path

#: Numbers that an ensemble may have to be broadcast (8 bytes each), and path features of a leaf that get a table.
MOST_NUMBERS, TABLE_FEATURES = 8_000_000, 10


@dataclass
class Leaf:
    """Value times weight of the tree, path features with their intervals (low, high] and cover shares."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    table: np.ndarray | None = None


def _shapley(met: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley values of the product game, rows x features, for a rows x features matrix of met conditions."""
    n, d = met.shape
    weight = [math.factorial(s) * math.factorial(d - 1 - s) / math.factorial(d) for s in range(d)]
    out = np.empty((n, d))
    for j in range(d):
        poly = np.zeros((n, d))                          # coefficient s: s of the other features known
        poly[:, 0] = 1
        for i in range(d):
            if i != j:
                grown = poly * share[i]
                grown[:, 1:] += poly[:, :-1] * met[:, i:i + 1]
                poly = grown
        out[:, j] = (met[:, j] - share[j]) * (poly @ weight)
    return out


def _leaves(nodes: dict, weight: float) -> list[Leaf]:
    """Leaves of one tree; ``nodes`` by id: prediction, cover, feature, threshold, left, right (left -1 for a leaf)."""
    out, stack = [], [(0, {}, {})]
    while stack:
        i, spans, shares = stack.pop()
        prediction, cover, feature, threshold, left, right = nodes[i]
        if left < 0:
            f = np.array(sorted(spans), np.int64)
            leaf = Leaf(weight * prediction, f, np.array([spans[x][0] for x in f]), np.array([spans[x][1] for x in f]), np.array([shares[x] for x in f]))
            if 0 < len(f) <= TABLE_FEATURES:
                codes = np.arange(1 << len(f))
                leaf.table = leaf.value * _shapley((codes[:, None] >> np.arange(len(f)) & 1).astype(float), leaf.share)
            out.append(leaf)
            continue
        low, high = spans.get(feature, (-np.inf, np.inf))
        for child, span in ((left, (low, min(high, threshold))), (right, (max(low, threshold), high))):
            stack.append((child, spans | {feature: span}, shares | {feature: shares.get(feature, 1.0) * nodes[child][1] / cover}))
    return out


@dataclass
class Explainer:
    """All leaves of an ensemble over ``names``, and its expected prediction."""

    names: list[str]
    leaves: list[Leaf]
    base: float

    def explain(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape)
        for leaf in self.leaves:
            if not len(leaf.features):
                continue
            part = x[:, leaf.features]
            met = (part > leaf.low) & (part <= leaf.high)
            if leaf.table is not None:
                out[:, leaf.features] += leaf.table[met @ (1 << np.arange(len(leaf.features)))]
            else:
                out[:, leaf.features] += leaf.value * _shapley(met.astype(float), leaf.share)
        return out


def explainer(model, names: list[str]) -> Explainer:
    """From a fitted MLlib forest or boosted model (or a pipeline that ends in one) over the inputs ``names``, in order.

    The model's own table of nodes is read; one with more than MOST_NUMBERS numbers is refused.  Splits on categories
    are not supported.  Cover is the number of training rows of a node.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    trees = model.stages[-1] if hasattr(model, "stages") else model
    path = scratch_path(spark, "trees")
    trees.write().overwrite().save(path)
    weights = [float(w) for w in trees.treeWeights]
    scale = sum(weights) if type(trees).__name__.startswith("RandomForest") else 1.0
    table = spark.read.parquet(f"{path}/data")
    nodes = table.select("treeID", "nodeData.id", "nodeData.prediction", "nodeData.rawCount", "nodeData.split.featureIndex", "nodeData.split.leftCategoriesOrThreshold", "nodeData.split.numCategories", "nodeData.leftChild", "nodeData.rightChild")
    if nodes.count() * 8 > MOST_NUMBERS:
        raise ValueError("the ensemble is too large to broadcast")
    by_tree: dict[int, dict] = {}
    for r in nodes.collect():
        if r["leftChild"] >= 0 and r["numCategories"] != -1:
            raise ValueError("splits on categories are not supported")
        cut = r["leftCategoriesOrThreshold"][0] if r["leftChild"] >= 0 else 0.0
        by_tree.setdefault(r["treeID"], {})[r["id"]] = (r["prediction"], max(float(r["rawCount"]), 1e-12), r["featureIndex"], cut, r["leftChild"], r["rightChild"])
    leaves = [leaf for t, n in sorted(by_tree.items()) for leaf in _leaves(n, weights[t] / scale)]
    numbers = sum(leaf.table.size if leaf.table is not None else 0 for leaf in leaves)
    if numbers > MOST_NUMBERS:
        raise ValueError("the ensemble is too large to broadcast")
    return Explainer(list(names), leaves, float(sum(leaf.value * leaf.share.prod() for leaf in leaves)))


def attributions(rows: DataFrame, known: Explainer, keys: list[str]) -> DataFrame:
    """(keys, feature, value, contribution) for every row and input; rows with a null input are left out.

    Contributions of a row and the explainer's base add up to the prediction.
    """
    shared = rows.sparkSession.sparkContext.broadcast(known)      # MOST_NUMBERS numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(shared.value.names)
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            c = shared.value.explain(x) if len(x) else x
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(b.num_columns - 1)], b.column("x"), pa.array(c.tolist(), pa.list_(pa.float64()))], names=[*keys, "x", "c"])

    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    d = rows.dropna(subset=known.names).select(*keys, F.array(*[F.col(c).cast("double") for c in known.names]).alias("x"))
    out = d.mapInArrow(run, ", ".join([*[f"`{c}` {fields[c]}" for c in keys], "x array<double>", "c array<double>"]))
    names = F.array(*[F.lit(c) for c in known.names])
    return out.select(*keys, F.explode(F.arrays_zip(names.alias("feature"), F.col("x").alias("value"), F.col("c").alias("contribution"))).alias("p")).select(*keys, "p.feature", "p.value", "p.contribution")


def family_attribution(parts: DataFrame, by: list[str]) -> DataFrame:
    """(by, family, features, weight, share): mean absolute contribution of each feature, added up by family."""
    mean = parts.groupBy(*by, "feature").agg(F.avg(F.abs("contribution")).alias("_m"))
    g = mean.groupBy(*by, family(F.col("feature")).alias("family")).agg(F.count(F.lit(1)).alias("features"), F.sum("_m").alias("weight"))
    total = g.groupBy(*by).agg(F.sum("weight").alias("_t"))
    return g.join(total, by).withColumn("share", F.try_divide("weight", "_t")).drop("_t")
