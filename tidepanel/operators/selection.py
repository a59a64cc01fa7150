"""Correlations and feature selection.

Correlations never emit pairs of rows: the (listed) targets become columns of a one-row-per-day table,
candidates stay long, and one grouped aggregate yields a candidate's correlation with every target.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.normal import corr_sql, safe_corr


def targets_wide(panel: DataFrame, targets: list[str], key="series", value="y", on="ds") -> DataFrame:
    names = ", ".join(f"'{t}'" for t in targets)
    return panel.filter(f"{key} IN ({names})").groupBy(on).agg(*[F.expr(f"max({value}) FILTER (WHERE {key} = '{t}') AS _t{i}") for i, t in enumerate(targets)])


def correlate_to_targets(candidates: DataFrame, target_panel: DataFrame, targets: list[str], key="series", value="y", on="ds") -> DataFrame:
    """(target, candidate, corr) for every listed target and every candidate series."""
    j = candidates.select(F.col(key).alias("candidate"), F.col(value).alias("_v"), on).join(targets_wide(target_panel, targets, key, value, on), on)
    g = j.groupBy("candidate").agg(*[F.expr(f"{corr_sql('_v', f'_t{i}')} AS _c{i}") for i in range(len(targets))])
    cells = ", ".join(f"'{t}', _c{i}" for i, t in enumerate(targets))
    return g.selectExpr("candidate", f"stack({len(targets)}, {cells}) AS (target, corr)").select("target", "candidate", "corr")


def correlate_pairs(panel: DataFrame, pairs: list[tuple[str, str]], key="series", value="y", on="ds") -> DataFrame:
    """(target, candidate, corr) in both directions for the wanted pairs of listed series.

    One row per day holds all listed series, and one aggregate over the days gives every pair's correlation: nothing
    is joined and no rows are paired.  The aggregate grows with the list of pairs, so this is for short lists."""
    names = list(dict.fromkeys(n for p in pairs for n in p))
    at = {n: f"_t{i}" for i, n in enumerate(names)}
    g = targets_wide(panel, names, key, value, on).agg(*[F.expr(f"{corr_sql(at[a], at[b])} AS _c{i}") for i, (a, b) in enumerate(pairs)])
    cells = ", ".join(f"'{a}', '{b}', _c{i}, '{b}', '{a}', _c{i}" for i, (a, b) in enumerate(pairs))
    return g.selectExpr(f"stack({2 * len(pairs)}, {cells}) AS (target, candidate, corr)")


def same_depth_leaves(nodes: DataFrame) -> DataFrame:
    """(node, depth, peers): leaves with the number of other leaves of their depth; ``nodes`` has one row per node."""
    parents = nodes.select(F.substring_index("node", ".", -1).alias("_l"), "node").select(F.expr("left(node, length(node) - length(_l) - 1)").alias("node")).filter("node <> ''").distinct()
    leaf = nodes.join(parents, "node", "left_anti").withColumn("depth", F.size(F.split("node", r"\.")))
    by_depth = leaf.groupBy("depth").agg((F.count(F.lit(1)) - 1).alias("peers"))
    return leaf.join(by_depth, "depth").select("node", "depth", "peers")


def top_correlated(pairs: DataFrame, k: int = 30) -> DataFrame:
    w = Window.partitionBy("target").orderBy(F.abs("corr").desc(), "candidate")
    return pairs.filter("corr is not null and target <> candidate").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def average_rank(value, keys: list[str]) -> Column:
    """Rank inside a small group (days of a series), ties averaged."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2


def long_features(df: DataFrame, columns: list[str], keys=("series", "ds"), value: str = "y") -> DataFrame:
    """One row per series, day and feature with the target's rank; missing feature values count as 0."""
    wide = df.selectExpr(*keys, value, *[f"coalesce(CAST({c} AS DOUBLE), 0D) AS {c}" for c in columns]).withColumn("ry", average_rank(value, [keys[0]]))
    return wide.drop(value).unpivot([*keys, "ry"], columns, "feature", "x")


def feature_ranks(long_df: DataFrame) -> DataFrame:
    return long_df.withColumn("rx", average_rank("x", ["series", "feature"]))


def spearman_relevance(ranks: DataFrame) -> DataFrame:
    return ranks.groupBy("series", "feature").agg(F.coalesce(F.abs(safe_corr(F.col("rx"), F.col("ry"))), F.lit(0.0)).alias("score"))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("series").orderBy(F.desc("score"), "feature")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mrmr_select(ranks: DataFrame, k: int, beta: float = 1.0, shortlist: int | None = None) -> DataFrame:
    """Greedy selection by relevance minus mean redundancy with what is already chosen.

    All candidates compete unless ``shortlist`` names how many of the most relevant do.  Spark ranks the features; a
    task then sees one series' matrix of days x candidates, which daily grain and the fixed pool of features keep
    small however many series there are."""
    rel = spearman_relevance(ranks)
    if beta == 0:
        return top_k(rel, k).select("series", F.col("rank").alias("step"), "feature", "score")
    w = Window.partitionBy("series").orderBy(F.desc("score"), "feature")
    short = (top_k(rel, shortlist) if shortlist else rel.withColumn("rank", F.row_number().over(w))).alias("short")
    cut = ranks.join(short.select("series", "feature", "rank"), ["series", "feature"])
    rows = cut.groupBy(F.col("series").alias("owner"), "ds").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "rx"))), lambda x: x["rx"]).alias("r"))

    def greedy(days: pd.DataFrame, feats: pd.DataFrame) -> pd.DataFrame:
        feats = feats.sort_values("rank")
        rel_, names = feats["score"].to_numpy(), list(feats["feature"])
        m = np.stack(days["r"].to_numpy()).astype(float)
        m -= m.mean(axis=0)
        norm = np.sqrt((m * m).sum(axis=0))
        z = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
        red, picked = np.zeros(len(names)), [0]
        while len(picked) < min(k, len(names)):
            red += np.abs(z.T @ z[:, picked[-1]])
            gain = rel_ - beta * red / len(picked)
            gain[picked] = -np.inf
            picked.append(int(np.argmax(gain)))
        return pd.DataFrame({"series": feats["series"].iloc[0], "step": range(1, len(picked) + 1), "feature": [names[i] for i in picked], "score": rel_[picked]})

    return rows.groupBy("owner").cogroup(short.groupBy("series")).applyInPandas(greedy, "series string, step int, feature string, score double")


def volatility_quota(scores: DataFrame, is_priority: Column, k: int, quota: int) -> DataFrame:
    """Top-k by score in which at least ``quota`` priority features have a place."""
    by = Window.partitionBy("series").orderBy(F.desc("score"), "feature")
    s = scores.withColumn("_p", is_priority.cast("int")).withColumn("_rk", F.row_number().over(by)).withColumn("_in", (F.col("_rk") <= k).cast("int"))
    all_ = Window.partitionBy("series")
    s = s.withColumn("_need", F.lit(quota) - F.sum(F.col("_p") * F.col("_in")).over(all_))
    grp = Window.partitionBy("series", "_p", "_in")
    s = s.withColumn("_best", F.row_number().over(grp.orderBy(F.desc("score"), "feature"))).withColumn("_worst", F.row_number().over(grp.orderBy("score", F.desc("feature"))))
    add = (F.col("_p") == 1) & (F.col("_in") == 0) & (F.col("_best") <= F.col("_need"))
    s = s.withColumn("_add", add.cast("int")).withColumn("_n_add", F.sum("_add").over(all_))
    drop = (F.col("_p") == 0) & (F.col("_in") == 1) & (F.col("_worst") <= F.col("_n_add"))
    keep = s.filter((F.col("_add") == 1) | ((F.col("_in") == 1) & ~drop))
    return keep.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("series", "feature", "score", "rank")


def mean_pairwise_corr(panel: DataFrame, n_series: int, key="series", value="y", min_rows: int = 30) -> DataFrame:
    """Average Spearman correlation of daily changes over all pairs of series, clipped to [0, 1].

    With unit-norm ranks z, the pair sum is the sum over days of (sum z)^2 - sum z^2: no pairs are formed."""
    w = Window.partitionBy(key).orderBy("ds")
    d = panel.withColumn("d", F.col(value) - F.lag(value, 1).over(w)).filter("d is not null")
    d = d.withColumn("r", average_rank("d", [key]))
    all_ = Window.partitionBy(key)
    d = d.withColumn("z", F.try_divide(F.col("r") - F.avg("r").over(all_), F.stddev_pop("r").over(all_) * F.sqrt(F.count(F.lit(1)).over(all_))))
    day = d.groupBy("ds").agg(F.sum("z").alias("s"), F.sum(F.col("z") * F.col("z")).alias("q"))
    mean = F.sum(F.col("s") * F.col("s") - F.col("q")) / (n_series * (n_series - 1))
    return day.agg(F.count(F.lit(1)).alias("days"), F.when(F.count(F.lit(1)) >= min_rows, F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean))).otherwise(0.0).alias("rho"))


# Feature families in the order in which they are tried.
FAMILIES = (
    ("Market", "^ext_"), ("Interaction", "_x_"), ("Lag", "^lag_"), ("Rolling statistics", "^rolling_"),
    ("Exponentially weighted mean", "^ewm_"), ("Difference and percentage change", "^value_"),
    ("Volatility and range", "volatil|price_position|max_change|min_change|change_range"),
    ("Extreme value and jump", "z_score|is_extreme|jump"), ("Technical indicator", "^(rsi|bb_|macd)"),
    ("Calendar and Fourier", ""),
)


def family(feature: Column) -> Column:
    out = None
    for name, pattern in FAMILIES:
        out = F.when(feature.rlike(pattern), name) if out is None else out.when(feature.rlike(pattern), name)
    return out


def family_shares(scores: DataFrame) -> DataFrame:
    g = scores.groupBy("series", family(F.col("feature")).alias("family")).agg(F.sum("score").alias("weight"), F.count(F.lit(1)).alias("features"))
    return g.withColumn("share", F.try_divide(F.col("weight"), F.sum("weight").over(Window.partitionBy("series"))))


def market_slots(chosen: DataFrame) -> DataFrame:
    """How many chosen features come from outside the series."""
    return chosen.groupBy("series").agg(F.count(F.lit(1)).alias("chosen"), F.count_if(F.startswith("feature", F.lit("ext_"))).alias("market"))
