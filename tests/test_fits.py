"""Quantile regression against exhaustive search, tree attributions against sums over all subsets."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from tidepanel.operators import attribution as at
from tidepanel.operators import quantile as qr


def table(spark, x, y):
    names = [f"x{i}" for i in range(x.shape[1])]
    rows = [(*map(float, r), float(v)) for r, v in zip(x, y)]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in [*names, "y"])).repartition(3), names


def loss(x, y, beta, tau):
    r = y - np.column_stack([np.ones(len(y)), x]) @ beta
    return np.where(r > 0, tau * r, (tau - 1) * r).mean()


def least_loss(x, y, tau):
    """The optimum lies on a plane through as many rows as there are coefficients."""
    full, best = np.column_stack([np.ones(len(y)), x]), np.inf
    for rows in itertools.combinations(range(len(y)), full.shape[1]):
        a = full[list(rows)]
        if abs(np.linalg.det(a)) > 1e-9:
            best = min(best, loss(x, y, np.linalg.solve(a, y[list(rows)]), tau))
    return best


@pytest.mark.parametrize("tau", [0.5, 0.2])
def test_quantile_fit_reaches_the_optimum(spark, tau):
    rng = np.random.default_rng(int(10 * tau))
    x = rng.normal(size=(40, 2)) * [1, 50] + [0, 1000]
    y = 3 + x @ [2, -0.1] + rng.standard_t(2, 40)
    df, names = table(spark, x, y)
    fit = qr.fit_quantile(df, names, quantile=tau)
    assert fit.loss <= least_loss(x, y, tau) * (1 + 1e-6)
    assert abs(loss(x, y, np.array([fit.intercept, *fit.slopes]), tau) - fit.loss) < 1e-9
    pred = df.agg(F.avg(qr.pinball(F.col("y"), fit.predict(), tau))).first()[0]
    assert abs(pred - fit.loss) < 1e-9


def test_quantile_fit_edge_cases(spark):
    y = np.array([1.0, 2.0, 3.0, 10.0, 500.0])
    df, names = table(spark, np.column_stack([np.full(5, 7.0), np.arange(5)]), y)
    assert abs(qr.fit_quantile(df, []).intercept - 3.0) < 1e-9
    fit = qr.fit_quantile(df, names)
    assert fit.columns == ("x1",) and fit.rows == 5         # the constant column is dropped
    twice = df.withColumn("x2", F.col("x1") * 2)             # dependent columns, repeated rows, a null
    odd = twice.union(twice).union(twice.limit(1).withColumn("x1", F.lit(None).cast("double")))
    assert abs(qr.fit_quantile(odd, ["x1", "x2"]).loss - fit.loss) < 1e-6
    exact, names = table(spark, np.arange(20.0)[:, None], 5 + 2 * np.arange(20.0))
    assert qr.fit_quantile(exact, names).loss < 1e-9
    with pytest.raises(ValueError):
        qr.fit_quantile(df.where("false"), ["x1"])


# --- attributions ----------------------------------------------------------------------------------

def plain_trees(spark_rows):
    trees = {}
    for r in spark_rows:
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    return trees


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_attributions_match_all_subsets(spark, kind, tmp_path, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 4)).round(2)
    y = x[:, 0] * x[:, 1] + np.where(x[:, 2] > 0, 3, -1) + rng.normal(size=300) / 5
    df, names = table(spark, x, y)
    learner = RandomForestRegressor(labelCol="y", numTrees=4, maxDepth=5, seed=3) if kind == "forest" else GBTRegressor(labelCol="y", maxIter=4, maxDepth=3, seed=3)
    model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), learner]).fit(df)
    known = at.explainer(model, names)
    few = df.limit(12).withColumn("id", F.monotonically_increasing_id()).cache()
    got = {}
    for r in at.attributions(few, known, ["id"]).collect():
        got.setdefault(r["id"], {})[r["feature"]] = r["contribution"]
    # subsets over the same node table, walked by recursion
    path = str(tmp_path / "trees")
    model.stages[-1].write().save(path)
    nodes = plain_trees(spark.read.parquet(path + "/data").select("treeID", "nodeData.*").collect())
    weights = list(model.stages[-1].treeWeights)
    scale = sum(weights) if kind == "forest" else 1.0

    def walk(tree, i, row, known_features):
        n = tree[i]
        if n["leftChild"] < 0:
            return n["prediction"]
        f, cut = n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"][0]
        a, b = n["leftChild"], n["rightChild"]
        if f in known_features:
            return walk(tree, a if row[f] <= cut else b, row, known_features)
        p, q = tree[a]["rawCount"], tree[b]["rawCount"]
        return (p * walk(tree, a, row, known_features) + q * walk(tree, b, row, known_features)) / (p + q)

    pred = {r["id"]: r["prediction"] for r in model.transform(few).collect()}
    for r in few.collect():
        row = [r[n] for n in names]
        value = {s: sum(weights[t] * walk(tree, 0, row, s) for t, tree in nodes.items()) / scale for k in range(5) for s in map(frozenset, itertools.combinations(range(4), k))}
        for i, n in enumerate(names):
            want = sum(math.factorial(len(s)) * math.factorial(3 - len(s)) / 24 * (value[s | {i}] - v) for s, v in value.items() if i not in s)
            assert abs(got[r["id"]][n] - want) < 1e-9
        assert abs(value[frozenset()] - known.base) < 1e-9 and abs(known.base + sum(got[r["id"]].values()) - pred[r["id"]]) < 1e-9
    # paths too long for a table give the same
    monkeypatch.setattr(at, "TABLE_FEATURES", 0)
    slow = at.explainer(model, names)
    assert all(leaf.table is None for leaf in slow.leaves) and np.allclose(slow.explain(x[:50]), known.explain(x[:50]))


def test_family_shares_of_attributions(spark):
    rows = [("s", 1, "lag_1", 1.0), ("s", 2, "lag_1", -3.0), ("s", 1, "rolling_mean_5", 2.0), ("s", 2, "rolling_mean_5", 2.0), ("s", 1, "lag_2", 0.0), ("s", 2, "lag_2", 0.0)]
    got = {r["family"]: (r["features"], r["weight"], r["share"]) for r in at.family_attribution(spark.createDataFrame(rows, "series string, ds int, feature string, contribution double"), ["series"]).collect()}
    assert got == {"Lag": (2, 2.0, 0.5), "Rolling statistics": (1, 2.0, 0.5)}
