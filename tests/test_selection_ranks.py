"""Order statistics over groups of any size: pairwise means, Shapiro and Wilk's test, and the whole feature pool."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import diagnostics as dg
from tidepanel.operators import inference as inf
from tidepanel.operators import selection as sel
from tidepanel.plans import q_selection as qs


def brute_median(x):
    i, j = np.triu_indices(len(x))
    return np.median((x[i] + x[j]) / 2)


@pytest.mark.parametrize("rows,enumerated", [(20_000, 200_000), (37, 400)])
def test_pairwise_median_over_slices(spark, monkeypatch, rows, enumerated):
    """All rows of a key, ties, one value only, one row, odd and even numbers of pairs; few and many slices."""
    monkeypatch.setattr(inf, "ENUMERATED", enumerated)
    rng = np.random.default_rng(4)
    data = {"hot": rng.normal(size=700).round(2), "ties": rng.integers(-3, 3, 300).astype(float), "same": np.full(60, 2.5), "one": np.array([4.0]), "two": np.array([1.0, 8.0]),
            "far": np.concatenate([rng.normal(size=150), rng.normal(size=150) + 1e6])}
    df = spark.createDataFrame([(k, 1.0, 1.0 + float(v)) for k, x in data.items() for v in x] + [("hot", None, 1.0)], "series string, a double, b double").repartition(6)
    got = {r["series"]: (r["n"], r["estimate"]) for r in inf.hodges_lehmann(df, ["series"], rows).collect()}
    assert got.keys() == data.keys()
    for k, x in data.items():
        x = (1.0 + x) - 1.0
        assert got[k][0] == len(x) and abs(got[k][1] - brute_median(x)) < 1e-9 * max(1, np.abs(x).max())


def test_pairwise_median_of_nothing(spark):
    assert inf.hodges_lehmann(spark.createDataFrame([], "series string, a double, b double"), ["series"]).count() == 0


# --- Shapiro and Wilk ------------------------------------------------------------------------------

def plain_shapiro(x):
    from statistics import NormalDist

    x, n = np.sort(x), len(x)
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, mm = 1 / math.sqrt(n), m @ m
    a = np.zeros(n)
    poly = lambda c: sum(v * u ** (i + 1) for i, v in enumerate(c))
    a[-1] = m[-1] / math.sqrt(mm) + poly(dg.SW_LAST)
    if n == 3:
        a[-1] = math.sqrt(0.5)
    elif n > 5:
        a[-2] = m[-2] / math.sqrt(mm) + poly(dg.SW_NEXT)
        a[2:-2] = m[2:-2] / math.sqrt((mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * a[-1] ** 2 - 2 * a[-2] ** 2))
        a[1] = -a[-2]
    else:
        a[1:-1] = m[1:-1] / math.sqrt((mm - 2 * m[-1] ** 2) / (1 - 2 * a[-1] ** 2))
    a[0] = -a[-1]
    return (a @ x) ** 2 / ((x - x.mean()) ** 2).sum()


def test_shapiro_wilk_over_pieces(spark):
    rng = np.random.default_rng(5)
    weights = [148.0, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    data = {"weights": np.array(weights), "normal": rng.normal(size=300), "skewed": rng.exponential(size=200), "zeros": np.where(rng.random(400) < 0.6, 0.0, rng.normal(size=400)),
            "three": np.array([1.0, 2.0, 4.0]), "five": np.array([1.0, 2.0, 4.0, 4.5, 9.0]), "six": np.array([1.0, 2.0, 4.0, 4.5, 9.0, 9.5]), "flat": np.full(9, 3.0), "two": np.array([1.0, 2.0])}
    df = spark.createDataFrame([(k, float(v)) for k, x in data.items() for v in x] + [("two", None)], "series string, y double").repartition(5)
    for run in (10_000, 7):
        got = {r["series"]: r for r in dg.shapiro_wilk(df, run=run).collect()}
        assert got["flat"]["w"] is None and got["two"]["w"] is None and got["two"]["n"] == 2
        for k in data.keys() - {"flat", "two"}:
            assert abs(got[k]["w"] - plain_shapiro(data[k])) < 1e-7
        assert abs(got["weights"]["w"] - 0.78881) < 5e-6 and abs(got["weights"]["p_value"] - 0.006704) < 5e-6      # published example
        assert got["normal"]["normal"] == 1 and got["skewed"]["normal"] == 0 and got["zeros"]["normal"] == 0
        exact = 6 / math.pi * (math.asin(math.sqrt(got["three"]["w"])) - math.asin(math.sqrt(0.75)))
        assert abs(got["three"]["p_value"] - exact) < 1e-9
    assert dg.shapiro_wilk(df.where("false")).count() == 0


# --- the whole pool --------------------------------------------------------------------------------

def test_pool_selection_against_numpy(spark):
    """All candidates of two series: relevance, picks and families by hand."""
    x, names = qs.pool(spark, "/root/testdata/sf0.001")
    assert len(names) == 116
    wide = x.where("series in ('1-URGENT', '5-LOW')").select("series", "ds", "y", *names).toPandas()
    ranks = sel.feature_ranks(sel.long_features(spark.createDataFrame(wide), names))
    score = {(r["series"], r["feature"]): r["score"] for r in sel.spearman_relevance(ranks).collect()}
    picks = {}
    for r in sel.mrmr_select(ranks, 12).collect():
        picks.setdefault(r["series"], []).append((r["step"], r["feature"]))
    for s, part in wide.groupby("series"):
        z = part[names].rank().sub(part[names].rank().mean()).to_numpy()
        norm = np.sqrt((z * z).sum(axis=0))
        z = np.divide(z, norm, out=np.zeros_like(z), where=norm > 0)
        y = part["y"].rank().to_numpy()
        y = (y - y.mean()) / np.sqrt(((y - y.mean()) ** 2).sum())
        want = np.abs(z.T @ y)
        assert np.allclose([score[(s, n)] for n in names], want, atol=1e-9)
        red, chosen = np.zeros(len(names)), []
        while len(chosen) < 12:
            gain = np.round(want - (red / len(chosen) if chosen else 0), 9)
            gain[chosen] = -np.inf
            best = max(range(len(names)), key=lambda i: (gain[i], -sorted(names, key=lambda n: (-want[names.index(n)], n)).index(names[i])))
            chosen.append(best)
            red += np.abs(z.T @ z[:, best])
        mine = [names.index(f) for _, f in sorted(picks[s])]
        worth = lambda picked: [round(want[p] - (np.abs(z[:, picked[:i]].T @ z[:, p]).mean() if i else 0), 6) for i, p in enumerate(picked)]
        assert worth(mine) == worth(chosen)                  # equally good picks may be named in another order
    families = sel.family_shares(sel.spearman_relevance(ranks))
    assert all(abs(r["s"] - 1) < 1e-9 and r["n"] == 116 for r in families.groupBy("series").agg(F.sum("share").alias("s"), F.sum("features").alias("n")).collect())
