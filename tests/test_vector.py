"""Vector autoregression against least squares on explicit matrices."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import vector as vr

DAY = dt.date(2001, 1, 1)


def panel():
    rng = np.random.default_rng(2)
    a = np.array([[0.5, 0.1, 0.0], [0.0, 0.4, 0.2], [0.1, 0.0, 0.3]])
    x = np.zeros((420, 3))
    for t in range(1, 420):
        x[t] = 1 + a @ x[t - 1] + rng.normal(size=3)
    walk = np.cumsum(rng.normal(size=420)) + 50
    return {"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "walk": walk}


def frame(spark, data, gaps=()):
    rows = [(s, DAY + dt.timedelta(i), float(v)) for s, y in data.items() for i, v in enumerate(y) if (s, i) not in gaps]
    return spark.createDataFrame(rows, "series string, ds date, y double").repartition(5)


def plain(w, lag, first):
    x = np.array([np.concatenate([[1.0], *[w[t - k] for k in range(1, lag + 1)]]) for t in range(first, len(w))])
    coef, *_ = np.linalg.lstsq(x, w[first:], rcond=None)
    e = w[first:] - x @ coef
    n, s = e.shape
    return coef, np.linalg.slogdet(e.T @ e / n)[1] + 2 / n * (lag * s * s + s)


@pytest.mark.parametrize("tile,days", [(64, 512), (3, 40)])
def test_equations_and_forecasts(spark, tile, days):
    data = panel()
    fit = vr.fit_vector(frame(spark, data), tile=tile, days=days)
    assert fit.series == sorted(data) and fit.orders == [0, 0, 0, 1]
    w = np.column_stack([np.diff(data[s]) if d else data[s][1:] for s, d in zip(fit.series, fit.orders)])
    want = [plain(w, lag, 10)[1] for lag in range(1, 11)]
    assert np.allclose(fit.aic, want, atol=1e-6) and fit.lag == 1 + int(np.argmin(want))
    coef, _ = plain(w, fit.lag, fit.lag)
    assert np.allclose(fit.intercept, coef[0], atol=1e-7) and fit.nobs == len(w) - fit.lag
    for k in range(fit.lag):
        assert np.allclose(fit.lags[k], coef[1 + 4 * k:5 + 4 * k].T, atol=1e-7)
    past, level = list(w), data["walk"][-1]
    got = {(r["series"], r["h"]): r["pred"] for r in vr.vector_forecasts(spark, fit, 5).collect()}
    for h in range(1, 6):
        past.append(np.concatenate([[1.0], *[past[-k] for k in range(1, fit.lag + 1)]]) @ coef)
        level += past[-1][3]
        assert np.allclose([got[(s, h)] for s in fit.series], [*past[-1][:3], level], atol=1e-6)


def test_days_that_a_series_lacks_are_left_out(spark):
    data = {k: panel()[k] for k in ("a", "b")}
    fit = vr.fit_vector(frame(spark, data, {("a", 5), ("b", 300)}), max_lag=2)
    keep = [i for i in range(420) if i not in (5, 300)]
    w = np.column_stack([data["a"][keep], data["b"][keep]])
    assert fit.nobs == 418 - fit.lag and np.allclose(fit.intercept, plain(w, fit.lag, fit.lag)[0][0], atol=1e-7)
    assert all(math.isfinite(x) for x in fit.aic)


def test_too_little_is_an_error(spark, monkeypatch):
    data = {k: v[:7] for k, v in panel().items()}
    with pytest.raises(ValueError):
        vr.fit_vector(frame(spark, data))
    with pytest.raises(ValueError):
        vr.fit_vector(frame(spark, data).where("false"))
    monkeypatch.setattr(vr, "MOST_TERMS", 6)
    with pytest.raises(ValueError):
        vr.fit_vector(frame(spark, panel()))


def test_forecasts_add_up_the_tree(spark):
    from tidepanel.operators import etl

    tree = [("x", "x", 1), ("x", "D", 1), ("y", "y", 1), ("y", "D", 1)]
    data = {"x": panel()["a"], "y": panel()["b"]}
    f = vr.vector_forecasts(spark, vr.fit_vector(frame(spark, data), max_lag=2), 3).select(F.col("series").alias("node"), "h", F.col("pred").alias("value"))
    got = {(r["node"], r["h"]): r["value"] for r in etl.rollup_tree(f, tree, ("h",)).collect()}
    assert all(abs(got[("D", h)] - got[("x", h)] - got[("y", h)]) < 1e-9 for h in (1, 2, 3))
