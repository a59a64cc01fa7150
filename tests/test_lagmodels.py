"""Unit roots, ARMA grids and exponential smoothing against plain numpy recursions and least squares."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import lagmodels as lm
from tidepanel.operators import smoothing as sm

DAY = dt.date(2001, 1, 1)


def frame(spark, series: dict):
    rows = [(name, DAY + dt.timedelta(i), float(v), "x") for name, y in series.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "series string, ds date, y double, w string").repartition(5)


def walks():
    rng = np.random.default_rng(3)
    noise = rng.normal(size=700)
    stationary = np.zeros(700)
    for t in range(2, 700):
        stationary[t] = 0.5 * stationary[t - 1] - 0.2 * stationary[t - 2] + noise[t] + 0.4 * noise[t - 1]
    return {"walk": np.cumsum(rng.normal(size=600)) + 1e4, "ar": stationary, "twice": np.cumsum(np.cumsum(rng.normal(size=400))), "short": rng.normal(size=25), "tiny": np.array([1.0, 2.0, 4.0]), "flat": np.full(90, 7.0)}


# --- unit root -------------------------------------------------------------------------------------

def plain_adf(y):
    """{lag: (nobs, aic, t)} on the common sample, and the chosen order's (lag, nobs, t)."""
    d = np.diff(y)
    n = len(y)
    p = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)

    def fit(lag, first):
        rows = range(first, len(d))
        x = np.array([[1.0, y[t], *[d[t - k] for k in range(1, lag + 1)]] for t in rows])
        t = d[first:]
        beta, *_ = np.linalg.lstsq(x, t, rcond=None)
        e = t - x @ beta
        m, k = x.shape
        se = math.sqrt(e @ e / (m - k) * np.linalg.inv(x.T @ x)[1, 1])
        return m, m * (math.log(2 * math.pi * (e @ e) / m) + 1) + 2 * k, beta[1] / se

    every = {lag: fit(lag, p) for lag in range(p + 1)}
    best = min(every, key=lambda k: every[k][1])
    return every, (best, *fit(best, best))


def test_unit_root_of_every_order(spark):
    data = walks()
    got = lm.unit_root_orders(frame(spark, data)).collect()
    for name in ("walk", "ar", "twice", "short"):
        every, (lag, nobs, aic, t) = plain_adf(data[name])
        mine = {r["lag"]: r for r in got if r["series"] == name and not r["chosen"]}
        assert mine.keys() == every.keys()
        for k, want in every.items():
            assert np.allclose([mine[k]["nobs"], mine[k]["aic"], mine[k]["statistic"]], want, rtol=1e-6, atol=1e-6)
        chosen = [r for r in got if r["series"] == name and r["chosen"]]
        assert len(chosen) == 1 and (chosen[0]["lag"], chosen[0]["nobs"]) == (lag, nobs) and abs(chosen[0]["statistic"] - t) < 1e-6
    assert all(r["statistic"] is None and not r["chosen"] for r in got if r["series"] == "flat")
    assert not [r for r in got if r["series"] == "tiny"]


def test_unit_root_decision(spark):
    got = {r["series"]: r for r in lm.unit_root(frame(spark, walks())).collect()}
    assert (got["walk"]["stationary"], got["ar"]["stationary"], got["twice"]["stationary"]) == (0, 1, 0)
    for r in got.values():                        # the p-value crosses 5 % near the critical value
        assert (r["statistic"] < r["critical_5"]) == (r["p_value"] < 0.05) or abs(r["statistic"] - r["critical_5"]) < 0.05
        assert r["critical_1"] < r["critical_5"] < r["critical_10"]
    assert lm.unit_root(frame(spark, walks()).where("false")).count() == 0
    with pytest.raises(Exception, match="max_lag"):
        lm.unit_root(frame(spark, walks()), max_lag=5).collect()


# --- ARMA orders -----------------------------------------------------------------------------------

def plain_arma(y, d, long_order=15):
    """{(p, q): (nobs, aic, phi, theta)} by two least squares fits on explicit matrices."""
    w = np.diff(y, d) if d else np.asarray(y, float)
    lags = lambda v, k, first: np.array([[v[t - j] for j in range(1, k + 1)] for t in range(first, len(v))])
    ar, *_ = np.linalg.lstsq(lags(w, long_order, long_order), w[long_order:], rcond=None)
    e = w[long_order:] - lags(w, long_order, long_order) @ ar
    w = w[long_order:]
    out = {}
    for p, q in lm.ORDERS:
        x = np.hstack([lags(w, p, 3).reshape(len(w) - 3, p), lags(e, q, 3).reshape(len(w) - 3, q)])
        coef = np.linalg.lstsq(x, w[3:], rcond=None)[0] if p + q else np.zeros(0)
        left = w[3:] - x @ coef
        n = len(left)
        out[(p, q)] = (n, n * (math.log(2 * math.pi * (left @ left) / n) + 1) + 2 * (p + q + 1), coef[:p], coef[p:])
    return out


def test_arma_grid_matches_least_squares(spark):
    data = walks()
    got = lm.arma_orders(frame(spark, data), window=500).collect()
    for name in ("walk", "ar", "twice"):
        for d in range(3):
            want = plain_arma(data[name][-500:], d)
            mine = {(r["p"], r["q"]): r for r in got if r["series"] == name and r["d"] == d}
            assert mine.keys() == want.keys() - ({(0, 0)} if d == 0 else set())
            for k, r in mine.items():
                n, aic, phi, theta = want[k]
                near = 1e-3 if name == "walk" and d == 0 else 1e-5      # levels of 10,000 without a constant: sums of squares lose digits
                assert r["nobs"] == n and abs(r["aic"] - aic) < near
                assert np.allclose(r["phi"], phi, atol=near) and np.allclose(r["theta"], theta, atol=near)
        pick = [r for r in got if r["series"] == name and r["chosen"]]
        own = [r for r in got if r["series"] == name and r["by_unit_root"]]
        assert len(pick) == 1 and pick[0]["aic"] == min(r["aic"] for r in own) and len({r["d"] for r in own}) == 1
    by = {r["series"]: r["d"] for r in got if r["chosen"]}
    assert by["ar"] == 0 and by["walk"] == 1 and by["twice"] == 2
    assert not {"tiny", "flat", "short"} & {r["series"] for r in got}
    assert lm.arma_orders(frame(spark, data).where("false")).count() == 0


def test_arma_forecast_follows_the_recursion(spark):
    data = {k: v for k, v in walks().items() if k in ("walk", "ar", "twice")}
    got = lm.arma_forecast(frame(spark, data), 6).collect()
    for name, y in data.items():
        path = sorted((r["h"], r["pred"]) for r in got if r["series"] == name)
        r = next(r for r in got if r["series"] == name)
        d, p, q = r["d"], r["p"], r["q"]
        _, _, phi, theta = plain_arma(y, d)[(p, q)]
        w = list(np.diff(y, d) if d else y)
        lags = np.array([[w[t - j] for j in range(1, 16)] for t in range(15, len(w))])
        ar, *_ = np.linalg.lstsq(lags, np.array(w[15:]), rcond=None)
        e = list(np.array(w[15:]) - lags @ ar)
        levels = [y[-1], y[-1] - y[-2]]
        for h, pred in path:
            w.append(sum(a * w[-1 - j] for j, a in enumerate(phi)) + sum(b * e[-1 - j] for j, b in enumerate(theta)))
            e.append(0.0)
            levels[1] = levels[1] + w[-1] if d == 2 else w[-1]
            levels[0] = levels[0] + levels[1] if d else w[-1]
            assert abs(pred - levels[0]) < 1e-6 * max(1, abs(levels[0]))
        assert [h for h, _ in path] == list(range(1, 7))


# --- smoothing -------------------------------------------------------------------------------------

def unrolled(y, alpha, beta, phi, level, trend):
    out = []
    for v in y:
        expected = level + phi * trend
        new = alpha * v + (1 - alpha) * expected
        trend = beta * (new - level) + (1 - beta) * phi * trend if phi else 0.0
        level = new
        out.append((expected, level, trend))
    return np.array(out)


def test_smoothing_equals_the_sequential_recursion(spark):
    data = walks() | {"long": np.cumsum(np.random.default_rng(5).normal(size=1500)), "one": np.array([5.0])}
    df = frame(spark, data)
    fitted = sm.fit(df, sm.damped_trend())
    got = {r["series"]: r for r in fitted.collect()}
    assert got.keys() == data.keys()
    shown = {}
    for r in sm.levels(df, fitted).collect():
        shown.setdefault(r["series"], []).append((r["ds"], r["expected"], r["level"], r["trend"]))
    for name, y in data.items():
        r = got[name]
        path = unrolled(y, r["alpha"], r["beta"], r["phi"], r["level0"], r["trend0"])
        scale = max(1.0, np.abs(y).max())
        assert np.abs(path[-1, 1:] - [r["level"], r["trend"]]).max() < 1e-9 * scale
        assert np.abs(np.array([x[1:] for x in sorted(shown[name])]) - path).max() < 1e-9 * scale
        assert abs(((y - path[:, 0]) ** 2).sum() - r["sse"]) < 1e-6 * max(1.0, (y ** 2).sum())


def test_smoothing_start_and_grid_are_the_best(spark):
    y = walks()["ar"][:200]
    r = sm.fit(frame(spark, {"s": y}), sm.damped_trend((0.1, 0.5), (0.1, 0.4), (0.9,))).first()

    def sse(a, b, x0, b0):
        return ((y - unrolled(y, a, b, 0.9, x0, b0)[:, 0]) ** 2).sum()

    best = {}
    for a in (0.1, 0.5):
        for b in (0.1, 0.4):                       # the error is quadratic in the start: three points per axis give it
            f = lambda x: sse(a, a and b, *x)
            basis = np.eye(2)
            c = f((0, 0))
            g = np.array([(f(e) - f(-e)) / 2 for e in basis])
            h = np.array([[f(basis[i] + basis[j]) - f(basis[i]) - f(basis[j]) + c for j in range(2)] for i in range(2)])
            x = np.linalg.solve(h, -g)
            best[(a, b)] = (f(x), *x)
    key = min(best, key=lambda k: best[k][0])
    assert (r["alpha"], r["beta"]) == key
    assert np.allclose([r["sse"], r["level0"], r["trend0"]], best[key], rtol=1e-6, atol=1e-6)


def test_block_summaries_compose_in_any_bracketing():
    rng = np.random.default_rng(6)
    s = sm.damped_trend((0.2, 0.7), (0.1,), (0.9,))
    y = rng.normal(size=90)
    a, b, c = (sm.block_summary(part, s) for part in np.split(y, (20, 55)))
    whole = sm.block_summary(y, s)
    assert np.allclose(sm.compose(sm.compose(a, b), c), whole) and np.allclose(sm.compose(a, sm.compose(b, c)), whole)


def test_smoothing_forecasts(spark):
    data = {k: walks()[k] for k in ("ar", "walk")} | {"one": np.array([5.0])}
    df = frame(spark, data)
    fitted = sm.fit(df, sm.damped_trend())
    by = {r["series"]: r for r in fitted.collect()}
    for r in sm.smoothing_forecasts(fitted, 4).collect():
        f = by[r["series"]]
        assert abs(r["pred"] - f["level"] - sum(f["phi"] ** k for k in range(1, r["h"] + 1)) * f["trend"]) < 1e-8 * max(1, abs(f["level"]))
    simple = {r["series"]: r for r in sm.fit(df, sm.simple()).collect()}
    for r in sm.theta_forecasts(df, 4).collect():
        f, y = simple[r["series"]], data[r["series"]]
        slope = np.polyfit(np.arange(len(y)), y, 1)[0] if len(y) > 1 else 0.0
        drift = slope / 2 * (r["h"] - 1 + (1 - (1 - f["alpha"]) ** len(y)) / f["alpha"])
        assert abs(r["pred"] - f["level"] - drift) < 1e-7 * max(1, abs(f["level"]))
    assert sm.fit(df.where("false"), sm.simple()).count() == 0
    gaps = df.withColumn("y", F.when(F.dayofmonth("ds") != 3, F.col("y")))
    assert {r["series"]: r["n"] for r in sm.fit(gaps, sm.simple()).collect()}["one"] == 1
