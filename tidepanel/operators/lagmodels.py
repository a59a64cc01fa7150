"""Regressions of a series on its own past: unit root with lag search, grids of ARMA orders.

A window pass over each series adds up lagged products; every regression wanted, of any order, is then a small system
made from these sums, one row per series.  Series have one row per day, so a series is a bounded window group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.normal import cdf_sql
from tidepanel.operators import diagnostics as dg

#: Response surface of the unit-root t statistic with a constant (MacKinnon 1994, 2010): critical values
#: by powers of 1/n, and the p-value's normal quantile by powers of the statistic, below and above the turning point.
CRITICAL = {"1%": (-3.43035, -6.5393, -16.786, -79.433), "5%": (-2.86154, -2.8903, -4.234, -40.040), "10%": (-2.56677, -1.5384, -2.809, 0.0)}
P_LOW, P_HIGH = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
P_TURN, P_LEAST, P_MOST = -1.61, -18.83, 2.74

ORDERS = tuple((p, q) for p in range(4) for q in range(4))


def lag_moments(df: DataFrame, columns: Sequence[str], pairs: Sequence[tuple[str, str]], lags: int, keys: Sequence[str] = ("series",), order: str = "ds") -> DataFrame:
    """One row per key with what Gram matrices of lagged columns are made of.

    ``prod[pair][k]`` is the sum of a[t] * b[t - k] for each pair (a, b) and k = 0..lags, ``total`` the sum of each
    column, ``head`` and ``tail`` its first and last 2 * lags + 1 values in order, ``m`` the number of rows.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumns({"_i": F.row_number().over(w) - 1, "_m": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    late = sorted({b for _, b in pairs})
    d = d.withColumns({f"_{b}_{k}": F.lag(b, k).over(w) for b in late for k in range(1, lags + 1)})
    at = lambda b, k: F.col(b) if k == 0 else F.col(f"_{b}_{k}")
    n = 2 * lags + 1
    prod = [F.array(*[F.coalesce(F.sum(F.col(a) * at(b, k)), F.lit(0.0)) for k in range(lags + 1)]) for a, b in pairs]
    ends = lambda keep: F.transform(F.sort_array(F.collect_list(F.when(keep, F.struct("_i", *columns)))), lambda x: F.array(*[x[c] for c in columns]))
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), F.array(*prod).alias("prod"), F.array(*[F.sum(c) for c in columns]).alias("total"),
                                ends(F.col("_i") < n).alias("head"), ends(F.col("_i") >= F.col("_m") - n).alias("tail"))


class Moments:
    """Gram matrices of lagged columns over any common range of rows, from the sums of ``lag_moments``."""

    def __init__(self, row, columns: Sequence[str], pairs: Sequence[tuple[str, str]]):
        self.m = int(row["m"])
        self.prod = {pair: np.asarray(p, float) for pair, p in zip(pairs, row["prod"])}
        self.total = dict(zip(columns, np.asarray(row["total"], float)))
        self.head, self.tail = ({c: x[:, i] for i, c in enumerate(columns)} for x in (np.stack([np.asarray(r, float) for r in row[e]]) for e in ("head", "tail")))

    def _sum(self, a: str, la: int, b: str, lb: int, first: int) -> float:
        """Sum of a[t - la] * b[t - lb] over t = first .. m - 1."""
        if la > lb or (a, b) not in self.prod and la == lb:
            a, la, b, lb = b, lb, a, la
        k = lb - la
        head, late = self.head, self.tail
        before = np.dot(head[a][k:first - la], head[b][:first - la - k]) if first - la > k else 0.0
        n = len(late[a])
        after = np.dot(late[a][n - la:], late[b][n - la - k:n - k]) if la else 0.0
        return self.prod[(a, b)][k] - before - after

    def _plain(self, a: str, la: int, first: int) -> float:
        n = len(self.tail[a])
        return self.total[a] - self.head[a][:first - la].sum() - (self.tail[a][n - la:].sum() if la else 0.0)

    def gram(self, terms: Sequence[tuple[str, int] | None], first: int) -> np.ndarray:
        """Products of all terms, each (column, lag) or None for the constant, over the rows from ``first`` on."""
        out = np.empty((len(terms), len(terms)))
        for i, x in enumerate(terms):
            for j, y in enumerate(terms[:i + 1]):
                if x is None and y is None:
                    v = self.m - first
                elif x is None or y is None:
                    v = self._plain(*(x or y), first)
                else:
                    v = self._sum(*x, *y, first)
                out[i, j] = out[j, i] = v
        return out


def nested_fits(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(factor, projections, residual sums) of regressing the last term on the first 1, 2, ... ones.

    One Cholesky factor serves all: the first k columns leave y'y minus the squares of the first k projections.  A term
    that the earlier ones determine makes everything from it on not a number.
    """
    k = len(gram) - 1
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    g = gram / np.outer(scale, scale)                    # unit diagonal, so that one bound fits all units
    factor = np.zeros((k, k))
    z = np.full(k, np.nan)
    for i in range(k):
        pivot = g[i, i] - factor[i, :i] @ factor[i, :i]
        if not pivot > 1e-10:
            break
        factor[i, i] = np.sqrt(pivot)
        factor[i + 1:, i] = (g[i + 1:k, i] - factor[i + 1:, :i] @ factor[i, :i]) / factor[i, i]
        z[i] = (g[k, i] - factor[i, :i] @ z[:i]) / factor[i, i]
    left = (g[k, k] - np.cumsum(z * z)) * gram[k, k]
    return factor * scale[:k, None], z * scale[k], np.maximum(left, 0.0)


# --- unit root with lag search ------------------------------------------------------------------------

_D_PAIRS = (("d", "d"), ("u", "d"), ("u", "u"))


def _unit_root(row, max_lag: int) -> list[tuple]:
    """(lag, nobs, aic, statistic, chosen) of every order on the common sample, then the chosen one on its own."""
    x = Moments(row, ("d", "u"), _D_PAIRS)
    n = x.m + 1
    p = min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    if p > max_lag:
        raise ValueError(f"a series of {n} days needs more than max_lag = {max_lag} lags")
    if p < 0:
        return []

    def fit(first: int, lags: int):
        terms = [None, ("u", 0), *[("d", k) for k in range(1, lags + 1)], ("d", 0)]
        nobs = x.m - first
        factor, z, left = nested_fits(x.gram(terms, first))
        out = []
        for lag in range(lags + 1):
            k = lag + 2
            if nobs <= k or not left[k - 1] > 1e-12 * max(x.prod[("d", "d")][0], 1e-300):
                out.append((lag, nobs, None, None))
                continue
            beta = np.linalg.solve(factor[:k, :k].T, z[:k])[1]
            out.append((lag, nobs, float(nobs * (np.log(2 * np.pi * left[k - 1] / nobs) + 1) + 2 * k), float(beta / np.sqrt(left[k - 1] / (nobs - k) * _inverse_at(factor[:k, :k], 1)))))
        return out

    every = fit(p, p)
    usable = [r for r in every if r[2] is not None]
    if not usable:
        return [(*r, False) for r in every]
    best = min(usable, key=lambda r: (r[2], r[0]))[0]
    return [(*r, False) for r in every] + [(*fit(best, best)[best], True)]


def _inverse_at(factor: np.ndarray, i: int) -> float:
    """Diagonal entry i of the inverse of factor @ factor.T."""
    half = np.linalg.solve(factor, np.eye(len(factor))[:, i])
    return float(half @ half)


def unit_root_orders(df: DataFrame, max_lag: int = 40) -> DataFrame:
    """(series, lag, nobs, aic, statistic, chosen): augmented Dickey-Fuller regressions of every lag order.

    The change is regressed on a constant, the level before and 0 .. p earlier changes, p = ceil(12 (n / 100)^(1/4)), all
    on the sample of the largest order; the order of least AIC (ties: fewer lags) is fitted again on all rows it can use,
    ``chosen``.  Series of fewer than 4 days give no rows; where an order's terms depend on each other (constant series)
    its values are null.  ``max_lag`` = 40 suffices for 12,000 days; a longer series is an error.
    """
    w = Window.partitionBy("series").orderBy("ds")
    u = F.lag("y", 1).over(w) - F.avg("y").over(Window.partitionBy("series"))       # centred: same regression, smaller sums
    d = df.withColumns({"d": F.col("y") - F.lag("y", 1).over(w), "u": u}).where("d is not null")
    sums = lag_moments(d.select("series", "ds", "d", "u"), ("d", "u"), _D_PAIRS, max_lag)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r["series"], *x) for r in b.to_dict("records") for x in _unit_root(r, max_lag)]
            yield pd.DataFrame(rows, columns=["series", "lag", "nobs", "aic", "statistic", "chosen"])

    return sums.mapInPandas(solve, "series string, lag int, nobs bigint, aic double, statistic double, chosen boolean")


def _powers(x: str, values: Sequence[float]) -> str:
    return " + ".join(f"({v!r}D) * power({x}, {i})" for i, v in enumerate(values))


def unit_root(df: DataFrame, max_lag: int = 40, level: float = 0.05) -> DataFrame:
    """(series, lag, nobs, statistic, p_value, critical_1, critical_5, critical_10, stationary) with the lag of least AIC."""
    t = unit_root_orders(df, max_lag).where("chosen")
    p = F.expr(f"CASE WHEN statistic > {P_MOST} THEN 1D WHEN statistic < {P_LEAST} THEN 0D WHEN statistic <= {P_TURN} THEN {cdf_sql('(' + _powers('statistic', P_LOW) + ')')} "
               f"ELSE {cdf_sql('(' + _powers('statistic', P_HIGH) + ')')} END")
    out = t.withColumns({"p_value": p, **{f"critical_{k[:-1]}": F.expr(_powers("(1D / nobs)", v)) for k, v in CRITICAL.items()}})
    return out.select("series", "lag", "nobs", "statistic", "p_value", "critical_1", "critical_5", "critical_10", (F.col("p_value") < level).cast("int").alias("stationary"))


# --- ARMA orders --------------------------------------------------------------------------------------

def differenced(df: DataFrame, most: int = 2, window: int | None = None) -> DataFrame:
    """(series, d, i, w): the d-th differences, d = 0..most, of the last ``window`` days of each series (None: all)."""
    w = Window.partitionBy("series").orderBy("ds")
    d = df
    if window:
        late = F.row_number().over(Window.partitionBy("series").orderBy(F.desc("ds")))
        d = df.withColumn("_late", late).where(F.col("_late") <= window)
    d = d.withColumns({"i": F.row_number().over(w) - 1, "_w0": F.col("y").cast("double")})
    for k in range(1, most + 1):
        d = d.withColumn(f"_w{k}", F.col(f"_w{k - 1}") - F.lag(f"_w{k - 1}", 1).over(w))
    cells = F.array(*[F.struct(F.lit(k).alias("d"), F.col(f"_w{k}").alias("w")) for k in range(most + 1)])
    return d.select("series", "i", F.explode(cells).alias("x")).select("series", "x.d", "i", "x.w").where("w is not null")


def differencing_order(panel: DataFrame, most: int = 2, least_days: int = 20) -> DataFrame:
    """(series, d): differences taken until level stationarity is no longer rejected at 5 %, ``most`` at the most.

    ``panel`` is from ``differenced``.  A series that got too short or constant is differenced no further.
    """
    tried = panel.where(F.col("d") < most).select(F.struct("series", "d").alias("k"), "i", "w")
    named = tried.select(F.to_json("k").alias("series"), F.col("i").alias("ds"), F.col("w").alias("y"), "k")
    facts = named.groupBy("series").agg(F.first("k").alias("k"), F.count(F.lit(1)).alias("n"), F.stddev_pop("y").alias("sd"))
    tests = facts.join(dg.kpss(named.select("series", "ds", "y")).select("series", "stationary"), "series", "left")
    stops = (F.col("n") < least_days) | (F.col("sd") < 1e-12) | F.coalesce(F.col("stationary") == 1, F.lit(True))
    first = tests.groupBy("k.series").agg(F.min(F.when(stops, F.col("k.d"))).alias("d"))
    return first.select("series", F.coalesce("d", F.lit(most)).alias("d"))


_E_PAIRS = (("w", "w"), ("w", "e"), ("e", "w"), ("e", "e"))


def residuals(panel: DataFrame, long_order: int) -> DataFrame:
    """(series, d, i, w, e): ``panel`` with the errors of an autoregression of ``long_order`` lags, fitted to each (series, d)
    by least squares; its first rows, and series that are too short or degenerate for it, are left out."""
    sums = lag_moments(panel, ("w",), (("w", "w"),), long_order, ("series", "d"), "i")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                if r["m"] < 3 * long_order + 10:
                    continue
                x = Moments(r, ("w",), (("w", "w"),))
                factor, z, _ = nested_fits(x.gram([*[("w", k) for k in range(1, long_order + 1)], ("w", 0)], long_order))
                if not np.isnan(z).any():
                    out.append((r["series"], r["d"], np.linalg.solve(factor.T, z).tolist()))
            yield pd.DataFrame(out, columns=["series", "d", "ar"])

    fitted = sums.mapInPandas(solve, "series string, d int, ar array<double>")
    past = Window.partitionBy("series", "d").orderBy("i").rowsBetween(-long_order, -1)
    known = panel.withColumn("_past", F.collect_list("w").over(past)).join(fitted, ["series", "d"])
    guess = F.aggregate(F.zip_with(F.reverse("_past"), "ar", lambda x, a: x * a), F.lit(0.0), lambda s, x: s + x)
    return known.where(F.size("_past") == long_order).select("series", "d", "i", "w", (F.col("w") - guess).alias("e"))


def arma_orders(df: DataFrame, window: int | None = 750, long_order: int = 15, orders: Sequence[tuple[int, int]] = ORDERS) -> DataFrame:
    """(series, d, p, q, nobs, aic, sigma2, phi, theta, by_unit_root, chosen): all orders by two-stage regression.

    Stage one takes the errors of a long autoregression as the shocks; stage two regresses the d-th differences on p own
    lags and q shocks, no constant.  All orders come from one set of sums over the rows that all can use, so their AIC
    compares like with like; d = 0 with p = q = 0 is no model and is left out.  ``by_unit_root`` marks the d of
    ``differencing_order``, ``chosen`` the order of least AIC (ties: fewer terms) under it.  The search looks at the last
    ``window`` days, as a user would set it; None takes all.
    """
    panel = differenced(df, window=window)
    most = max(max(o) for o in orders)
    sums = lag_moments(residuals(panel, long_order), ("w", "e"), _E_PAIRS, most, ("series", "d"), "i")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                x = Moments(r, ("w", "e"), _E_PAIRS)
                terms = [*[("w", k) for k in range(1, most + 1)], *[("e", k) for k in range(1, most + 1)], ("w", 0)]
                gram, nobs = x.gram(terms, most), r["m"] - most
                for p, q in orders:
                    use = [*range(p), *range(most, most + q), 2 * most]
                    if len(use) == 1:
                        coef, left = np.zeros(0), gram[-1, -1]
                    else:
                        factor, z, rest = nested_fits(gram[np.ix_(use, use)])
                        if np.isnan(z).any():
                            continue
                        coef, left = np.linalg.solve(factor.T, z), rest[-1]
                    if (r["d"] or p or q) and nobs > p + q and left > 0:
                        out.append((r["series"], r["d"], p, q, nobs, float(nobs * (np.log(2 * np.pi * left / nobs) + 1) + 2 * (p + q + 1)), left / nobs, coef[:p].tolist(), coef[p:].tolist()))
            yield pd.DataFrame(out, columns=["series", "d", "p", "q", "nobs", "aic", "sigma2", "phi", "theta"])

    every = sums.mapInPandas(solve, "series string, d int, p int, q int, nobs bigint, aic double, sigma2 double, phi array<double>, theta array<double>")
    unit = differencing_order(panel).select("series", F.col("d").alias("_d"))
    every = every.join(unit, "series", "left").withColumn("by_unit_root", F.coalesce(F.col("d") == F.col("_d"), F.lit(False))).drop("_d")
    first = F.row_number().over(Window.partitionBy("series", "by_unit_root").orderBy("aic", F.col("p") + F.col("q"), "p"))
    return every.withColumn("chosen", F.col("by_unit_root") & (first == 1))


def arma_forecast(df: DataFrame, horizon: int, window: int | None = 750, long_order: int = 15) -> DataFrame:
    """(series, d, p, q, h, pred): the chosen order, fitted again on all days, and its forecasts.

    Shocks to come are zero, the last ones are the errors of the long autoregression.  Series too short or degenerate for
    any order are left out.
    """
    search = arma_orders(df, window, long_order).where("chosen").select("series", "d", F.col("p").alias("_p"), F.col("q").alias("_q"))
    whole = arma_orders(df, None, long_order).join(search, ["series", "d"]).where("p = _p and q = _q").select("series", "d", "p", "q", "phi", "theta")
    last = differenced(df)
    lags = max(max(o) for o in ORDERS)
    shocks = residuals(last, long_order).groupBy("series", "d").agg(F.max(F.struct("i")).alias("_"), F.transform(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("i", "w", "e")))), 1, lags), lambda x: F.struct(x["w"].alias("w"), x["e"].alias("e"))).alias("past")).drop("_")
    ends = last.groupBy("series").agg(*[F.max_by(F.when(F.col("d") == k, F.col("w")), F.when(F.col("d") == k, F.col("i"))).alias(f"_l{k}") for k in range(3)])
    j = whole.join(shocks, ["series", "d"]).join(ends, "series")
    dot = lambda c, v: F.aggregate(F.zip_with(c, F.slice(v, 1, F.size(c)), lambda a, x: a * x), F.lit(0.0), lambda s, x: s + x)
    start = F.struct(F.transform("past", lambda x: x["w"]).alias("w"), F.transform("past", lambda x: x["e"]).alias("e"),
                     F.when(F.col("d") == 2, F.col("_l1")).otherwise(0.0).alias("slope"), F.when(F.col("d") >= 1, F.col("_l0")).otherwise(0.0).alias("level"), F.array().cast("array<double>").alias("out"))

    def step(s, _):
        w = dot(F.col("phi"), s["w"]) + dot(F.col("theta"), s["e"])
        slope = F.when(F.col("d") == 2, s["slope"] + w).otherwise(w)
        level = F.when(F.col("d") >= 1, s["level"] + slope).otherwise(w)
        keep = lambda x, v: F.slice(F.concat(F.array(v), x), 1, lags)
        return F.struct(keep(s["w"], w).alias("w"), keep(s["e"], F.lit(0.0)).alias("e"), F.when(F.col("d") == 2, slope).otherwise(0.0).alias("slope"),
                        F.when(F.col("d") >= 1, level).otherwise(0.0).alias("level"), F.concat(s["out"], F.array(level)).alias("out"))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, step)["out"]
    return j.select("series", "d", "p", "q", F.posexplode(path).alias("h", "pred")).withColumn("h", F.col("h") + 1)
