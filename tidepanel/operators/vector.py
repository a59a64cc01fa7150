"""Vector autoregression over a panel: Gram matrices of all lags by tiles of series and blocks of days."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators import lagmodels as lm
from tidepanel.session import cut_lineage

#: Series per tile, days per block, and terms of an equation at most: the driver factors one matrix of that order.
TILE, DAYS, MOST_TERMS = 64, 512, 3_000


@dataclass(frozen=True)
class VectorFit:
    """Equations of all series: intercept and one matrix per lag (rows: equations), and the AIC of every order tried."""

    series: list[str]
    orders: list[int]
    lag: int
    nobs: int
    aic: list[float]
    intercept: np.ndarray
    lags: np.ndarray
    sigma: np.ndarray
    last: np.ndarray
    levels: np.ndarray

    def forecast(self, horizon: int) -> np.ndarray:
        """horizon x series, in the levels of the series."""
        past, path = list(self.last), []
        state = self.levels.copy()                        # last value of every series and of its first difference
        for _ in range(horizon):
            step = self.intercept + sum(self.lags[k] @ past[-1 - k] for k in range(self.lag))
            past.append(step)
            d = np.array(self.orders)
            state[1] = np.where(d == 2, state[1] + step, step)
            state[0] = np.where(d >= 1, state[0] + state[1], step)
            path.append(state[0].copy())
        return np.array(path)


def stationary_orders(df: DataFrame, most: int = 2) -> DataFrame:
    """(series, d): differences taken until the unit-root test with lag search rejects at 5 %, ``most`` at the most; where
    it cannot be made (constant or very short series), none more."""
    panel = lm.differenced(df, most - 1).select(F.concat_ws("\x01", F.col("d").cast("string"), "series").alias("series"), F.col("i").alias("ds"), F.col("w").alias("y"))
    tests = lm.unit_root(panel).select("series", "stationary")
    tried = panel.select("series").distinct().join(tests, "series", "left")
    first = F.min(F.when(F.coalesce(F.col("stationary") == 1, F.lit(True)), F.split("series", "\x01")[0].cast("int")))
    return tried.groupBy(F.substring_index("series", "\x01", -1).alias("series")).agg(F.coalesce(first, F.lit(most)).alias("d"))


def _tiles(rows: DataFrame, names: list[str], lags: int, tile: int, days: int) -> DataFrame:
    """(block, tile, data): the days of a block and the ``lags`` before it, day by day, of a tile of series."""
    at = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    placed = rows.withColumn("c", at[F.col("series")]).withColumn("tile", F.floor(F.col("c") / tile).cast("int"))
    own = F.floor((F.col("t") - lags) / days).cast("int")
    reach = F.floor(F.col("t") / days).cast("int")        # a block's first days are also the past of their own block
    placed = placed.withColumn("block", F.explode(F.array_distinct(F.array(F.greatest(own, F.lit(0)), reach))))

    def pack(key, p: pd.DataFrame) -> pd.DataFrame:
        m = p.pivot(index="t", columns="c", values="w").sort_index()
        return pd.DataFrame({"block": [key[0]], "tile": [key[1]], "width": [m.shape[1]], "data": [m.to_numpy(np.float64).tobytes()]})

    return placed.groupBy("block", "tile").applyInPandas(pack, "block int, tile int, width int, data binary")


def _products(tiles: DataFrame, lags: int) -> DataFrame:
    """(i, j, a, b, sum): products of tile i lagged a with tile j lagged b, summed over all days that have all lags."""
    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for r in part.itertuples():
                x, y = (np.frombuffer(d).reshape(-1, w) for d, w in ((r.data, r.width), (r.data2, r.width2)))
                n = len(x) - lags
                rows = [(r.i, r.j, a, b, (x[lags - a:lags - a + n].T @ y[lags - b:lags - b + n]).tobytes()) for a in range(lags + 1) for b in range(lags + 1)] if n > 0 else []
                rows += [(r.i, r.i, a, -1, x[lags - a:lags - a + n].sum(axis=0).tobytes()) for a in range(lags + 1)] if n > 0 and r.i == r.j else []
                yield pd.DataFrame(rows, columns=["i", "j", "a", "b", "sum"])

    def add(key, p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [key[0]], "j": [key[1]], "a": [key[2]], "b": [key[3]], "sum": [np.sum([np.frombuffer(x) for x in p["sum"]], axis=0).tobytes()]})

    left = tiles.select("block", F.col("tile").alias("i"), "width", "data")
    right = tiles.select("block", F.col("tile").alias("j"), F.col("width").alias("width2"), F.col("data").alias("data2"))
    met = left.join(right, "block").where("i <= j")
    return met.mapInPandas(multiply, "i int, j int, a int, b int, sum binary").groupBy("i", "j", "a", "b").applyInPandas(add, "i int, j int, a int, b int, sum binary")


def _gram(parts: DataFrame, n: int, lags: int, nobs: int, tile: int) -> np.ndarray:
    """Products of [1, lag 1, ..., lag p, now]: (1 + n * (p + 1)) squared."""
    size = 1 + n * (lags + 1)
    out = np.zeros((size, size))
    out[0, 0] = nobs
    place = lambda a: 1 + n * ((a - 1) % (lags + 1))      # noqa: E731  lag 0 comes last
    for r in parts.toLocalIterator():
        v = np.frombuffer(r["sum"])
        x = place(r["a"]) + r["i"] * tile
        if r["b"] < 0:
            out[0, x:x + len(v)] = out[x:x + len(v), 0] = v
            continue
        wide = min(tile, n - r["i"] * tile)
        v = v.reshape(wide, -1)
        y = place(r["b"]) + r["j"] * tile
        out[x:x + wide, y:y + v.shape[1]] = v
        out[y:y + v.shape[1], x:x + wide] = v.T
    return out


def fit_vector(df: DataFrame, max_lag: int | None = None, tile: int = TILE, days: int = DAYS) -> VectorFit:
    """Vector autoregression of all series of (series, ds, y), the order by AIC.

    Every series is differenced until stationary; days that not all series have are left out.  Orders 1 to ``max_lag``
    (the smaller of 10 and a fifth of the days) are compared on the days that all of them can use: one factor of the Gram
    matrix serves every order and every equation.  The chosen one is fitted again on all its days.  More than
    MOST_TERMS terms, or too few days for one lag, are an error.
    """
    orders = {r["series"]: r["d"] for r in stationary_orders(df).collect()}          # one row per series
    names = sorted(orders)
    n = len(names)
    if not n:
        raise ValueError("no series")
    d = F.create_map(*[x for k, v in orders.items() for x in (F.lit(k), F.lit(v))])
    w = Window.partitionBy("series").orderBy("ds")
    y = df.select("series", "ds", F.col("y").cast("double").alias("w0"))
    y = y.withColumn("w1", F.col("w0") - F.lag("w0", 1).over(w)).withColumn("w2", F.col("w1") - F.lag("w1", 1).over(w))
    y = y.withColumn("_d", d[F.col("series")]).withColumn("w", F.when(F.col("_d") == 0, F.col("w0")).when(F.col("_d") == 1, F.col("w1")).otherwise(F.col("w2"))).where("w is not null")
    full = y.groupBy("ds").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") == n)
    numbered = full.select("ds", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ds")) - 1).alias("t"))          # one row per day
    rows = cut_lineage(y.join(numbered, "ds").select("series", "t", "w", "w0", "w1"))
    total = rows.agg(F.max("t")).first()[0]
    total = 0 if total is None else total + 1
    p = min(max_lag or 10, total // 5)
    if p < 1 or total - p <= 1 + n:
        raise ValueError("too few days for a vector autoregression")
    p = max(1, min(p, (MOST_TERMS - 1) // n - 1, (total - 2 - n) // (n + 1)))
    if 1 + n * (p + 1) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms: the equations are too large")
    nobs = total - p
    gram = _gram(_products(_tiles(rows, names, p, tile, days), p), n, p, nobs, tile)
    ends = rows.where((F.col("t") < p) | (F.col("t") >= total - p)).select("series", "t", "w").collect()          # 2 p days
    edge = {(r["t"], r["series"]): r["w"] for r in ends}
    day = lambda t: np.array([edge[(t, s)] for s in names])

    def solve(g: np.ndarray, lag: int):
        k = 1 + n * lag
        scale = np.sqrt(np.diag(g)[:k])
        factor = np.linalg.cholesky(g[:k, :k] / np.outer(scale, scale))
        z = np.linalg.solve(factor, g[:k, -n:] / scale[:, None])
        return factor, z, scale

    _, z, _ = solve(gram, p)
    aic = []
    for lag in range(1, p + 1):
        k = 1 + n * lag
        sigma = (gram[-n:, -n:] - z[:k].T @ z[:k]) / nobs
        aic.append(float(np.linalg.slogdet(sigma)[1] + 2 / nobs * (lag * n * n + n)))
    lag = 1 + int(np.argmin(aic))
    keep = [*range(1 + n * lag), *range(len(gram) - n, len(gram))]
    g = gram[np.ix_(keep, keep)]
    for t in range(lag, p):                               # days that only the longer orders could not use
        v = np.concatenate([[1.0], *[day(t - a) for a in range(1, lag + 1)], day(t)])
        g = g + np.outer(v, v)
    factor, z, scale = solve(g, lag)
    coef = np.linalg.solve(factor.T, z) / scale[:, None]
    last = rows.where(F.col("t") == total - 1).select("series", "w0", "w1").collect()
    at = {r["series"]: (r["w0"], r["w1"] if r["w1"] is not None else 0.0) for r in last}
    sigma = (g[-n:, -n:] - z.T @ z) / (total - lag)
    return VectorFit(names, [orders[s] for s in names], lag, total - lag, aic, coef[0], np.stack([coef[1 + n * a:1 + n * (a + 1)].T for a in range(lag)]), sigma,
                     np.stack([day(t) for t in range(total - lag, total)]), np.array([[at[s][i] for s in names] for i in (0, 1)]))


def vector_forecasts(spark, fitted: VectorFit, horizon: int) -> DataFrame:
    """(series, h, method, pred)."""
    path = fitted.forecast(horizon)
    rows = [(s, h + 1, "VAR", float(path[h, i])) for h in range(horizon) for i, s in enumerate(fitted.series)]
    return spark.createDataFrame(rows, "series string, h int, method string, pred double")
