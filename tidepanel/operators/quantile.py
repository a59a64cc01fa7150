"""Quantile regression over all rows: reweighted normal equations to get near, then exact descent over the rows nearby.

Every pass adds up sums per task and then over tasks.  The driver solves one small system per pass, and at the end a
problem of a bounded number of rows: the rows far from the plane keep their side, so only their summed gradient counts
(Portnoy and Koenker's reduction).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reweighted passes, exact rounds at most, and distinct rows around the plane, per coefficient, that an exact round sees.
PASSES, ROUNDS, NEAREST = 14, 8, 60


@dataclass(frozen=True)
class QuantileFit:
    """Coefficients in the columns' own units, by column, with the mean pinball loss of the training rows."""

    columns: tuple[str, ...]
    intercept: float
    slopes: tuple[float, ...]
    quantile: float
    rows: int
    loss: float

    def predict(self) -> Column:
        out = F.lit(self.intercept)
        for c, b in zip(self.columns, self.slopes):
            out = out + F.lit(b) * F.col(c)
        return out


def _rows(df: DataFrame, columns: Sequence[str], y: str, centre: Sequence[float], scale: Sequence[float]) -> DataFrame:
    z = [((F.col(c) - F.lit(m)) / F.lit(s)) for c, m, s in zip(columns, centre, scale)]
    return df.select(F.array(F.lit(1.0), *z).alias("x"), F.col(y).cast("double").alias("y"))


def _matrices(batches: Iterator[pa.RecordBatch], k: int):
    for b in batches:
        if b.num_rows:
            yield b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, k), b.column("y").to_numpy(zero_copy_only=False)


def _pass(rows: DataFrame, beta: np.ndarray, k: int, tau: float, eps: float, first: bool) -> tuple[np.ndarray, np.ndarray, float]:
    """(weighted X'X, weighted X'y + (2 tau - 1) X'1, pinball loss of ``beta``) over all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k + k + 1)
        for x, y in _matrices(batches, k):
            r = y - x @ beta
            w = np.ones(len(y)) if first else 1 / np.maximum(np.abs(r), eps)
            wx = x * w[:, None]
            total[:k * k] += (wx.T @ x).ravel()
            total[k * k:-1] += wx.T @ y + (0 if first else (2 * tau - 1) * x.sum(axis=0))
            total[-1] += np.where(r > 0, tau * r, (tau - 1) * r).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["at", "v"])

    sums = np.zeros(k * k + k + 1)
    for r in rows.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():      # k * k + k + 1 numbers
        sums[r["at"]] = r["v"]
    return sums[:k * k].reshape(k, k), sums[k * k:-1], float(sums[-1])


def _nearest(rows: DataFrame, beta: np.ndarray, k: int, n: int) -> np.ndarray:
    """(distance, x, y) of the ``n`` distinct rows with the smallest residuals: n * (k + 2) numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, k + 2))
        for x, y in _matrices(batches, k):
            new = np.column_stack([np.abs(y - x @ beta).round(12), x, y])
            held = np.unique(np.concatenate([held, new]), axis=0)[:n]
        yield pa.RecordBatch.from_arrays([pa.array(held.tolist(), pa.list_(pa.float64()))], names=["row"])

    near = rows.mapInArrow(run, "row array<double>").distinct().orderBy("row").limit(n).collect()
    return np.array([r["row"] for r in near]).reshape(-1, k + 2)


def _reduced(rows: DataFrame, beta: np.ndarray, k: int, tau: float, near: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, weight) of the distinct rows nearer than ``near``, and the summed gradient of all others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far, held, count = np.zeros(k), np.zeros((0, k + 1)), np.zeros(0)
        for x, y in _matrices(batches, k):
            r = y - x @ beta
            inside = np.abs(r).round(12) < near
            far += (x[~inside] * np.where(r[~inside] > 0, tau, tau - 1)[:, None]).sum(axis=0)
            held = np.concatenate([held, np.column_stack([x, y])[inside]])
            held, back = np.unique(held, axis=0, return_inverse=True)
            count = np.bincount(back.ravel(), np.concatenate([count, np.ones(np.count_nonzero(inside))]), len(held))
        out = [*held.tolist(), [*far.tolist()]]              # the gradient is the row that is one shorter
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64())), pa.array([*count.tolist(), 1.0])], names=["row", "n"])

    parts = rows.mapInArrow(run, "row array<double>, n double")
    near_rows = parts.where(F.size("row") == k + 1).groupBy("row").agg(F.sum("n").alias("n")).collect()
    far = parts.where(F.size("row") == k).agg(*[F.sum(F.col("row")[i]).alias(f"g{i}") for i in range(k)]).first()
    m = np.array([r["row"] for r in near_rows]).reshape(-1, k + 1)
    return m[:, :-1], m[:, -1], np.array([r["n"] for r in near_rows]), np.array(list(far), float)


def _independent(gram: np.ndarray) -> list[int]:
    """Columns that are not determined by the ones before, from their products."""
    out: list[int] = []
    for i in range(len(gram)):
        rest = gram[i, i] - (gram[i, out] @ np.linalg.solve(gram[np.ix_(out, out)], gram[out, i]) if out else 0.0)
        if rest > 1e-9 * gram[i, i]:
            out.append(i)
    return out


def _basis(x: np.ndarray) -> list[int]:
    """The first independent rows."""
    q, chosen = np.zeros((0, x.shape[1])), []
    for i, row in enumerate(x):
        rest = row - q.T @ (q @ row)
        if np.linalg.norm(rest) > 1e-8 * np.linalg.norm(row):
            q = np.vstack([q, rest / np.linalg.norm(rest)])
            chosen.append(i)
        if len(chosen) == x.shape[1]:
            break
    return chosen


def _descend(x: np.ndarray, y: np.ndarray, w: np.ndarray, far: np.ndarray, tau: float, beta: np.ndarray) -> np.ndarray | None:
    """The plane of least weighted loss less ``far`` * plane: from vertex to vertex along the steepest edge, each time as
    far as the loss falls.  None if the rows do not determine a plane."""
    scale = np.abs(y - x @ beta).max() + 1e-300
    given, y = y, y + 1e-9 * scale * np.random.default_rng(1).uniform(-1, 1, len(y))       # no ties
    order = np.argsort(np.abs(y - x @ beta), kind="stable")
    basis = [int(order[i]) for i in _basis(x[order])]
    if len(basis) < x.shape[1]:
        return None
    for _ in range(50 * len(y) + 100):
        inverse = np.linalg.inv(x[basis])
        beta = inverse @ y[basis]
        r = y - x @ beta
        out = np.ones(len(y), bool)
        out[basis] = False
        q = (x[out] * (w[out] * np.where(r[out] > 0, tau, tau - 1))[:, None]).sum(axis=0) + far
        a = inverse.T @ q
        up, down = a - w[basis] * (1 - tau), -a - w[basis] * tau         # gain per step when the row falls below, above
        j = int(np.argmax(np.maximum(up, down)))
        gain = max(up[j], down[j])
        if gain <= 1e-9 * (np.abs(q).sum() + w[basis][j]):
            break
        d = inverse[:, j] if up[j] >= down[j] else -inverse[:, j]
        slope = x @ d
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(out & (np.abs(slope) > 1e-12), r / slope, np.inf)
        t[~(t > 0)] = np.inf
        along = np.argsort(t, kind="stable")
        fall = np.cumsum(w[along] * np.abs(slope[along]))
        k = int(np.searchsorted(fall, gain))
        if k >= len(along) or not np.isfinite(t[along[k]]):
            return None                                  # falls without end within these rows
        basis[j] = int(along[k])
    return np.linalg.solve(x[basis], given[basis])


def fit_quantile(train: DataFrame, columns: Sequence[str], y: str = "y", quantile: float = 0.5) -> QuantileFit:
    """Linear quantile regression of ``y`` on ``columns`` (none: the quantile itself) over all rows that have them.

    Columns are standardised by the training rows, near-constant ones dropped.  The first pass is least squares; then each
    pass solves the normal equations weighted by 1 / max(|residual|, eps), eps half of the last one, from the mean
    residual on, and the best plane so far is kept.  From there exact rounds find the best plane given the sides of the
    rows that are not near, until a round no longer helps.  Rows with a null are left out; without rows it is an error.
    A column that earlier ones determine is dropped too.
    """
    train = train.dropna(subset=[y, *columns])
    stats = train.agg(F.count(F.lit(1)).alias("n"), *[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"), F.max(F.abs(c)).alias(f"a_{c}"))]).first()
    if not stats["n"]:
        raise ValueError("no rows to fit")
    keep = [c for c in columns if stats[f"s_{c}"] > 1e-8 * (stats[f"a_{c}"] + 1)]
    centre, scale = [float(stats[f"m_{c}"]) for c in keep], [float(stats[f"s_{c}"]) for c in keep]
    rows = _rows(train, keep, y, centre, scale).cache()
    k = len(keep) + 1
    solve = lambda a, b: np.linalg.solve(a + 1e-12 * np.diag(np.diag(a)), b)
    try:
        a, b, _ = _pass(rows, np.zeros(k), k, quantile, 1.0, True)
        free = _independent(a)
        if len(free) < k:
            return fit_quantile(train, [keep[i - 1] for i in free if i], y, quantile)
        beta = solve(a, b)
        best, loss, eps = beta, np.inf, 0.0
        for i in range(PASSES):
            if i == 0:                                   # the first loss sets the scale
                eps = max(_pass(rows, beta, k, quantile, 1.0, False)[2] / stats["n"], 1e-300)
            a, b, now = _pass(rows, beta, k, quantile, eps, False)
            if now < loss:
                best, loss = beta, now
            beta, eps = solve(a, b), eps / 2
        for _ in range(ROUNDS):
            near = _nearest(rows, best, k, NEAREST * k)
            edge = near[-1, 0] if len(near) == NEAREST * k else np.inf
            x, v, w, far = _reduced(rows, best, k, quantile, edge)
            there = _descend(x, v, w, far, quantile, best) if len(v) else None
            now = np.inf if there is None else _pass(rows, there, k, quantile, 1.0, False)[2]
            if not now < loss:
                break
            gain, best, loss = loss - now, there, now
            if gain <= 1e-12 * loss or edge == np.inf:
                break
    finally:
        rows.unpersist()
    slopes = best[1:] / np.array(scale) if keep else np.zeros(0)
    intercept = float(best[0] - slopes @ np.array(centre)) if keep else float(best[0])
    return QuantileFit(tuple(keep), intercept, tuple(map(float, slopes)), quantile, int(stats["n"]), loss / stats["n"])


def pinball(y: Column, pred: Column, quantile: float = 0.5) -> Column:
    """Loss of one prediction."""
    r = y - pred
    return F.when(r > 0, quantile * r).otherwise((quantile - 1) * r)
