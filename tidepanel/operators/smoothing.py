"""Exponential smoothing over blocks: state recursions as an associative scan of affine maps.

For fixed parameters a smoothing state moves by s[t] = A s[t-1] + c y[t], so a block of days is one affine map of the
state it starts from, and its sum of squared one-step errors a quadratic form in that state.  Blocks are worked on apart,
for a whole grid of parameters at once, and their summaries compose in order, whatever the bracketing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed grids: level weights, share of the level weight that the trend gets, damping.
LEVELS = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.99)
TRENDS = (0.0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8)
DAMPS = (0.8, 0.9, 0.95, 0.98)
#: Days per block.
BLOCK = 256


@dataclass(frozen=True)
class Smoother:
    """A grid of linear smoothers: state [level, trend], y[t] is expected at level + phi * trend."""

    alpha: np.ndarray
    beta: np.ndarray                                     # trend weight, 0 with phi 0 for simple smoothing
    phi: np.ndarray
    expect: np.ndarray = field(init=False)               # G x 2
    move: np.ndarray = field(init=False)                 # G x 2 x 2
    gain: np.ndarray = field(init=False)                 # G x 2

    def __post_init__(self):
        one = np.ones_like(self.alpha)
        object.__setattr__(self, "expect", np.stack([one, self.phi], axis=1))
        gain = np.stack([self.alpha, self.alpha * self.beta], axis=1)
        own = np.stack([np.stack([one, self.phi], axis=1), np.stack([0 * one, self.phi], axis=1)], axis=1)
        object.__setattr__(self, "move", own - gain[:, :, None] * self.expect[:, None, :])
        object.__setattr__(self, "gain", gain)

    @property
    def size(self) -> int:
        return len(self.alpha)


def simple(levels: Sequence[float] = LEVELS) -> Smoother:
    a = np.array(levels, float)
    return Smoother(a, 0 * a, 0 * a)


def damped_trend(levels: Sequence[float] = LEVELS, trends: Sequence[float] = TRENDS, damps: Sequence[float] = DAMPS) -> Smoother:
    a, b, p = (x.ravel() for x in np.meshgrid(levels, trends, damps, indexing="ij"))
    return Smoother(a, b, p)


#: A block's summary per grid point: map (4), offset (2), and errors as x'Qx + 2 r'x + c of the state x before it (3, 2, 1).
_WIDTH = 12


def block_summary(y: np.ndarray, s: Smoother) -> np.ndarray:
    """G x 12 summary of the days ``y``."""
    g = s.size
    m, v = np.tile(np.eye(2), (g, 1, 1)), np.zeros((g, 2))
    q, r, c = np.zeros((g, 2, 2)), np.zeros((g, 2)), np.zeros(g)
    for value in y:
        h = np.einsum("gi,gij->gj", s.expect, m)         # how the start state shifts the expectation
        e = value - np.einsum("gi,gi->g", s.expect, v)   # error from a start at zero
        q += h[:, :, None] * h[:, None, :]
        r -= h * e[:, None]
        c += e * e
        m = s.move @ m
        v = np.einsum("gij,gj->gi", s.move, v) + s.gain * value
    return np.concatenate([m.reshape(g, 4), v, q[:, [0, 0, 1], [0, 1, 1]], r, c[:, None]], axis=1)


def _parts(x: np.ndarray):
    q = np.empty((len(x), 2, 2))
    q[:, 0, 0], q[:, 0, 1], q[:, 1, 0], q[:, 1, 1] = x[:, 6], x[:, 7], x[:, 7], x[:, 8]
    return x[:, :4].reshape(-1, 2, 2), x[:, 4:6], q, x[:, 9:11], x[:, 11]


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Summary of one run of days followed by another; associative."""
    (m1, v1, q1, r1, c1), (m2, v2, q2, r2, c2) = _parts(first), _parts(then)
    t = m1.transpose(0, 2, 1)
    q = q1 + t @ q2 @ m1
    qv = np.einsum("gij,gj->gi", q2, v1)
    r = r1 + np.einsum("gij,gj->gi", t, qv + r2)
    c = c1 + c2 + np.einsum("gi,gi->g", v1, qv + 2 * r2)
    v = np.einsum("gij,gj->gi", m2, v1) + v2
    return np.concatenate([(m2 @ m1).reshape(-1, 4), v, q[:, [0, 0, 1], [0, 1, 1]], r, c[:, None]], axis=1)


def best_start(x: np.ndarray, s: Smoother, least: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """(start state, sum of squared errors) of every grid point: the start of least error; a state without trend has
    none, and directions that the days say nothing about start at zero."""
    _, _, q, r, c = _parts(x)
    start = np.zeros((len(x), 2))
    det = q[:, 0, 0] * q[:, 1, 1] - q[:, 0, 1] ** 2
    both = (det > least * q[:, 0, 0] * np.maximum(q[:, 1, 1], 1e-300)) & (s.phi > 0)
    level = ~both & (q[:, 0, 0] > 0)
    start[level, 0] = -r[level, 0] / q[level, 0, 0]
    start[both, 0] = -(q[both, 1, 1] * r[both, 0] - q[both, 0, 1] * r[both, 1]) / det[both]
    start[both, 1] = -(q[both, 0, 0] * r[both, 1] - q[both, 0, 1] * r[both, 0]) / det[both]
    sse = c + 2 * np.einsum("gi,gi->g", r, start) + np.einsum("gi,gij,gj->g", start, q, start)
    return start, np.maximum(sse, 0.0)


def _numbered(df: DataFrame) -> DataFrame:
    """Known values of each series with their number from 0 and block."""
    w = Window.partitionBy("series").orderBy("ds")
    d = df.where("y is not null").withColumn("i", F.row_number().over(w) - 1)
    return d.select("series", "ds", "i", F.floor(F.col("i") / BLOCK).cast("int").alias("block"), F.col("y").cast("double").alias("y"))


def block_summaries(numbered: DataFrame, s: Smoother) -> DataFrame:
    """(series, block, days, summary): each block on its own, all grid points at once."""
    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        y = part.sort_values("i")["y"].to_numpy()
        return pd.DataFrame({"series": [key[0]], "block": [key[1]], "days": [len(y)], "summary": [block_summary(y, s).tobytes()]})

    return numbered.groupBy("series", "block").applyInPandas(run, "series string, block int, days int, summary binary")


def _folded(blocks: pd.DataFrame) -> np.ndarray:
    total = None
    for raw in blocks.sort_values("block")["summary"]:
        x = np.frombuffer(raw).reshape(-1, _WIDTH)
        total = x if total is None else compose(total, x)
    return total


def fit(df: DataFrame, s: Smoother) -> DataFrame:
    """(series, n, alpha, beta, phi, level0, trend0, level, trend, sse): the grid point and start of least squared error.

    Ties go to the earlier grid point.  Null values are skipped; a series without values gives no row.  Per series the
    fold reads one summary per BLOCK days.
    """
    def run(key, blocks: pd.DataFrame) -> pd.DataFrame:
        x = _folded(blocks)
        start, sse = best_start(x, s)
        k = int(np.argmin(sse))
        m, v, *_ = _parts(x[k:k + 1])
        end = m[0] @ start[k] + v[0]
        return pd.DataFrame({"series": [key[0]], "n": [int(blocks["days"].sum())], "alpha": [s.alpha[k]], "beta": [s.beta[k]], "phi": [s.phi[k]],
                             "level0": [start[k, 0]], "trend0": [start[k, 1]], "level": [end[0]], "trend": [end[1]], "sse": [sse[k]]})

    schema = "series string, n bigint, " + ", ".join(f"{c} double" for c in ("alpha", "beta", "phi", "level0", "trend0", "level", "trend", "sse"))
    return block_summaries(_numbered(df), s).groupBy("series").applyInPandas(run, schema)


def levels(df: DataFrame, fitted: DataFrame) -> DataFrame:
    """(series, ds, y, expected, level, trend) of every day under each series' fitted parameters.

    Two passes: every block's map of the state gives the state it starts from, then blocks unroll on their own.
    """
    numbered = _numbered(df).join(fitted.select("series", "alpha", "beta", "phi", "level0", "trend0"), "series")

    def smoother(part: pd.DataFrame) -> Smoother:
        return Smoother(*(part[c].to_numpy()[:1] for c in ("alpha", "beta", "phi")))

    def summarise(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        first = part.iloc[0]
        x = block_summary(part["y"].to_numpy(), smoother(part))
        return pd.DataFrame({"series": [key[0]], "block": [key[1]], "summary": [x.tobytes()], "level0": [first["level0"]], "trend0": [first["trend0"]]})

    def chain(key, blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("block")
        state, starts = blocks[["level0", "trend0"]].to_numpy()[0], []
        for raw in blocks["summary"]:
            starts.append(state)
            m, v, *_ = _parts(np.frombuffer(raw).reshape(1, _WIDTH))
            state = m[0] @ state + v[0]
        at = np.array(starts)
        return pd.DataFrame({"series": key[0], "block": blocks["block"].to_numpy(), "from_level": at[:, 0], "from_trend": at[:, 1]})

    def unroll(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        s, state, out = smoother(part), part[["from_level", "from_trend"]].to_numpy()[0], []
        for y in part["y"]:
            expected = float(s.expect[0] @ state)
            state = s.move[0] @ state + s.gain[0] * y
            out.append((expected, *state))
        at = np.array(out)
        return pd.DataFrame({"series": part["series"], "ds": part["ds"], "y": part["y"], "expected": at[:, 0], "level": at[:, 1], "trend": at[:, 2]})

    summaries = numbered.groupBy("series", "block").applyInPandas(summarise, "series string, block int, summary binary, level0 double, trend0 double")
    starts = summaries.groupBy("series").applyInPandas(chain, "series string, block int, from_level double, from_trend double")
    kind = dict(df.dtypes)["ds"]
    return numbered.join(starts, ["series", "block"]).groupBy("series", "block").applyInPandas(unroll, f"series string, ds {kind}, y double, expected double, level double, trend double")


def smoothing_forecasts(fitted: DataFrame, horizon: int, method: str = "ETS") -> DataFrame:
    """(series, h, method, pred): the last level and the damped sum of the last trend."""
    f = fitted.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    damp = F.when(F.col("phi") == 1, F.col("h")).otherwise(F.col("phi") * (1 - F.pow("phi", "h")) / F.nullif(1 - F.col("phi"), F.lit(0.0)))
    return f.select("series", "h", F.lit(method).alias("method"), (F.col("level") + F.coalesce(damp, F.lit(0.0)) * F.col("trend")).alias("pred"))


def theta_forecasts(df: DataFrame, horizon: int, s: Smoother | None = None, theta: float = 2.0) -> DataFrame:
    """(series, h, method, pred) of the Theta method: simple smoothing plus its share of the straight line's slope.

    The line is fitted to all values over their numbers; with a weight a and n values, step h adds
    (1 - 1/theta) * slope * (h - 1 + (1 - (1 - a)^n) / a).  A single value is repeated.
    """
    line = _numbered(df).groupBy("series").agg(F.coalesce(F.regr_slope("y", "i"), F.lit(0.0)).alias("slope"))
    f = fit(df, s or simple()).join(line, "series").withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    drift = (1 - 1 / theta) * F.col("slope") * (F.col("h") - 1 + (1 - F.pow(1 - F.col("alpha"), F.col("n"))) / F.col("alpha"))
    return f.select("series", "h", F.lit("Theta").alias("method"), (F.col("level") + drift).alias("pred"))
