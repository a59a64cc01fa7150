"""Windowed features of daily series.  Every feature of a day uses earlier days only.

All windows share one partitioning and order (series, day), so a feature build is one shuffle and one
sort however many columns are asked for; columns that are not selected are pruned from the windows.
Features are given as Spark SQL text per name: a pool of a hundred windows is then a few calls to the
session instead of thousands.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators import calendar as cal

EPS = "1e-8D"
LAGS = (*range(1, 16), 20, 25, 30)
ROLL = (5, 10, 15, 20, 25, 30, 60, 120)


class SeriesWindow:
    """Frames over one series in day order, as Columns and (``sql_``) as text."""

    def __init__(self, keys=("series",), order: str = "ds", value: str = "y"):
        self.keys, self.order, self.value = list(keys), order, value

    @property
    def w(self):
        return Window.partitionBy(*self.keys).orderBy(self.order)

    def back(self, n: int):
        """The n rows before the current one."""
        return self.w.rowsBetween(-n, -1)

    def to_now(self, n: int):
        """The current row and the n - 1 before it."""
        return self.w.rowsBetween(-(n - 1), 0)

    def lag(self, k: int, col=None) -> Column:
        return F.lag(col if col is not None else self.value, k).over(self.w)

    def sql_over(self, frame: str = "", extra: str = "") -> str:
        return f"OVER (PARTITION BY {', '.join(self.keys)}{extra} ORDER BY {self.order} {frame})"

    def sql_back(self, agg: str, n: int) -> str:
        return f"{agg} {self.sql_over(f'ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING')}"

    def sql_now(self, agg: str, n: int) -> str:
        return f"{agg} {self.sql_over(f'ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW')}"

    def sql_lag(self, k: int, col: str | None = None) -> str:
        return f"lag({col or self.value}, {k}) {self.sql_over()}"

    def sql_full(self, agg: str, n: int, col: str | None = None) -> str:
        """The aggregate over the n rows before, only where all n are known."""
        return f"CASE WHEN {self.sql_back(f'count({col or self.value})', n)} = {n} THEN {self.sql_back(agg, n)} END"


def add(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    return df.selectExpr("*", *[f"{e} AS `{n}`" for n, e in cols.items()])


def _safe(e: str) -> str:
    return f"(abs(coalesce({e}, 0D)) + {EPS})"


def with_index(df: DataFrame, sw: SeriesWindow) -> DataFrame:
    """Row index from 0 and series length."""
    return add(df, {"_i": f"row_number() {sw.sql_over()} - 1", "_n": f"count(1) OVER (PARTITION BY {', '.join(sw.keys)})"})


def lag_features(sw, lags=LAGS) -> dict[str, str]:
    return {f"lag_{k}": sw.sql_lag(k) for k in lags}


def rolling_features(sw, windows=ROLL) -> dict[str, str]:
    return {f"rolling_{name}_{n}": sw.sql_full(f"{agg}({sw.value})", n) for n in windows
            for name, agg in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))}


def quantile_features(sw, windows=(7, 30)) -> dict[str, str]:
    out, v = {}, sw.value
    for n in windows:
        out[f"rolling_median_{n}"] = sw.sql_full(f"percentile({v}, 0.5D)", n)
        out[f"rolling_q25_{n}"], out[f"rolling_q75_{n}"] = sw.sql_back(f"percentile({v}, 0.25D)", n), sw.sql_back(f"percentile({v}, 0.75D)", n)
        out[f"rolling_range_{n}"] = f"{sw.sql_full(f'max({v})', n)} - {sw.sql_back(f'min({v})', n)}"
    return out


def shape_features(sw, windows=(7, 30)) -> dict[str, str]:
    """Bias-corrected skewness and excess kurtosis of full windows."""
    out = {}
    for n in windows:
        out[f"rolling_skew_{n}"] = f"{sw.sql_full(f'skewness({sw.value})', n)} * {math.sqrt(n * (n - 1)) / (n - 2)!r}D"
        out[f"rolling_kurt_{n}"] = f"({n + 1} * {sw.sql_full(f'kurtosis({sw.value})', n)} + 6) * {(n - 1) / ((n - 2) * (n - 3))!r}D"
    return out


def _change(sw, p: int) -> str:
    return f"({sw.sql_lag(1)} - {sw.sql_lag(p + 1)})"


def change_features(sw, periods=(1, 5, 30)) -> dict[str, str]:
    out = {}
    for p in periods:
        out[f"value_diff_{p}"] = _change(sw, p)
        out[f"value_pct_change_{p}"] = f"{_change(sw, p)} / {_safe(sw.sql_lag(p + 1))}"
    return out


def momentum_features(sw, moms=(7, 30, 60), rocs=(7, 14, 30, 60, 90)) -> dict[str, str]:
    out = {f"momentum_{p}": _change(sw, p) for p in moms}
    out.update({f"roc_{p}": f"{_change(sw, p)} / {_safe(sw.sql_lag(p + 1))}" for p in rocs})
    return out


def volatility_features(sw, windows=(5, 15, 30)) -> dict[str, str]:
    return {f"volatility_{n}": f"{sw.sql_full(f'stddev_samp({sw.value})', n)} / {_safe(sw.sql_back(f'avg({sw.value})', n))}" for n in windows}


def regime_features(sw, median_window: int = 60) -> dict[str, str]:
    """Needs the volatility columns."""
    return {"volatility_ratio_5_30": f"volatility_5 / (volatility_30 + {EPS})",
            "is_high_volatility_regime": f"CAST(coalesce({sw.sql_lag(1, 'volatility_15')} > {sw.sql_back('percentile(volatility_15, 0.5D)', median_window)}, false) AS DOUBLE)"}


def position_features(sw, windows=(30, 60)) -> dict[str, str]:
    out = {}
    for n in windows:
        lo, hi = sw.sql_back(f"min({sw.value})", n), sw.sql_back(f"max({sw.value})", n)
        out[f"price_position_{n}"] = f"({sw.sql_lag(1)} - {lo}) / ({hi} - {lo} + {EPS})"
    return out


def with_changes(df: DataFrame, sw: SeriesWindow) -> DataFrame:
    """Helper columns: last known change and its ratio to the level before."""
    return add(df, {"_ch": _change(sw, 1), "_ret": f"{_change(sw, 1)} / {_safe(sw.sql_lag(2))}"})


def asymmetric_features(sw, windows=(15, 30)) -> dict[str, str]:
    out = {}
    for n in windows:
        dn = sw.sql_now("stddev_samp(CASE WHEN _ret > 0 THEN 0D ELSE _ret END)", n)
        up = sw.sql_now("stddev_samp(CASE WHEN _ret < 0 THEN 0D ELSE _ret END)", n)
        out[f"downside_volatility_{n}"], out[f"upside_volatility_{n}"], out[f"volatility_skew_{n}"] = dn, up, f"{dn} / ({up} + {EPS})"
    return out


def rsi_features(sw, windows=(15,)) -> dict[str, str]:
    gain, loss = "avg(CASE WHEN _ch > 0 THEN _ch WHEN _ch <= 0 THEN 0D END)", "avg(CASE WHEN _ch < 0 THEN -_ch WHEN _ch >= 0 THEN 0D END)"
    return {f"rsi_{n}": f"100 - 100 / (1 + {sw.sql_now(gain, n)} / ({sw.sql_now(loss, n)} + {EPS}))" for n in windows}


def bollinger_features(sw, n: int = 20) -> dict[str, str]:
    m, s = sw.sql_full(f"avg({sw.value})", n), sw.sql_full(f"stddev_samp({sw.value})", n)
    up, lo = f"({m} + 2 * {s})", f"({m} - 2 * {s})"
    return {f"bb_upper_{n}": up, f"bb_lower_{n}": lo, f"bb_middle_{n}": m, f"bb_width_{n}": f"try_divide({up} - {lo}, {m} + {EPS})",
            f"bb_percent_{n}": f"({sw.sql_lag(1)} - {lo}) / ({up} - {lo} + {EPS})"}


def zscore_features(sw, windows=(15, 30)) -> dict[str, str]:
    out = {}
    for n in windows:
        z = f"(({sw.sql_lag(1)} - {sw.sql_back(f'avg({sw.value})', n)}) / ({sw.sql_back(f'stddev_samp({sw.value})', n)} + {EPS}))"
        out[f"z_score_{n}"] = z
        out[f"is_extreme_high_{n}"], out[f"is_extreme_low_{n}"] = f"CAST(coalesce({z} > 2, false) AS DOUBLE)", f"CAST(coalesce({z} < -2, false) AS DOUBLE)"
    return out


def jump_features(sw, n: int = 15) -> dict[str, str]:
    typical = sw.sql_now("avg(abs(_ch))", n)
    sd = f"CASE WHEN {sw.sql_now('count(_ch)', n)} = {n} THEN {sw.sql_now('stddev_samp(_ch)', n)} END"
    return {"jump_size": f"abs(_ch) / ({typical} + {EPS})", "is_jump": f"CAST(coalesce(abs(_ch) > {typical} + 2 * {sd}, false) AS DOUBLE)"}


def since_jump(sw, cap: float = 120.0) -> dict[str, str]:
    """Needs is_jump and the row index."""
    last = f"max(CASE WHEN is_jump = 1 THEN _i END) {sw.sql_over('ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING')}"
    return {"days_since_jump": f"least(CAST(_i - coalesce({last}, 0) AS DOUBLE), {cap!r}D)"}


def change_limit_features(sw, n: int = 15) -> dict[str, str]:
    hi, lo = sw.sql_now("max(_ch)", n), sw.sql_now("min(_ch)", n)
    return {f"max_change_{n}d": hi, f"min_change_{n}d": lo, f"change_range_{n}d": f"{hi} - {lo}"}


def run_lengths(df: DataFrame, sw: SeriesWindow, flag: str, name: str) -> DataFrame:
    """Running count of consecutive rows with the flag set."""
    d = add(df, {"_t": f"coalesce(CAST({flag} <> {sw.sql_lag(1, flag)} AS INT), 1)"})
    d = add(d, {"_g": f"sum(_t) {sw.sql_over()}"})
    return add(d, {name: f"sum({flag}) {sw.sql_over(extra=', _g')}"}).drop("_t", "_g")


def autocorr_features(df: DataFrame, sw: SeriesWindow, lags=(7, 14, 30), n: int = 60) -> DataFrame:
    """Autocorrelation inside the last n rows; 0 for a constant window."""
    d = add(df, {x: e for k in lags for x, e in ((f"_p{k}", sw.sql_lag(k)), (f"_q{k}", f"CASE WHEN {sw.sql_lag(k)} IS NOT NULL THEN {sw.value} END"))})
    cols = {}
    for k in lags:
        over = sw.sql_over(f"ROWS BETWEEN {n - k} PRECEDING AND 1 PRECEDING")
        c = f"try_divide(covar_samp(_q{k}, _p{k}) {over}, stddev_samp(_q{k}) {over} * stddev_samp(_p{k}) {over})"
        known, spread = sw.sql_back(f"count({sw.value})", n), sw.sql_back(f"stddev_samp({sw.value})", n)
        cols[f"autocorr_{k}"] = f"CASE WHEN {known} > {k} THEN CASE WHEN {spread} > 0 THEN {c} ELSE 0D END END"
    return add(d, cols).drop(*[x for k in lags for x in (f"_p{k}", f"_q{k}")])


def distance_features(sw, windows=(7, 30, 60)) -> dict[str, str]:
    v = sw.value
    return {f"distance_from_mean_{n}": f"({sw.sql_lag(1)} - {sw.sql_full(f'avg({v})', n)}) / ({sw.sql_back(f'stddev_samp({v})', n)} + {EPS})" for n in windows}


# --- exponentially weighted sums ---------------------------------------------------------------------

def ewm_sums(df: DataFrame, sw: SeriesWindow, specs: dict[str, tuple[str, str, float]]) -> DataFrame:
    """name -> S_t = sum of w^(t-k) x_k with w = 1 - 2/(span+1), for (x, j, span) where j counts the
    non-null x from 0.

    Weights are rebased every 20 spans, so the powers stay finite.  A block starts from the sums at the ends of all
    blocks before it, chained by Horner's rule, so nothing is left out however old; a row folds over one value per
    block, not over its history."""
    pos, cur, fin = {}, {}, {}
    for n, (x, j, span) in specs.items():
        w, size = 1 - 2.0 / (span + 1), int(20 * span)
        pos[f"_b_{n}"], pos[f"_r_{n}"] = f"floor(({j}) / {size})", f"({j}) - floor(({j}) / {size}) * {size}"
        cur[f"_c_{n}"] = f"power({w!r}D, _r_{n}) * sum({x} * power({w!r}D, -_r_{n})) {sw.sql_over('ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW', f', _b_{n}')}"
        ends = f"collect_list(CASE WHEN _r_{n} = {size - 1} THEN _c_{n} END) {sw.sql_over('ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING')}"
        carry = f"aggregate({ends}, 0D, (s, c) -> s * power({w!r}D, {size}) + c)"
        fin[n] = f"CASE WHEN ({j}) >= 0 THEN _c_{n} + power({w!r}D, _r_{n} + 1) * {carry} END"
    d = add(add(add(df, pos), cur), fin)
    return d.drop(*pos, *cur)


def ewm_features(df: DataFrame, sw: SeriesWindow, spans=(5, 30)) -> DataFrame:
    """Adjusted exponentially weighted mean and bias-corrected deviation of the lagged value."""
    d = add(df, {"_x": sw.sql_lag(1), "_xx": f"{sw.sql_lag(1)} * {sw.sql_lag(1)}"})
    d = ewm_sums(d, sw, {f"_s{k}_{sp}": (x, "_i - 1", sp) for sp in spans for k, x in ((1, "_x"), (2, "_xx"))})
    cols = {}
    for sp in spans:
        w = 1 - 2.0 / (sp + 1)
        s0, w2 = f"((1 - power({w!r}D, _i)) / {1 - w!r}D)", f"((1 - power({w!r}D, 2 * _i)) / {1 - w * w!r}D)"
        mean = f"(_s1_{sp} / {s0})"
        cols[f"ewm_{sp}"] = f"CASE WHEN _i >= 1 THEN {mean} END"
        cols[f"ewm_std_{sp}"] = f"CASE WHEN _i >= 2 THEN sqrt(greatest(_s2_{sp} / {s0} - {mean} * {mean}, 0D) * try_divide({s0} * {s0}, {s0} * {s0} - {w2})) END"
    return add(d, cols).drop("_x", "_xx", *[f"_s{k}_{sp}" for sp in spans for k in (1, 2)])


def ema_sql(s: str, j: str, first: str, span: float) -> str:
    """Recursive average e = a x + (1 - a) e started at the first value, from its weighted sum."""
    a = 2.0 / (span + 1)
    return f"CASE WHEN ({j}) >= 0 THEN {a!r}D * {s} + {1 - a!r}D * power({1 - a!r}D, greatest({j}, 0)) * {first} END"


def macd_features(df: DataFrame, sw: SeriesWindow, fast: int = 10, slow: int = 25, signal: int = 10) -> DataFrame:
    d = add(df, {"_x": sw.sql_lag(1), "_x0": f"first({sw.value}) {sw.sql_over()}"})
    d = ewm_sums(d, sw, {"_f": ("_x", "_i - 1", fast), "_g": ("_x", "_i - 1", slow)})
    d = add(d, {"macd": f"{ema_sql('_f', '_i - 1', '_x0', fast)} - {ema_sql('_g', '_i - 1', '_x0', slow)}"})
    d = ewm_sums(add(d, {"_m": sw.sql_lag(1, "macd")}), sw, {"_s": ("_m", "_i - 2", signal)})
    d = add(d, {"macd_signal": ema_sql("_s", "_i - 2", "0D", signal)})                # the first macd is exactly 0
    return add(d, {"macd_histogram": "macd - macd_signal"}).drop("_x", "_x0", "_f", "_g", "_m", "_s")


# --- whole pool ----------------------------------------------------------------------------------------

INTERACTIONS = (("lag_1", "day_of_week"), ("lag_5", "day_of_week"), ("rolling_mean_5", "month"), ("rolling_mean_30", "is_weekend"))


def interactions(pairs=INTERACTIONS) -> dict[str, str]:
    return {f"{a}_x_{b}": f"{a} * {b}" for a, b in pairs}


def cross_lags(df: DataFrame, sw: SeriesWindow, columns: list[str], lags=range(1, 16), mean_window: int = 5) -> DataFrame:
    """Lags and a short mean of other series already joined as columns."""
    cols = {}
    for c in columns:
        cols.update({f"ext_{c}_lag_{k}": sw.sql_lag(k, c) for k in lags})
        cols[f"ext_{c}_rolling_mean_{mean_window}"] = sw.sql_full(f"avg({c})", mean_window, c)
    return add(df, cols)


def gated(cols: dict[str, str], span_of) -> dict[str, str]:
    """Features kept only for series at least three windows long; needs the series length."""
    return {n: f"CASE WHEN _n >= {3 * span_of(n)} THEN {e} END" for n, e in cols.items()}


def feature_pool(df: DataFrame, sw: SeriesWindow) -> DataFrame:
    """The 116 internal candidates, unfilled."""
    day = F.col(sw.order)
    d = df.select("*", *[c.alias(n) for n, c in {**cal.calendar_features(day), **cal.fourier_features(day), **cal.period_end_features(day)}.items()])
    d = with_changes(with_index(d, sw), sw)
    d = add(d, {**lag_features(sw), **rolling_features(sw), **change_features(sw), **volatility_features(sw), **position_features(sw), **asymmetric_features(sw),
                **change_limit_features(sw), **zscore_features(sw), **jump_features(sw), **rsi_features(sw), **bollinger_features(sw)})
    d = add(d, {**regime_features(sw), **since_jump(sw), **interactions()})
    return macd_features(ewm_features(d, sw), sw).drop("_ch", "_ret", "_i", "_n")


def feature_names(df: DataFrame, sw: SeriesWindow) -> list[str]:
    return [c for c in df.columns if c not in (*sw.keys, sw.order, sw.value)]


def fill_features(df: DataFrame, sw: SeriesWindow, columns: list[str]) -> DataFrame:
    """Infinite values count as missing; then forward fill, backward fill and 0.

    After the forward fill only leading cells are empty, so the backward fill is the first known value."""
    rest = [c for c in df.columns if c not in columns]
    up, whole = sw.sql_over("ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"), sw.sql_over("ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING")
    clean = df.selectExpr(*rest, *[f"CASE WHEN abs({c}) < double('infinity') THEN {c} END AS {c}" for c in columns])
    return clean.selectExpr(*rest, *[f"coalesce(last({c}) IGNORE NULLS {up}, first({c}) IGNORE NULLS {whole}, 0D) AS {c}" for c in columns])


def macro_features(df: DataFrame, sw: SeriesWindow, kind: str = "price") -> DataFrame:
    """Level with zeros removed and carried forward, 1- and 5-day change, 20-day change volatility."""
    v = sw.value
    good = f"{v} > 0" if kind == "price" else f"{v} <> 0"
    d = add(df, {"lvl": f"last(CASE WHEN {good} THEN {v} END) IGNORE NULLS {sw.sql_over('ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')}"})
    d = add(d, {"_l": "ln(lvl)" if kind == "price" else "lvl"})
    d = add(d, {"chg1": f"(_l - {sw.sql_lag(1, '_l')}) * 100", "chg5": f"(_l - {sw.sql_lag(5, '_l')}) * 100"})
    return add(d, {"vol20": f"CASE WHEN {sw.sql_now('count(chg1)', 20)} >= 10 THEN {sw.sql_now('stddev_samp(chg1)', 20)} END"}).drop("_l")


def rolling_statistics(df: DataFrame, sw: SeriesWindow, window: int = 90) -> DataFrame:
    ok = f"{sw.sql_now(f'count({sw.value})', window)} >= {max(2, window // 3)}"
    return add(df, {f"roll_{n}": f"CASE WHEN {ok} THEN {sw.sql_now(f'{a}({sw.value})', window)} END" for n, a in (("mean", "avg"), ("std", "stddev_samp"))})
