"""Windowed features, one query per family."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import align
from tidepanel.operators import features as ft
from tidepanel.plans import base as b
from tidepanel.plans.registry import query

SW = ft.SeriesWindow()
_P = "(PARTITION BY series ORDER BY ds"
_EPS = 1e-8


def _fr(n, end="1 PRECEDING"):
    return f"{_P} ROWS BETWEEN {n} PRECEDING AND {end})"


def _back(e, n):
    return f"{e} OVER {_fr(n)}"


def _now(e, n):
    return f"{e} OVER {_fr(n - 1, 'CURRENT ROW')}"


def _full(e, n):
    return f"CASE WHEN {_back('count(y)', n)} = {n} THEN {_back(e, n)} END"


def _lag(k, c="y"):
    return f"lag({c}, {k}) OVER {_P})"


def _safe(e):
    return f"(abs(coalesce({e}, 0)) + {_EPS})"


def indexed(s, d):
    return ft.with_index(b.series(s, d), SW)


def changed(s, d):
    return ft.with_changes(indexed(s, d), SW)


def family(name, cols, sql_cols, build, digits=4, sql_from="idx", ctes=""):
    spec = "series:s ds:d " + " ".join(c if ":" in c else f"{c}:{digits}" for c in cols)
    sel = ", ".join(f"{e} AS {n}" for n, e in sql_cols.items())
    query(name, spec, f"WITH {b.INDEXED}{', ' + ctes if ctes else ''} SELECT series, ds, {sel} FROM {sql_from}")(build)


def _sel(df, cols):
    return df.selectExpr("series", "ds", *[f"{e} AS {n}" for n, e in cols.items()])


_lags = {f"lag_{k}": _lag(k) for k in ft.LAGS}
family("w1_lags", _lags, _lags, lambda s, d: _sel(indexed(s, d), ft.lag_features(SW)), 0)

_roll = {f"rolling_{a}_{n}": _full(f"{e}(y)", n) for n in ft.ROLL for a, e in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))}
family("w2_rolling", _roll, _roll, lambda s, d: _sel(indexed(s, d), ft.rolling_features(SW)))

_q = {}
for _n in (7, 30):
    _q[f"rolling_median_{_n}"] = _full("quantile_cont(y, 0.5)", _n)
    _q[f"rolling_q25_{_n}"], _q[f"rolling_q75_{_n}"] = _back("quantile_cont(y, 0.25)", _n), _back("quantile_cont(y, 0.75)", _n)
    _q[f"rolling_range_{_n}"] = f"CASE WHEN {_back('count(y)', _n)} = {_n} THEN {_back('max(y)', _n)} - {_back('min(y)', _n)} END"
family("w3_rolling_quantiles", _q, _q, lambda s, d: _sel(indexed(s, d), ft.quantile_features(SW)))

_shape = {f"rolling_{a}_{n}": _full(f"{e}(y)", n) for n in (7, 30) for a, e in (("skew", "skewness"), ("kurt", "kurtosis"))}
family("w4_rolling_shape", _shape, _shape, lambda s, d: _sel(indexed(s, d), ft.shape_features(SW)))


def _ew_cte(name, span, src="idx", x="y", shift=1):
    w = 1 - 2.0 / (span + 1)
    p = f"pow({w!r}, a.i - {shift} - b.i)"
    return f"""{name} AS (SELECT a.series, a.ds, sum({p} * b.{x}) AS s1, sum({p} * b.{x} * b.{x}) AS s2, sum({p}) AS s0, sum({p} * {p}) AS w2, count(*) AS k
  FROM {src} a JOIN {src} b ON a.series = b.series AND b.i <= a.i - {shift} GROUP BY 1, 2)"""


_ewm = {}
for _sp in (5, 30):
    _ewm[f"ewm_{_sp}"] = f"e{_sp}.s1 / e{_sp}.s0"
    _ewm[f"ewm_std_{_sp}"] = f"CASE WHEN e{_sp}.k > 1 THEN sqrt((e{_sp}.s2/e{_sp}.s0 - pow(e{_sp}.s1/e{_sp}.s0, 2)) * e{_sp}.s0*e{_sp}.s0/(e{_sp}.s0*e{_sp}.s0 - e{_sp}.w2)) END"
family("w5_ewm", _ewm, _ewm, lambda s, d: ft.ewm_features(indexed(s, d), SW), 4,
       "idx LEFT JOIN e5 USING (series, ds) LEFT JOIN e30 USING (series, ds)", _ew_cte("e5", 5) + ", " + _ew_cte("e30", 30))

_chg = {}
for _p in (1, 5, 30):
    _chg[f"value_diff_{_p}"] = f"{_lag(1)} - {_lag(_p + 1)}"
    _chg[f"value_pct_change_{_p}"] = f"({_lag(1)} - {_lag(_p + 1)}) / {_safe(_lag(_p + 1))}"
family("w6_changes", [c if "diff" in c else f"{c}:L6" for c in _chg], _chg, lambda s, d: _sel(indexed(s, d), ft.change_features(SW)))

_vol = {f"volatility_{n}": f"CASE WHEN {_back('count(y)', n)} = {n} THEN {_back('stddev_samp(y)', n)} / {_safe(_back('avg(y)', n))} END" for n in (5, 15, 30)}
_VOLCTE = "vol AS (SELECT series, ds, i, " + ", ".join(f"{e} AS volatility_{n}" for n, e in zip((5, 15, 30), _vol.values())) + " FROM idx)"


def _vol_df(s, d):
    return ft.add(indexed(s, d), ft.volatility_features(SW))


family("w7_volatility", [f"{c}:L6" for c in (*_vol, "volatility_ratio_5_30")], {**{k: k for k in _vol}, "volatility_ratio_5_30": f"volatility_5 / (volatility_30 + {_EPS})"},
       lambda s, d: ft.add(_vol_df(s, d), ft.regime_features(SW)), 4, "vol", _VOLCTE)
family("w8_high_volatility_regime", ["is_high_volatility_regime:0"], {"is_high_volatility_regime": f"CAST(coalesce({_lag(1, 'volatility_15')} > {_back('quantile_cont(volatility_15, 0.5)', 60)}, FALSE) AS INT)"},
       lambda s, d: ft.add(_vol_df(s, d), ft.regime_features(SW)), 0, "vol", _VOLCTE)

_pos = {f"price_position_{n}": f"({_lag(1)} - {_back('min(y)', n)}) / ({_back('max(y)', n)} - {_back('min(y)', n)} + {_EPS})" for n in (30, 60)}
family("w9_price_position", _pos, _pos, lambda s, d: _sel(indexed(s, d), ft.position_features(SW)))

_CH = f"ch0 AS (SELECT *, {_lag(1)} - {_lag(2)} AS ch, {_lag(2)} AS l2, {_lag(1)} AS l1 FROM idx), ch AS (SELECT *, ch / {_safe('l2')} AS ret FROM ch0)"
_asym = {}
for _n in (15, 30):
    _dn, _up = _now("stddev_samp(CASE WHEN ret > 0 THEN 0 ELSE ret END)", _n), _now("stddev_samp(CASE WHEN ret < 0 THEN 0 ELSE ret END)", _n)
    _asym[f"downside_volatility_{_n}"], _asym[f"upside_volatility_{_n}"] = _dn, _up
    _asym[f"volatility_skew_{_n}"] = f"{_dn} / ({_up} + {_EPS})"


family("w10_asymmetric_volatility", [f"{c}:L6" for c in _asym], _asym, lambda s, d: _sel(changed(s, d), ft.asymmetric_features(SW)), 4, "ch", _CH)

_rsi = {"rsi_15": f"100 - 100 / (1 + {_now('avg(CASE WHEN ch IS NOT NULL THEN greatest(ch, 0) END)', 15)} / ({_now('avg(CASE WHEN ch IS NOT NULL THEN greatest(-ch, 0) END)', 15)} + {_EPS}))"}
family("w11_rsi", _rsi, _rsi, lambda s, d: _sel(changed(s, d), ft.rsi_features(SW)), 4, "ch", _CH)


def _ema_cte(name, span, src, x, shift, first):
    a = 2.0 / (span + 1)
    return f"""{name} AS (SELECT a.series, a.ds, a.i, {a!r} * sum(pow({1 - a!r}, a.i - {shift} - b.i) * b.{x}) + {1 - a!r} * pow({1 - a!r}, a.i - {shift} - 1 - {shift - 1}) * {first} AS e
  FROM {src} a JOIN {src} b ON a.series = b.series AND b.i <= a.i - {shift} GROUP BY a.series, a.ds, a.i)"""


_X0 = "x0 AS (SELECT *, first(y) OVER (PARTITION BY series ORDER BY ds) AS y0 FROM idx)"
_MACD = f"""{_X0}, {_ema_cte('f', 10, 'x0', 'y', 1, 'any_value(a.y0)')}, {_ema_cte('g', 25, 'x0', 'y', 1, 'any_value(a.y0)')},
m AS (SELECT idx.series, idx.ds, idx.i, f.e - g.e AS macd FROM idx LEFT JOIN f USING (series, ds) LEFT JOIN g USING (series, ds)),
mm AS (SELECT * FROM m WHERE macd IS NOT NULL), sig AS (SELECT a.series, a.ds, {2 / 11!r} * sum(pow({1 - 2 / 11!r}, a.i - 1 - b.i) * b.macd) AS e
  FROM mm a JOIN mm b ON a.series = b.series AND b.i < a.i GROUP BY 1, 2)"""
family("w12_macd", ["macd", "macd_signal", "macd_histogram"], {"macd": "macd", "macd_signal": "sig.e", "macd_histogram": "macd - sig.e"},
       lambda s, d: ft.macd_features(indexed(s, d), SW), 4, "m LEFT JOIN sig USING (series, ds)", _MACD)

_BB = f"bb AS (SELECT series, ds, {_lag(1)} AS l1, {_full('avg(y)', 20)} AS m, {_full('stddev_samp(y)', 20)} AS s FROM idx)"
_bb = {"bb_upper_20": "m + 2*s", "bb_lower_20": "m - 2*s", "bb_middle_20": "m", "bb_width_20": f"4*s/(m + {_EPS})", "bb_percent_20": f"(l1 - (m - 2*s)) / (4*s + {_EPS})"}
family("w13_bollinger", [f"{c}:L6" if "width" in c else c for c in _bb], _bb, lambda s, d: _sel(indexed(s, d), ft.bollinger_features(SW)), 4, "bb", _BB)

_z = {}
for _n in (15, 30):
    _e = f"({_lag(1)} - {_back('avg(y)', _n)}) / ({_back('stddev_samp(y)', _n)} + {_EPS})"
    _z[f"z_score_{_n}"], _z[f"is_extreme_high_{_n}"], _z[f"is_extreme_low_{_n}"] = _e, f"CAST(coalesce({_e} > 2, FALSE) AS INT)", f"CAST(coalesce({_e} < -2, FALSE) AS INT)"
family("w14_z_score", _z, _z, lambda s, d: _sel(indexed(s, d), ft.zscore_features(SW)))

_JUMP = f"""{_CH}, jmp AS (SELECT *, abs(ch) / ({_now('avg(abs(ch))', 15)} + {_EPS}) AS jump_size,
  CAST(coalesce(abs(ch) > {_now('avg(abs(ch))', 15)} + 2 * CASE WHEN {_now('count(ch)', 15)} = 15 THEN {_now('stddev_samp(ch)', 15)} END, FALSE) AS INT) AS is_jump FROM ch)"""


def _w15(s, d):
    return ft.add(ft.add(changed(s, d), ft.jump_features(SW)), ft.since_jump(SW))


family("w15_jumps", ["jump_size", "is_jump", "days_since_jump"], {"jump_size": "jump_size", "is_jump": "is_jump",
       "days_since_jump": f"least(i - 1 - coalesce(last_value(CASE WHEN is_jump = 1 THEN i - 1 END IGNORE NULLS) OVER {_P} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 120)"}, _w15, 4, "jmp", _JUMP)

_lim = {"max_change_15d": _now("max(ch)", 15), "min_change_15d": _now("min(ch)", 15), "change_range_15d": f"{_now('max(ch)', 15)} - {_now('min(ch)', 15)}"}
family("w16_change_limits", _lim, _lim, lambda s, d: _sel(changed(s, d), ft.change_limit_features(SW)), 0, "ch", _CH)

_RUN = f"""ze AS (SELECT series, ds, CAST(coalesce({_z['z_score_15']} > 1, FALSE) AS INT) AS f FROM idx), zt AS (SELECT *, coalesce(CAST(f <> lag(f) OVER {_P}) AS INT), 1) AS t FROM ze),
zg AS (SELECT *, sum(t) OVER {_P}) AS g FROM zt)"""
family("w17_consecutive_extremes", ["run_length:0"], {"run_length": "sum(f) OVER (PARTITION BY series, g ORDER BY ds)"},
       lambda s, d: ft.run_lengths(indexed(s, d).withColumn("f", F.expr(f"CAST(coalesce({ft.zscore_features(SW)['z_score_15']} > 1, false) AS INT)")), SW, "f", "run_length"), 0, "zg", _RUN)

_mom = {f"momentum_{p}": f"{_lag(1)} - {_lag(p + 1)}" for p in (7, 30, 60)}
_mom.update({f"roc_{p}": f"({_lag(1)} - {_lag(p + 1)}) / {_safe(_lag(p + 1))}" for p in (7, 14, 30, 60, 90)})
family("w18_momentum", [c if "momentum" in c else f"{c}:L6" for c in _mom], _mom, lambda s, d: _sel(indexed(s, d), ft.momentum_features(SW)))

_ac = {f"autocorr_{k}": f"""CASE WHEN {_back('count(y)', 60)} > {k} THEN CASE WHEN {_back('stddev_samp(y)', 60)} > 0 THEN
  CASE WHEN isfinite({f'corr(y, p{k}) OVER {_fr(60 - k)}'}) THEN {f'corr(y, p{k}) OVER {_fr(60 - k)}'} END ELSE 0 END END""" for k in (7, 14, 30)}
family("w19_rolling_autocorr", _ac, _ac, lambda s, d: ft.autocorr_features(indexed(s, d), SW), 4, "lagged",
       "lagged AS (SELECT *, " + ", ".join(f"{_lag(k)} AS p{k}" for k in (7, 14, 30)) + " FROM idx)")

_dist = {f"distance_from_mean_{n}": f"CASE WHEN {_back('count(y)', n)} = {n} THEN ({_lag(1)} - {_back('avg(y)', n)}) / ({_back('stddev_samp(y)', n)} + {_EPS}) END" for n in (7, 30, 60)}
family("w20_distance_from_mean", _dist, _dist, lambda s, d: _sel(indexed(s, d), ft.distance_features(SW)))

_ext = {f"ext_{c}_lag_{k}": _lag(k, c) for c in ("A", "N") for k in range(1, 16)}
_ext.update({f"ext_{c}_rolling_mean_5": f"CASE WHEN {_back(f'count({c})', 5)} = 5 THEN {_back(f'avg({c})', 5)} END" for c in ("A", "N")})


def market_joined(s, d):
    w = b.external(s, d).groupBy("ds").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in ("A", "N")])
    return b.series(s, d).join(w, "ds", "left")


_MKT = "mk AS (SELECT ds, max(value) FILTER (name='A') AS A, max(value) FILTER (name='N') AS N FROM external GROUP BY 1), joined AS (SELECT idx.* EXCLUDE (n), mk.A, mk.N FROM idx LEFT JOIN mk USING (ds))"
family("w21_cross_series_lags", _ext, _ext, lambda s, d: ft.cross_lags(market_joined(s, d), SW, ["A", "N"]), 6, "joined", b.EXTERNAL + ", " + _MKT)

_int = {"lag_1_x_day_of_week": f"{_lag(1)} * (isodow(ds) - 1)", "lag_5_x_day_of_week": f"{_lag(5)} * (isodow(ds) - 1)", "rolling_mean_5_x_month": f"{_full('avg(y)', 5)} * month(ds)",
        "rolling_mean_30_x_is_weekend": f"{_full('avg(y)', 30)} * CAST(isodow(ds) > 5 AS INT)"}


def _w22(s, d):
    from tidepanel.operators.calendar import calendar_features
    x = ft.add(indexed(s, d).withColumns(calendar_features(F.col("ds"))), {**ft.lag_features(SW), **ft.rolling_features(SW, (5, 30))})
    return _sel(x, ft.interactions())


family("w22_interactions", _int, _int, _w22)

# One series per customer: many short histories, which the gates treat differently.
_CUST = """WITH s AS (SELECT CAST(o_custkey AS VARCHAR) AS series, CAST(o_orderdate AS DATE) AS ds, sum(round_even(o_totalprice / 1000, 0)) AS y FROM orders GROUP BY 1, 2),
idx AS (SELECT *, count(*) OVER (PARTITION BY series) AS n FROM s)"""


def customer_series(s, d):
    return b.table(s, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("series"), F.to_date("o_orderdate").alias("ds")).agg(F.sum(F.rint(F.col("o_totalprice") / 1000)).alias("y"))


@query("w23_history_gates", "series:s ds:d lag_3:0 rolling_mean_5:4", f"{_CUST} SELECT series, ds, CASE WHEN n >= 9 THEN {_lag(3)} END AS lag_3, CASE WHEN n >= 15 THEN {_full('avg(y)', 5)} END AS rolling_mean_5 FROM idx")
def _(s, d):
    x = ft.with_index(customer_series(s, d), SW)
    cols = {**ft.lag_features(SW, (3,)), "rolling_mean_5": ft.rolling_features(SW, (5,))["rolling_mean_5"]}
    return _sel(x, ft.gated(cols, lambda n: int(n.rsplit("_", 1)[1])))


_fill = {c: f"coalesce(last_value({c} IGNORE NULLS) OVER {_P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({c} IGNORE NULLS) OVER {_P} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)" for c in ("A", "roc")}
family("w24_fill_features", ["A:2", "roc:4"], _fill, lambda s, d: ft.fill_features(market_joined(s, d).withColumn("roc", F.when(SW.lag(2) == 0, F.signum(SW.lag(1)) * float("inf")).otherwise(SW.lag(1) / F.nullif(SW.lag(2), F.lit(0.0)))), SW, ["A", "roc"]), 4, "jr",
       b.EXTERNAL + ", " + _MKT + f", jr AS (SELECT *, CASE WHEN {_lag(2)} <> 0 THEN {_lag(1)} / {_lag(2)} END AS roc FROM joined)")

_MF = """, raw AS (SELECT name AS series, ds, CASE WHEN day(ds) = 9 THEN 0 ELSE value END AS y FROM external), lv AS (SELECT series, ds, last_value(CASE WHEN y > 0 THEN y END IGNORE NULLS)
  OVER (PARTITION BY series ORDER BY ds) AS lvl FROM raw), c1 AS (SELECT *, (ln(lvl) - lag(ln(lvl)) OVER (PARTITION BY series ORDER BY ds)) * 100 AS chg1, (ln(lvl) - lag(ln(lvl), 5) OVER (PARTITION BY series ORDER BY ds)) * 100 AS chg5 FROM lv)"""


def _raw(s, d):
    return b.external(s, d).select(F.col("name").alias("series"), "ds", F.when(F.dayofmonth("ds") == 9, 0.0).otherwise(F.col("value")).alias("y"))


@query("w25_macro_features", "series:s ds:d lvl:3 chg1:4 chg5:4 vol20:4", f"WITH {b.EXTERNAL}{_MF} SELECT *, CASE WHEN {_now('count(chg1)', 20)} >= 10 THEN {_now('stddev_samp(chg1)', 20)} END AS vol20 FROM c1")
def _(s, d):
    return ft.macro_features(_raw(s, d), SW, "price")


@query("w25_macro_features_yield", "series:s ds:d lvl:3 chg1:3 chg5:3", f"WITH {b.EXTERNAL}{_MF} SELECT series, ds, lvl, (lvl - lag(lvl) OVER {_P})) * 100 AS chg1, (lvl - lag(lvl, 5) OVER {_P})) * 100 AS chg5 FROM lv")
def _(s, d):
    return ft.macro_features(_raw(s, d), SW, "yield")


@query("p16_clean_level", "series:s ds:d lvl:3", f"WITH {b.EXTERNAL}{_MF} SELECT series, ds, lvl FROM lv")
def _(s, d):
    return ft.macro_features(_raw(s, d), SW, "price").select("series", "ds", "lvl")


_rs = {"roll_mean": f"CASE WHEN {_now('count(y)', 90)} >= 30 THEN {_now('avg(y)', 90)} END", "roll_std": f"CASE WHEN {_now('count(y)', 90)} >= 30 THEN {_now('stddev_samp(y)', 90)} END"}
family("w27_rolling_statistics", _rs, _rs, lambda s, d: ft.rolling_statistics(b.series(s, d), SW, 90))


def _pool_summary(df, keys):
    p = ft.feature_pool(df, SW)
    names = ft.feature_names(p, SW)
    f = ft.fill_features(p, SW, names)
    return f.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.lit(len(names)).alias("columns"), F.expr(f"{len(names)} * count(1) - " + " - ".join(f"count({c})" for c in names)).alias("missing"))


@query("w_feature_pool", "series:s n:i columns:i missing:i", f"WITH {b.SERIES} SELECT series, count(*) AS n, 116 AS columns, 0 AS missing FROM series GROUP BY 1")
def _(s, d):
    """The 116-candidate pool of every series, filled: rows, columns and cells left empty."""
    return _pool_summary(b.series(s, d), ["series"])


@query("w_feature_pool_customers", "n:i series_count:i columns:i missing:i", f"{_CUST} SELECT count(*) AS n, count(DISTINCT series) AS series_count, 116 AS columns, 0 AS missing FROM idx")
def _(s, d):
    """The same pool over one series per customer: many short series."""
    return _pool_summary(customer_series(s, d), ["series"]).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("series_count"), F.max("columns").alias("columns"), F.sum("missing").alias("missing"))


# --- scalar transforms ------------------------------------------------------------------------------------

def signed_log(c):
    return F.signum(c) * F.log1p(F.abs(c))


def signed_log_inverse(c):
    return F.signum(c) * (F.exp(F.abs(c)) - 1)


@query("p7_signed_log", "series:s ds:d slog:6 back:4 shifted:6 unshifted:4", f"WITH {b.SERIES}, m AS (SELECT series, min(y) AS lo FROM series GROUP BY 1) SELECT series, ds, sign(y) * ln(1 + abs(y)) AS slog, y AS back, ln(y - lo + 1) AS shifted, y AS unshifted FROM series JOIN m USING (series)")
def _(s, d):
    from pyspark.sql import Window
    x = b.series(s, d).withColumn("lo", F.min("y").over(Window.partitionBy("series"))).withColumn("slog", signed_log(F.col("y"))).withColumn("shifted", F.log(F.col("y") - F.col("lo") + 1))
    return x.withColumn("back", signed_log_inverse(F.col("slog"))).withColumn("unshifted", F.exp("shifted") - 1 + F.col("lo"))


@query("p19_mid_quotes_and_changes", "ds:d mid:4 mid_ret:6 r_chg:4", f"""WITH {b.EXTERNAL}, w AS (SELECT ds, max(value) FILTER (name='A') AS a, max(value) FILTER (name='N') AS n, max(value) FILTER (name='R') AS r FROM external GROUP BY 1),
f AS (SELECT ds, {', '.join(f"coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY ds), first_value({c} IGNORE NULLS) OVER (ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}" for c in 'anr')} FROM w)
SELECT ds, (a + n) / 2 AS mid, coalesce(ln((a + n) / 2) - lag(ln((a + n) / 2)) OVER (ORDER BY ds), 0) AS mid_ret, coalesce(r - lag(r) OVER (ORDER BY ds), 0) AS r_chg FROM f""")
def _(s, d):
    x = b.external(s, d)
    dates = x.select("ds").distinct()
    filled = align.merge_external(dates, x, ["A", "N", "R"])
    wide = filled.groupBy("ds").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in "ANR"]).withColumn("market", F.lit("fx"))
    w = align.W_UP(["market"])                     # one market: one row per day
    mid = (F.col("A") + F.col("N")) / 2
    return wide.withColumn("mid", mid).select("ds", "mid", F.coalesce(F.ln("mid") - F.lag(F.ln("mid"), 1).over(w), F.lit(0.0)).alias("mid_ret"),
                                              F.coalesce(F.col("R") - F.lag("R", 1).over(w), F.lit(0.0)).alias("r_chg"))
