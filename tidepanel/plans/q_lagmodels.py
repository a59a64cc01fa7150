"""Unit roots with lag search, ARMA grids, exponential smoothing, median regression and tree attributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import attribution as at
from tidepanel.operators import lagmodels as lm
from tidepanel.operators import learners as ml
from tidepanel.operators import quantile as qr
from tidepanel.operators import smoothing as sm
from tidepanel.operators import vector as vr
from tidepanel.plans import base as b
from tidepanel.plans import q_learners as ql
from tidepanel.plans.registry import query

_W = "OVER (PARTITION BY series ORDER BY ds)"

# Changes regressed on a constant, the centred level and none or one earlier change, on the sample of the largest order.
_ADF = f"""WITH {b.SERIES}, c AS (SELECT series, ds, y - lag(y) {_W} AS d, lag(y) {_W} - avg(y) OVER (PARTITION BY series) AS u, count(*) OVER (PARTITION BY series) AS n FROM series),
e AS (SELECT series, n, d, u, lag(d) {_W} AS d1, row_number() {_W} - 1 AS j FROM c WHERE d IS NOT NULL),
s AS (SELECT series, count(*) AS m, regr_sxx(d, u) AS uu, regr_sxy(d, u) AS ud, regr_syy(d, u) AS dd, regr_sxx(u, d1) AS vv, regr_sxy(u, d1) AS uv, regr_sxy(d, d1) AS vd
  FROM e WHERE j >= least(ceil(12 * pow(n / 100.0, 0.25)), n // 2 - 2) GROUP BY 1),
f AS (SELECT series, 0 AS lag, m, dd - ud * ud / uu AS sse, ud / uu AS beta, 1 / uu AS inv, 2 AS k FROM s
  UNION ALL SELECT series, 1, m, dd - (ud * (ud * vv - vd * uv) + vd * (vd * uu - ud * uv)) / (uu * vv - uv * uv), (ud * vv - vd * uv) / (uu * vv - uv * uv), vv / (uu * vv - uv * uv), 3 FROM s)
SELECT series, lag, m AS nobs, m * (ln(2 * pi() * sse / m) + 1) + 2 * k AS aic, beta / sqrt(sse / (m - k) * inv) AS statistic FROM f"""


@query("d8_autolag_orders", "series:s lag:i nobs:i aic:4 statistic:5", _ADF)
def _(s, d):
    """Unit-root regressions without and with one earlier change, out of all orders."""
    return lm.unit_root_orders(b.series(s, d)).where("lag <= 1 and not chosen")


@query("d8_autolag", "series:s lag:i nobs:i statistic:4 p_value:4 critical_1:4 critical_5:4 critical_10:4 stationary:i")
def _(s, d):
    """Unit-root test with the lag order of least AIC."""
    return lm.unit_root(b.series(s, d))


# --- ARMA orders: white noise and one own lag, after the 15 days that the long autoregression needs and three more -----

_ARMA = f"""WITH {b.SERIES}, z AS (SELECT series, ds, y FROM series QUALIFY row_number() OVER (PARTITION BY series ORDER BY ds DESC) <= 750),
l AS (SELECT series, ds, y, lag(y, 1) {_W} AS y1, lag(y, 2) {_W} AS y2 FROM z),
w AS (SELECT series, ds, 0 AS d, y AS w FROM l UNION ALL SELECT series, ds, 1, y - y1 FROM l WHERE y1 IS NOT NULL UNION ALL SELECT series, ds, 2, y - 2 * y1 + y2 FROM l WHERE y2 IS NOT NULL),
i AS (SELECT series, d, w, lag(w) OVER (PARTITION BY series, d ORDER BY ds) AS w1, row_number() OVER (PARTITION BY series, d ORDER BY ds) AS i FROM w),
s AS (SELECT series, d, count(*) AS m, sum(w * w) AS yy, sum(w * w1) AS xy, sum(w1 * w1) AS xx FROM i WHERE i > 18 GROUP BY 1, 2),
f AS (SELECT series, d, 0 AS p, m, yy AS sse, 0.0 AS phi FROM s WHERE d > 0 UNION ALL SELECT series, d, 1, m, yy - xy * xy / xx, xy / xx FROM s)
SELECT series, d, p, m AS nobs, m * (ln(2 * pi() * sse / m) + 1) + 2 * (p + 1) AS aic, phi FROM f"""


@query("m15_arma_low_orders", "series:s d:i p:i nobs:i aic:4 phi:5", _ARMA)
def _(s, d):
    """White noise and one own lag, for each number of differences, out of the whole grid."""
    return lm.arma_orders(b.series(s, d)).where("q = 0 and p <= 1").withColumn("phi", F.coalesce(F.try_element_at("phi", F.lit(1)), F.lit(0.0)))


@query("m15_arma_grid", "series:s d:i p:i q:i nobs:i aic:3 sigma2:3 by_unit_root:i chosen:i")
def _(s, d):
    """Three numbers of differences by sixteen orders per series, the choice marked."""
    return lm.arma_orders(b.series(s, d))


@query("m15_arma_forecast", "series:s d:i p:i q:i h:i pred:3")
def _(s, d):
    return lm.arma_forecast(b.series(s, d), 20)


@query("m12_vector_forecasts", "series:s h:i method:s pred:3")
def _(s, d):
    """All series from one vector autoregression, twenty days ahead, and their total."""
    f = vr.vector_forecasts(s, vr.fit_vector(b.series(s, d)), 20)
    return f.unionByName(f.groupBy("h", "method").agg(F.sum("pred").alias("pred")).withColumn("series", F.lit("total")))


# --- exponential smoothing: the recursion day by day, for every grid point ------------------------------------------------

def _smooth_sql(grid: str) -> str:
    """Summaries of whole series by recursion over days: map m, offset v, squared error x'qx + 2 r'x + c of the start x."""
    return f"""WITH RECURSIVE {b.SERIES}, y AS MATERIALIZED (SELECT series, y, row_number() {_W} AS i, count(*) OVER (PARTITION BY series) AS n FROM series),
g AS MATERIALIZED ({grid}),
rec AS (SELECT series, k, a, b, p, 0 AS i, 1e0 AS m1, 0e0 AS m2, 0e0 AS m3, 1e0 AS m4, 0e0 AS v1, 0e0 AS v2, 0e0 AS q1, 0e0 AS q2, 0e0 AS q3, 0e0 AS r1, 0e0 AS r2, 0e0 AS c FROM (SELECT DISTINCT series FROM y), g
 UNION ALL SELECT series, k, a, b, p, i + 1, h1 - a * h1, h2 - a * h2, p * m3 - a * b * h1, p * m4 - a * b * h2, x + a * e, p * v2 + a * b * e,
   q1 + h1 * h1, q2 + h1 * h2, q3 + h2 * h2, r1 - h1 * e, r2 - h2 * e, c + e * e
  FROM (SELECT *, y - x AS e FROM (SELECT rec.*, y.y, m1 + p * m3 AS h1, m2 + p * m4 AS h2, v1 + p * v2 AS x FROM rec JOIN y ON y.series = rec.series AND y.i = rec.i + 1))),
done AS (SELECT rec.*, y.n, q1 * q3 - q2 * q2 > 1e-9 * q1 * greatest(q3, 1e-300) AND p > 0 AS two FROM rec JOIN y ON y.series = rec.series AND y.i = rec.i AND y.i = y.n),
st AS (SELECT *, CASE WHEN two THEN -(q3 * r1 - q2 * r2) / (q1 * q3 - q2 * q2) ELSE -r1 / q1 END AS x1, CASE WHEN two THEN -(q1 * r2 - q2 * r1) / (q1 * q3 - q2 * q2) ELSE 0 END AS x2 FROM done),
fit AS (SELECT series, n, k, a AS alpha, b AS beta, p AS phi, m1 * x1 + m2 * x2 + v1 AS level, m3 * x1 + m4 * x2 + v2 AS trend, c + 2 * (r1 * x1 + r2 * x2) + q1 * x1 * x1 + 2 * q2 * x1 * x2 + q3 * x2 * x2 AS sse
  FROM st QUALIFY row_number() OVER (PARTITION BY series ORDER BY round(sse, 3), k) = 1)"""


_LIST = lambda v: f"[{', '.join(f'{x}e0' for x in v)}]"
_SIMPLE = f"SELECT k, {_LIST(sm.LEVELS)}[k] AS a, 0e0 AS b, 0e0 AS p FROM (SELECT unnest(range(1, {len(sm.LEVELS) + 1})) AS k)"
_DAMPED = f"""SELECT ((ka - 1) * {len(sm.TRENDS)} + kb - 1) * {len(sm.DAMPS)} + kp AS k, {_LIST(sm.LEVELS)}[ka] AS a, {_LIST(sm.TRENDS)}[kb] AS b, {_LIST(sm.DAMPS)}[kp] AS p
FROM (SELECT unnest(range(1, {len(sm.LEVELS) + 1})) AS ka), (SELECT unnest(range(1, {len(sm.TRENDS) + 1})) AS kb), (SELECT unnest(range(1, {len(sm.DAMPS) + 1})) AS kp)"""


@query("m1_damped_trend", "series:s n:i alpha:3 beta:3 phi:3 level:4 trend:4 sse:L7", f"{_smooth_sql(_DAMPED)} SELECT * FROM fit")
def _(s, d):
    """Damped-trend smoothing: parameters from the grid, the start of least squared error, and the last state."""
    return sm.fit(b.series(s, d), sm.damped_trend())


@query("m1_ets_forecasts", "series:s h:i method:s pred:4", f"{_smooth_sql(_DAMPED)} SELECT series, h, 'ETS' AS method, level + phi * (1 - pow(phi, h)) / (1 - phi) * trend AS pred FROM fit CROSS JOIN (SELECT unnest(range(1, 21)) AS h)")
def _(s, d):
    return sm.smoothing_forecasts(sm.fit(b.series(s, d), sm.damped_trend()), 20)


@query("m1_theta_forecasts", "series:s h:i method:s pred:4", f"""{_smooth_sql(_SIMPLE)}, line AS (SELECT series, regr_slope(y, i - 1) AS slope FROM y GROUP BY 1)
SELECT series, h, 'Theta' AS method, level + 0.5 * slope * (h - 1 + (1 - pow(1 - alpha, n)) / alpha) AS pred FROM fit JOIN line USING (series) CROSS JOIN (SELECT unnest(range(1, 21)) AS h)""")
def _(s, d):
    return sm.theta_forecasts(b.series(s, d), 20)


@query("m1_smoothed_levels", "series:s ds:d expected:4 level:4", f"""WITH RECURSIVE {b.SERIES}, y AS MATERIALIZED (SELECT series, ds, y, row_number() {_W} AS i FROM series),
rec AS (SELECT series, 0 AS i, 1e0 AS h, 0e0 AS v, 0e0 AS e FROM (SELECT DISTINCT series FROM y) UNION ALL
  SELECT rec.series, rec.i + 1, h * 0.7, v + 0.3 * (y.y - v), y.y - v FROM rec JOIN y ON y.series = rec.series AND y.i = rec.i + 1),
x AS (SELECT series, sum(e * h / 0.7) / sum(h / 0.7 * h / 0.7) AS x FROM rec WHERE i > 0 GROUP BY 1)
SELECT y.series, ds, y.y - e + x * h / 0.7 AS expected, v + x * h AS level FROM rec JOIN y USING (series, i) JOIN x ON x.series = y.series""")
def _(s, d):
    """Simple smoothing with weight 0.3: what every day was expected to be, and the level after it."""
    y = b.series(s, d)
    return sm.levels(y, sm.fit(y, sm.simple((0.3,))))


# --- median regression ------------------------------------------------------------------------------------------------

@query("m6_median_by_weekday", "rows:i loss:5", f"""WITH {b.SERIES}, g AS (SELECT dayofweek(ds) AS k, y, median(y) OVER (PARTITION BY dayofweek(ds)) AS m FROM series)
SELECT count(*) AS rows, avg(abs(y - m)) / 2 AS loss FROM g""")
def _(s, d):
    """Median regression on weekday indicators: its loss is that of the weekdays' medians."""
    y = b.series(s, d)
    names = [f"day_{k}" for k in range(2, 8)]
    fit = qr.fit_quantile(y.withColumns({n: (F.dayofweek("ds") == k).cast("double") for k, n in enumerate(names, 2)}), names)
    pred = y.withColumns({n: (F.dayofweek("ds") == k).cast("double") for k, n in enumerate(names, 2)})
    return pred.agg(F.count(F.lit(1)).alias("rows"), F.avg(qr.pinball(F.col("y"), fit.predict())).alias("loss"))


@query("m6_median_regression", "variant:s series:s n:i finite:i close:i", ql._tests_sql("variant", ("median",)))
def _(s, d):
    """Guarded median regression on the direct inputs: one-step test errors per series."""
    train, _v, test, cols = ql._parts(s, d)
    keep, ranges = ml.training_range(train.dropna(subset=["y", *cols]), [*cols, *ml.LEVEL])
    fit = qr.fit_quantile(train, keep)
    out = ml.clip_to_range(test, ranges).withColumn("pred", fit.predict()).select("series", "ds", "y", "pred").withColumn("variant", F.lit("median"))
    return ql._judged(out.join(test.select("series", "ds", "lag_1"), ["series", "ds"]), "variant")


# --- attributions -----------------------------------------------------------------------------------------------------

def _explained(s, d, kind: str):
    train, _v, test, cols = ql._parts(s, d)
    model = ml.fit_trees(train, cols, kind)
    known = at.explainer(model, [*cols, *ml.LEVEL])
    return at.attributions(test, known, ["series", "ds"]), known, ml.direct_predict(model, test)


@query("f10_attributions_add_up", "kind:s series:s n:i exact:i", f"""WITH {b.SERIES} SELECT v AS kind, series, least(count(*), 60) AS n, least(count(*), 60) AS exact
FROM series CROSS JOIN (SELECT unnest(['forest', 'boosted']) AS v) GROUP BY 1, 2""")
def _(s, d):
    """Contributions of all inputs and the base give the prediction, row by row."""
    out = None
    for kind in ("forest", "boosted"):
        parts, known, pred = _explained(s, d, kind)
        sums = parts.groupBy("series", "ds").agg(F.sum("contribution").alias("_c")).join(pred, ["series", "ds"])
        same = F.abs(F.col("pred") - F.col("_c") - F.lit(known.base)) <= 1e-8 * (1 + F.abs("pred"))
        x = sums.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("exact")).withColumn("kind", F.lit(kind))
        out = x if out is None else out.unionByName(x)
    return out


@query("f10_attribution_by_family", "series:s family:s features:i weight:4 share:4")
def _(s, d):
    """Mean absolute contributions on the test days by family of inputs, per series."""
    parts, _, _ = _explained(s, d, "forest")
    return at.family_attribution(parts, ["series"])
