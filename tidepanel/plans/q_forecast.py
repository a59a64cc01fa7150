"""Benchmark forecasts, intervals, tree roll-up and adjustments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import diagnostics as dg
from tidepanel.operators import etl, nodes
from tidepanel.operators import forecast as fc
from tidepanel.operators.selection import mean_pairwise_corr
from tidepanel.plans import base as b
from tidepanel.plans import q_etl as qe
from tidepanel.plans.q_calendar import HOLIDAYS
from tidepanel.plans.q_selection import leaf_series
from tidepanel.functions.literals import literal_table, values_sql
from tidepanel.plans.registry import query

H = 20
_HOL = "hol AS (SELECT CAST(unnest([" + ",".join(f"'{h}'" for h in HOLIDAYS) + "]) AS DATE) AS h)"


def _naive_sql(src):
    """ends and naive CTEs over a (series, ds, y) CTE."""
    return f"""ni AS (SELECT series, ds, y, row_number() OVER (PARTITION BY series ORDER BY ds) AS i, count(*) OVER (PARTITION BY series) AS n FROM {src}), {_HOL},
ends AS (SELECT series, max(ds) AS last_ds, max(n) AS n, max(y) FILTER (i = n) AS last, max(y) FILTER (i = 1) AS first, avg(y) FILTER (i > n - 90) AS mean, list(y ORDER BY ds) FILTER (i > n - 5) AS season FROM ni GROUP BY 1),
fd AS (SELECT series, CAST(unnest(generate_series(last_ds + INTERVAL 1 DAY, last_ds + INTERVAL 120 DAY, INTERVAL 1 DAY)) AS DATE) AS ds FROM ends),
fh AS (SELECT series, ds, row_number() OVER (PARTITION BY series ORDER BY ds) AS h FROM fd WHERE isodow(ds) < 6 AND ds NOT IN (SELECT h FROM hol)),
naive AS (SELECT series, h, ds, m.method, m.pred FROM (SELECT series, h, fh.ds, unnest([{{'method': 'Naive', 'pred': last}}, {{'method': 'NaiveDrift', 'pred': last + (last - first) / (n - 1) * h}},
  {{'method': 'NaiveMean', 'pred': mean}}, {{'method': 'SeasonalNaive', 'pred': season[(h - 1) % 5 + 1]}}]) AS m FROM fh JOIN ends USING (series) WHERE h <= {H}))"""


@query("m1_naive_forecasts", "series:s h:i ds:d method:s pred:4", f"WITH {b.SERIES}, {_naive_sql('series')} SELECT * FROM naive")
def _(s, d):
    return fc.naive_forecasts(b.series(s, d), H, HOLIDAYS)


@query("m2_croston_sba", "series:s ds:d croston:4", f"""WITH {b.INDEXED}, nz AS (SELECT series, i, y, i - coalesce(lag(i) OVER (PARTITION BY series ORDER BY i), 0) AS gap, row_number() OVER (PARTITION BY series ORDER BY i) AS k FROM idx WHERE y <> 0),
st AS (SELECT a.series, a.i, a.k, 0.1 * sum(pow(0.9, a.k - b.k) * b.y) + 0.9 * pow(0.9, a.k - 1) * max(b.y) FILTER (b.k = 1) AS z, 0.1 * sum(pow(0.9, a.k - b.k) * b.gap) + 0.9 * pow(0.9, a.k - 1) * max(b.gap) FILTER (b.k = 1) AS p
  FROM nz a JOIN nz b ON a.series = b.series AND b.k <= a.k GROUP BY a.series, a.i, a.k)
SELECT idx.series, ds, coalesce(last_value(CASE WHEN k > 1 THEN z / p * 0.95 END IGNORE NULLS) OVER (PARTITION BY idx.series ORDER BY ds), avg(y) OVER (PARTITION BY idx.series ORDER BY ds)) AS croston FROM idx LEFT JOIN st ON st.series = idx.series AND st.i = idx.i""")
def _(s, d):
    return fc.croston_levels(b.series(s, d))


def _share_sql(hist, tgt, p=""):
    """CTEs computing {p}base(series, ds, base) from a history and a target CTE."""
    return f"""{p}h AS (SELECT series, ds, y, year(ds) AS yy, month(ds) AS mm, day(ds) AS dd FROM {hist}),
{p}yt AS (SELECT series, yy, sum(y) AS t FROM {p}h GROUP BY 1, 2), {p}t AS (SELECT series, ds, year(ds) AS ty, month(ds) AS tm, day(ds) AS td FROM {tgt}),
{p}ym AS (SELECT series, yy, mm, sum(y) AS v FROM {p}h GROUP BY 1, 2, 3), {p}dy AS (SELECT series, yy, mm, dd, sum(y) AS v FROM {p}h GROUP BY 1, 2, 3, 4),
{p}a AS (SELECT t.series, t.ds, avg(coalesce(v, 0) / yt.t) AS p FROM {p}t t JOIN {p}yt yt ON yt.series = t.series AND yt.yy BETWEEN ty - 4 AND ty - 2 AND yt.t <> 0 LEFT JOIN {p}ym ym ON ym.series = t.series AND ym.yy = yt.yy AND ym.mm = tm GROUP BY 1, 2),
{p}b AS (SELECT t.series, t.ds, avg(yt.t) AS a FROM {p}t t JOIN {p}yt yt ON yt.series = t.series AND yt.yy BETWEEN ty - 3 AND ty - 1 AND yt.t <> 0 GROUP BY 1, 2),
{p}c AS (SELECT t.series, t.ds, avg(dy.v) AS dv FROM {p}t t JOIN {p}dy dy ON dy.series = t.series AND dy.yy BETWEEN ty - 6 AND ty - 2 AND dy.mm = tm AND dy.dd = td GROUP BY 1, 2),
{p}m0 AS (SELECT t.series, t.ds, dy.dd, avg(dy.v) AS m FROM {p}t t JOIN {p}dy dy ON dy.series = t.series AND dy.yy BETWEEN ty - 6 AND ty - 2 AND dy.mm = tm GROUP BY 1, 2, 3),
{p}m AS (SELECT series, ds, sum(m) AS mt FROM {p}m0 GROUP BY 1, 2), {p}o AS (SELECT series, sum(y) / count(DISTINCT yy) AS ay, avg(y) AS am FROM {p}h GROUP BY 1),
{p}mo AS (SELECT series, mm, avg(y) AS mmn, sum(y) AS ms FROM {p}h GROUP BY 1, 2), {p}ma AS (SELECT series, avg(ms) AS mtot FROM {p}mo GROUP BY 1),
{p}base AS (SELECT t.series, t.ds, coalesce(p, 1.0/12) * coalesce(a, ay) * CASE WHEN coalesce(mt, mtot) <> 0 THEN coalesce(dv, mmn, am) / coalesce(mt, mtot) ELSE 1.0/20 END AS base
 FROM {p}t t LEFT JOIN {p}a USING (series, ds) LEFT JOIN {p}b USING (series, ds) LEFT JOIN {p}c USING (series, ds) LEFT JOIN {p}m USING (series, ds) JOIN {p}o USING (series) LEFT JOIN {p}mo ON {p}mo.series = t.series AND mm = tm LEFT JOIN {p}ma ON {p}ma.series = t.series)"""


@query("m3_seasonal_share_baseline", "series:s ds:d base:3", f"WITH {b.SERIES}, {_naive_sql('series')}, tgt AS (SELECT series, ds FROM fh WHERE h <= {H}), {_share_sql('series', 'tgt')} SELECT * FROM base")
def _(s, d):
    x = b.series(s, d)
    t = fc.naive_forecasts(x, H, HOLIDAYS).filter("method = 'Naive'").select("series", "ds")
    return fc.seasonal_share(x, t)


@query("m4_calibrate_factor", "series:s factor:5 accepted:i", f"""WITH {b.INDEXED}, hist AS (SELECT series, ds, y FROM idx WHERE i <= n - 120), tgt AS (SELECT series, ds, y FROM idx WHERE i > n - 120 AND n >= 620), {_share_sql('hist', 'tgt')},
f AS (SELECT series, CASE WHEN count(base) >= 20 AND sum(base * base) > 1e-9 THEN sum(base * y) / sum(base * base) - 1 END AS factor FROM base JOIN tgt USING (series, ds) GROUP BY 1)
SELECT *, coalesce(CAST(factor BETWEEN -2 AND 2 AS INT), 0) AS accepted FROM f""")
def _(s, d):
    return fc.calibrate_factor(b.series(s, d))


@query("m3_seasonal_share_forecast", "series:s ds:d pred:3", f"""WITH {b.INDEXED}, hist AS (SELECT series, ds, y FROM idx WHERE i <= n - 120), tg0 AS (SELECT series, ds, y FROM idx WHERE i > n - 120 AND n >= 620), {_share_sql('hist', 'tg0', 'c_')},
f AS (SELECT series, CASE WHEN count(base) >= 20 AND sum(base * base) > 1e-9 THEN sum(base * y) / sum(base * base) - 1 END AS factor FROM c_base JOIN tg0 USING (series, ds) GROUP BY 1),
{_naive_sql('series')}, tgt AS (SELECT series, ds FROM fh WHERE h <= {H}), {_share_sql('series', 'tgt')}
SELECT base.series, ds, base * (1 + CASE WHEN factor BETWEEN -2 AND 2 THEN factor ELSE 0.25 END) AS pred FROM base LEFT JOIN f USING (series)""")
def _(s, d):
    x = b.series(s, d)
    t = fc.naive_forecasts(x, H, HOLIDAYS).filter("method = 'Naive'").select("series", "ds")
    return fc.share_forecast(fc.seasonal_share(x, t), fc.calibrate_factor(x), 0.25)


_LEAFCTE = f"{qe.PANEL_SIMPLE}, leaf AS (SELECT node AS series, ds, value AS y FROM panel WHERE node IN ({qe._LEAVES}))"
_POL = "pol AS (SELECT series, CASE WHEN count(*) FILTER (y <> 0) < 100 THEN 0 WHEN count(*) FILTER (y > 0) / count(*) FILTER (y <> 0) >= 0.995 THEN 1 WHEN count(*) FILTER (y > 0) / count(*) FILTER (y <> 0) <= 1 - 0.995 THEN -1 ELSE 0 END AS polarity FROM leaf GROUP BY 1)"


def _clip(e):
    return f"CASE WHEN polarity > 0 THEN greatest({e}, 0) WHEN polarity < 0 THEN least({e}, 0) ELSE {e} END"


@query("m11_clip_to_polarity", "series:s h:i polarity:i pred:3 lower:3 upper:3", f"""WITH {_LEAFCTE}, {_naive_sql('leaf')}, {_POL}, sd AS (SELECT series, stddev_pop(y) AS s FROM leaf GROUP BY 1)
SELECT series, h, polarity, {_clip('pred')} AS pred, {_clip('pred - 1.96 * 0.3 * s')} AS lower, {_clip('pred + 1.96 * 0.3 * s')} AS upper FROM naive JOIN pol USING (series) JOIN sd USING (series) WHERE method = 'NaiveDrift'""")
def _(s, d):
    x = leaf_series(s, d)
    f = fc.constant_ci(fc.naive_forecasts(x, H, HOLIDAYS).filter("method = 'NaiveDrift'"), x, {})
    j = f.join(dg.sign_polarity(x).select("series", "polarity"), "series")
    return j.withColumns({c: fc.clip_to_polarity(F.col(c), F.col("polarity")) for c in ("pred", "lower", "upper")})


_BRIDGE_SQL = f"bridge(leaf, node, one) AS ({values_sql(nodes.rollup_bridge(qe.TREE_SIMPLE))})"


def _leaf_forecast(s, d, method="NaiveMean"):
    f = fc.naive_forecasts(fc.forecastable(leaf_series(s, d)), H, HOLIDAYS).filter(F.col("method") == method)
    return f.select(F.col("series").alias("node"), "h", "ds", F.col("pred").alias("value"))


_LF = f"{_LEAFCTE}, live AS (SELECT * FROM leaf WHERE series IN (SELECT series FROM leaf GROUP BY 1 HAVING count(*) >= 10 AND count(*) FILTER (y <> 0) > 0)), {_naive_sql('live')}, lfc AS (SELECT series AS node, h, ds, pred AS value FROM naive WHERE method = 'NaiveMean'), {_BRIDGE_SQL}"


@query("m12_hierarchical_forecast", "node:s h:i ds:d value:3", f"WITH {_LF} SELECT bridge.node, h, ds, sum(value) AS value FROM lfc JOIN bridge ON lfc.node = leaf GROUP BY 1, 2, 3")
def _(s, d):
    return etl.rollup_tree(_leaf_forecast(s, d), nodes.rollup_bridge(qe.TREE_SIMPLE), ("h", "ds"))


_MODELS = [(n, ("Naive", "NaiveDrift", "NaiveMean", "SeasonalNaive")[i % 4]) for i, n in enumerate(nodes.leaf_nodes(qe.TREE_SIMPLE))]


def model_map(s):
    """The assignment arrives as one map column and is exploded to (series, model)."""
    return s.sql("SELECT explode(map(" + ", ".join(f"'{n}', '{m}'" for n, m in _MODELS) + ")) AS (series, model)")


@query("m13_route_models", "series:s method:s h:i pred:4", f"WITH {_LEAFCTE}, {_naive_sql('leaf')}, mm(series, method) AS ({values_sql(_MODELS)}) SELECT series, method, h, pred FROM naive JOIN mm USING (series, method)")
def _(s, d):
    return fc.route_models(fc.naive_forecasts(leaf_series(s, d), H, HOLIDAYS), model_map(s))


@query("r5_explode_model_map", "model:s nodes:i days:i", f"WITH {_LEAFCTE}, mm(series, model) AS ({values_sql(_MODELS)}) SELECT model, count(DISTINCT series) AS nodes, count(*) AS days FROM leaf JOIN mm USING (series) GROUP BY 1")
def _(s, d):
    per = leaf_series(s, d).groupBy("series").agg(F.count(F.lit(1)).alias("k"))
    return per.join(model_map(s), "series").groupBy("model").agg(F.count(F.lit(1)).alias("nodes"), F.sum("k").alias("days"))


@query("m14_walk_forward_windows", "series:s w:i train_n:i test_n:i train_end:d test_start:d test_end:d enough:i", f"""WITH {b.INDEXED}, w AS (SELECT DISTINCT series, n, w, n - 60 - w * 60 AS ts FROM idx CROSS JOIN (SELECT unnest([0,1,2,3]) AS w))
SELECT w.series, w, greatest(ts, 0) AS train_n, greatest(least(ts + 60, w.n) - ts, 0) AS test_n, a.ds AS train_end, b.ds AS test_start, c.ds AS test_end, CAST(ts >= 300 AS INT) AS enough FROM w
LEFT JOIN idx a ON a.series = w.series AND a.i = ts LEFT JOIN idx b ON b.series = w.series AND b.i = ts + 1 LEFT JOIN idx c ON c.series = w.series AND c.i = ts + 60""")
def _(s, d):
    return fc.walk_forward_windows(b.series(s, d), 60, 4)


@query("m38_split_train_test", "series:s part:s n:i first_ds:d", f"WITH {b.INDEXED} SELECT series, CASE WHEN i - 1 < floor(n * (1 - 0.2)) THEN 'train' ELSE 'test' END AS part, count(*) AS n, min(ds) AS first_ds FROM idx GROUP BY 1, 2")
def _(s, d):
    return fc.split_train_test(b.series(s, d), 0.2).groupBy("series", "part").agg(F.count(F.lit(1)).alias("n"), F.min("ds").alias("first_ds"))


# --- intervals -----------------------------------------------------------------------------------------------

def _ew_sql(start):
    m = f"(n - 1 - {start})"
    a = f"(2.0 / (least(60, {m}) + 1))"
    return f"sum(CASE WHEN i0 = {start} + 1 THEN pow(1 - {a}, n - 1 - i0) * ad WHEN i0 > {start} + 1 THEN {a} * pow(1 - {a}, n - 1 - i0) * ad END)"


_CAL = f"""{b.INDEXED}, x AS (SELECT *, i - 1 AS i0, abs(y - lag(y) OVER (PARTITION BY series ORDER BY ds)) AS ad, (n - i) // 60 AS w FROM idx),
e AS (SELECT x.series, x.w, x.i0 - (x.n - (x.w + 1) * 60) + 1 AS h, x.y - o.y AS err FROM x JOIN x o ON o.series = x.series AND o.i0 = x.n - (x.w + 1) * 60 - 1 WHERE x.w < 2 AND x.n - (x.w + 1) * 60 >= 300),
r0 AS (SELECT series, h, 1.4826 * quantile_cont(abs(err), 0.5) AS raw FROM e GROUP BY 1, 2), mp AS (SELECT series, quantile_cont(raw, 0.5) AS md FROM r0 WHERE raw > 0 GROUP BY 1),
sc AS (SELECT r0.series, h, max(CASE WHEN raw > 0 THEN raw ELSE greatest(coalesce(md, 1e-6), 1e-6) END) OVER (PARTITION BY r0.series ORDER BY h) AS scale FROM r0 LEFT JOIN mp USING (series)),
q0 AS (SELECT e.series, count(*) AS n_errors, quantile_cont(err / scale, 0.025) AS a, quantile_cont(err / scale, 0.975) AS b, max(w) AS wm FROM e JOIN sc USING (series, h) GROUP BY 1),
q AS (SELECT series, n_errors, wm, CASE WHEN b - a < 0.5 THEN least(a, -0.25) ELSE a END AS q_lo, CASE WHEN b - a < 0.5 THEN greatest(b, 0.25) ELSE b END AS q_hi FROM q0),
v AS (SELECT x.series, {_ew_sql('greatest(n - 180, 0)')} AS now_, {_ew_sql('greatest(n - (wm + 1) * 60 - 180, 0)')} AS bt FROM x JOIN q USING (series) GROUP BY 1),
cal AS (SELECT sc.series, h, scale, q_lo, q_hi, n_errors, CASE WHEN bt > 1e-9 THEN greatest(0.5, least(2.0, now_ / bt)) ELSE 1 END AS vol_ratio FROM sc JOIN q USING (series) JOIN v USING (series))"""


@query("m20_calibrate_intervals", "series:s h:i scale:4 q_lo:5 q_hi:5 n_errors:i vol_ratio:5", f"WITH {_CAL} SELECT * FROM cal")
def _(s, d):
    return fc.calibrate_intervals(b.series(s, d), 60)


_FB = f"""fb0 AS (SELECT series, y - lag(y) OVER (PARTITION BY series ORDER BY ds) AS dd, y FROM series), fb AS (SELECT series, stddev_samp(dd) AS base FROM fb0 GROUP BY 1),
fz AS (SELECT series, any_value(base) AS base, quantile_cont(dd / base, 0.025) AS q_lo, quantile_cont(dd / base, 0.975) AS q_hi FROM fb0 JOIN fb USING (series) WHERE dd IS NOT NULL GROUP BY 1)"""


@query("m21_fallback_intervals", "series:s h:i pred:4 lower:3 upper:3", f"""WITH {b.SERIES}, {_FB}, {_naive_sql('series')}
SELECT series, h, pred, pred + q_lo * base * sqrt(least(h, 12)) AS lower, pred + q_hi * base * sqrt(least(h, 12)) AS upper FROM naive JOIN fz USING (series) WHERE method = 'Naive'""")
def _(s, d):
    x = b.series(s, d)
    return fc.apply_intervals(fc.naive_forecasts(x, H, HOLIDAYS).filter("method = 'Naive'"), fc.fallback_intervals(x, 12))


@query("m22_constant_ci", "series:s method:s h:i lower:3 upper:3", f"""WITH {b.SERIES}, {_naive_sql('series')}, sd AS (SELECT series, stddev_pop(y) AS s FROM series GROUP BY 1)
SELECT series, method, h, pred - 1.96 * k * s AS lower, pred + 1.96 * k * s AS upper FROM (SELECT *, CASE method WHEN 'NaiveMean' THEN 0.5 WHEN 'NaiveDrift' THEN 0.1 ELSE 0.3 END AS k FROM naive) JOIN sd USING (series)""")
def _(s, d):
    x = b.series(s, d)
    return fc.constant_ci(fc.naive_forecasts(x, H, HOLIDAYS), x, {"NaiveMean": fc.BAND_SHARE["APUVA"], "NaiveDrift": fc.BAND_SHARE["TREE"]}, fc.BAND_SHARE["NAIVE"])


_RHO = """dfc AS (SELECT series, ds, y - lag(y) OVER (PARTITION BY series ORDER BY ds) AS v FROM leaf), rr AS (SELECT series, ds, rank() OVER (PARTITION BY series ORDER BY v) + (count(*) OVER (PARTITION BY series, v) - 1) / 2.0 AS r FROM dfc WHERE v IS NOT NULL),
cc AS (SELECT a.series, b.series AS o, corr(a.r, b.r) AS c FROM rr a JOIN rr b USING (ds) WHERE a.series <> b.series GROUP BY 1, 2), rho AS (SELECT round(greatest(0, least(1, avg(c))), 9) AS rho FROM cc)"""


@query("m23_combine_halfwidths", "node:s h:i value:3 lower:3 upper:3", f"""WITH {_LF}, {_RHO}, sd AS (SELECT series, round(1.96 * 0.3 * stddev_pop(y), 6) AS hw FROM leaf GROUP BY 1),
up AS (SELECT bridge.node, h, sum(value) AS value, sum(hw) AS sh, sum(hw * hw) AS sh2 FROM lfc JOIN bridge ON lfc.node = leaf JOIN sd ON sd.series = lfc.node GROUP BY 1, 2)
SELECT node, h, value, value - sqrt(sh2 + rho * (sh * sh - sh2)) AS lower, value + sqrt(sh2 + rho * (sh * sh - sh2)) AS upper FROM up CROSS JOIN rho""")
def _(s, d):
    x = leaf_series(s, d)
    sd = x.groupBy(F.col("series").alias("node")).agg(F.round(1.96 * 0.3 * F.stddev_pop("y"), 6).alias("hw"))
    leaf = _leaf_forecast(s, d).join(sd, "node")
    bridge = nodes.rollup_bridge(qe.TREE_SIMPLE)
    j = etl.rollup_tree(leaf.selectExpr("node", "h", "ds", "value", "hw AS sh", "hw * hw AS sh2"), bridge, ("h", "ds"), ("value", "sh", "sh2"))
    rho = mean_pairwise_corr(x, len(nodes.leaf_nodes(qe.TREE_SIMPLE))).select(F.round("rho", 9).alias("rho"))
    j = j.join(F.broadcast(rho)).withColumn("g", fc.combine_halfwidths(F.col("sh"), F.col("sh2"), F.col("rho")))
    return j.withColumns({"lower": F.col("value") - F.col("g"), "upper": F.col("value") + F.col("g")})


_ADJ = [("A.1.a", "+", 25.0, "1997-01-01", "1997-06-30"), ("A.1.a", "-", 10.0, "1997-06-01", "1997-12-31"), ("C.b", "+", 7.0, "1999-01-01", "2000-12-31"), ("B.d", "-", 3.0, "1996-01-01", "1996-01-31")]


@query("m24_apply_adjustments", "node:s ds:d adjusted:2 diff:2", f"""WITH {qe.PANEL_SIMPLE}, {_BRIDGE_SQL}, adj(node, kind, amount, s, e) AS ({values_sql(_ADJ)}),
hit AS (SELECT p.node, p.ds, sum(CASE WHEN kind = '+' THEN amount ELSE -amount END) AS a FROM panel p JOIN adj ON adj.node = p.node AND ds BETWEEN CAST(s AS DATE) AND CAST(e AS DATE) GROUP BY 1, 2),
lf AS (SELECT p.node, p.ds, value, coalesce(a, 0) AS a FROM panel p LEFT JOIN hit USING (node, ds) WHERE p.node IN ({qe._LEAVES}))
SELECT bridge.node, ds, sum(value + a) AS adjusted, sum(a) AS diff FROM lf JOIN bridge ON lf.node = leaf GROUP BY 1, 2""")
def _(s, d):
    a = literal_table(s, _ADJ, "node string, kind string, amount double, s string, e string").select("node", "kind", "amount", F.col("s").cast("date").alias("start_date"), F.col("e").cast("date").alias("end_date"))
    leaf = fc.apply_adjustments(qe.leaf_panel(s, d), a)
    bridge = nodes.rollup_bridge(qe.TREE_SIMPLE)
    return etl.rollup_tree(leaf, bridge, values=("value", "adjusted")).withColumn("diff", F.col("adjusted") - F.col("value"))
