"""Rolling-origin results, metrics, comparisons and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions.normal import cdf_sql, two_sided_sql
from tidepanel.operators import diagnostics as dg
from tidepanel.operators import evaluation as ev
from tidepanel.operators import forecast as fc
from tidepanel.operators import inference as inf
from tidepanel.operators import selection as sel
from tidepanel.operators.features import SeriesWindow
from tidepanel.plans import base as b
from tidepanel.plans.q_diagnostics import _FIRST, _LATE, late_start
from tidepanel.plans.registry import query

SW = SeriesWindow()
MEANS = {("NaiveMean", "main", 42): 90, ("NaiveMean", "k5", 42): 5, ("NaiveMean", "k10", 42): 10, ("NaiveMean", "k30", 42): 30, ("Recent", "main", 1): 21, ("Recent", "main", 2): 22, ("Recent", "main", 42): 62,
         ("SeasonalNaive", "k5", 42): 6, ("SeasonalNaive", "k10", 42): 11, ("SeasonalNaive", "k30", 42): 31}
METHODS = ["Naive", "NaiveDrift", "NaiveMean", "SeasonalNaive"]


def _preds():
    lag, mean = SW.sql_lag, lambda w: SW.sql_back("avg(y)", w)
    p = {("Naive", "main", 42): lag(1), ("NaiveDrift", "main", 42): f"{lag(1)} + ({lag(1)} - first(y) {SW.sql_over()}) / nullif(i - 1, 0)", ("SeasonalNaive", "main", 42): lag(5)}
    p.update({k: mean(w) for k, w in MEANS.items()})
    # market arms: without, zero-filled and with the data
    p.update({("Market", "off", 42): mean(20), ("Market", "zero", 42): f"{mean(20)} / 2", ("Market", "supplied", 42): mean(25)})
    return p


def runs(s, d):
    x = b.series(s, d)
    return ev.rolling_results(x, _preds())


_P = "OVER (PARTITION BY series ORDER BY ds)"
_B = lambda w: f"avg(y) OVER (PARTITION BY series ORDER BY ds ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
_SQLP = {("Naive", "main", 42): f"lag(y) {_P}", ("NaiveDrift", "main", 42): f"lag(y) {_P} + (lag(y) {_P} - first(y) {_P}) / nullif(i - 2, 0)", ("SeasonalNaive", "main", 42): f"lag(y, 5) {_P}", **{k: _B(w) for k, w in MEANS.items()},
         ("Market", "off", 42): _B(20), ("Market", "zero", 42): f"{_B(20)} / 2", ("Market", "supplied", 42): _B(25)}
_CELLS = ", ".join(f"{{'method': '{m}', 'arm': '{a}', 'seed': {sd}, 'pred': p{j}}}" for j, (m, a, sd) in enumerate(_SQLP))
RUNS = f"""{b.INDEXED}, pr AS (SELECT *, abs(y - lag(y) {_P}) AS ad, {', '.join(f'{e} AS p{j}' for j, e in enumerate(_SQLP.values()))} FROM idx),
scl AS (SELECT series, avg(ad) AS scale FROM pr WHERE i <= n - 250 GROUP BY 1),
runs0 AS (SELECT pr.series, i - (n - 310) - 1 AS origin, ds, CASE WHEN i > n - 250 THEN 'test' ELSE 'val' END AS block, y AS actual, scale, unnest([{_CELLS}]) AS c FROM pr JOIN scl USING (series) WHERE i > n - 310),
runs AS (SELECT series, origin, ds, block, actual, scale, c.method AS method, c.arm AS arm, c.seed AS seed, c.pred AS pred, abs(actual - c.pred) AS ae, abs(actual - c.pred) / scale AS mase FROM runs0)"""
TEST = f"{RUNS}, main AS (SELECT * FROM runs WHERE block = 'test' AND arm = 'main' AND method IN (" + ", ".join(f"'{m}'" for m in METHODS) + "))"


def main(s, d):
    return runs(s, d).filter((F.col("block") == "test") & (F.col("arm") == "main") & F.col("method").isin(METHODS))


@query("m15_rolling_origins", "series:s origin:i ds:d block:s method:s arm:s seed:i pred:4 mase:5", f"WITH {RUNS} SELECT * FROM runs")
def _(s, d):
    return runs(s, d)


_METRIC = """met AS (SELECT series, method, count(*) AS n, avg(ae) AS mae, sqrt(avg(ae * ae)) AS rmse, 100 * avg(ae / abs(actual)) FILTER (actual <> 0) AS mape, 100 * avg(ae / ((abs(actual) + abs(pred)) / 2 + 1e-8)) AS smape,
 1 - sum(ae * ae) / (var_pop(actual) * count(*)) AS r2, 100 * avg(CASE WHEN da IS NOT NULL THEN CAST(da = dp AS INT) END) AS da, avg(mase) AS mase, avg(pred - actual) AS bias
 FROM (SELECT *, sign(actual - lag(actual) OVER w) AS da, sign(pred - lag(pred) OVER w) AS dp FROM main WINDOW w AS (PARTITION BY series, method ORDER BY ds)) GROUP BY 1, 2)"""
_MCOLS = "n:i mae:4 rmse:4 mape:3 smape:4 r2:5 da:4 mase:5 bias:4"


def metrics(s, d):
    return ev.accuracy_metrics(main(s, d))


@query("m17_accuracy_metrics", f"series:s method:s {_MCOLS}", f"WITH {TEST}, {_METRIC} SELECT * FROM met")
def _(s, d):
    return metrics(s, d)


@query("a20_metric_summary", "method:s mae:4 rmse:4 da:4 mase:5 series_count:i", f"WITH {TEST}, {_METRIC} SELECT method, avg(mae) AS mae, avg(rmse) AS rmse, avg(da) AS da, avg(mase) AS mase, count(*) AS series_count FROM met GROUP BY 1")
def _(s, d):
    return ev.metric_summary(metrics(s, d), ["mae", "rmse", "da", "mase"])


_MW = f"{RUNS}, wn AS (SELECT *, (309 - origin) // 60 AS w FROM runs WHERE arm = 'main' AND method IN ('Naive','NaiveMean','SeasonalNaive') AND origin >= 10), wm AS (SELECT series, method, w, avg(ae) AS mae, avg(mase) AS mase FROM wn GROUP BY 1, 2, 3)"


@query("a21_median_over_windows", "series:s method:s mae:4 mase:5 n_window:i", f"WITH {_MW} SELECT series, method, quantile_cont(mae, 0.5) AS mae, quantile_cont(mase, 0.5) AS mase, count(*) AS n_window FROM wm GROUP BY 1, 2")
def _(s, d):
    r = runs(s, d).filter("arm = 'main' and method in ('Naive','NaiveMean','SeasonalNaive') and origin >= 10")
    w = r.groupBy("series", "method", F.floor((309 - F.col("origin")) / 60).alias("w")).agg(F.avg("ae").alias("mae"), F.avg("mase").alias("mase"))
    return ev.median_over_windows(w, ["series", "method"], ["mae", "mase"])


@query("a22_rank_table", "method:s mean:5 median:5 max:5 n:i", f"WITH {TEST} SELECT method, avg(mase) AS mean, quantile_cont(mase, 0.5) AS median, max(mase) AS max, count(*) AS n FROM main GROUP BY 1")
def _(s, d):
    return ev.rank_table(main(s, d))


@query("a23_unit_average", "series:s origin:i mase:5 methods:i", f"WITH {RUNS}, sm AS (SELECT series, origin, method, avg(mase) AS m FROM runs WHERE arm = 'main' AND block = 'test' GROUP BY 1, 2, 3) SELECT series, origin, avg(m) AS mase, count(*) AS methods FROM sm GROUP BY 1, 2")
def _(s, d):
    return ev.unit_average(runs(s, d).filter("arm = 'main' and block = 'test'"))


@query("a24_per_quarter", "quarter:d method:s mase:5 winner:s", f"""WITH {TEST}, q AS (SELECT CAST(date_trunc('quarter', ds) AS DATE) AS quarter, method, avg(mase) AS mase FROM main GROUP BY 1, 2)
SELECT *, first(method) OVER (PARTITION BY quarter ORDER BY round(mase, 9), method) AS winner FROM q""")
def _(s, d):
    return ev.per_quarter(main(s, d))


@query("a27_seed_spread", "method:s seeds:i lowest:5 highest:5 range_pct:4", f"WITH {RUNS}, sm AS (SELECT method, seed, avg(mase) AS m FROM runs WHERE method = 'Recent' AND block = 'test' GROUP BY 1, 2) SELECT method, count(*) AS seeds, min(m) AS lowest, max(m) AS highest, 100 * (max(m) / min(m) - 1) AS range_pct FROM sm GROUP BY 1")
def _(s, d):
    return ev.seed_spread(runs(s, d).filter("method = 'Recent' and block = 'test'"))


_BEST = "bst AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY series ORDER BY round(mase, 9), method) = 1), bda AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY series ORDER BY round(da, 9) DESC, method) = 1)"


def _rounded(s, d):
    m = metrics(s, d)
    return m.withColumns({"mase": F.round("mase", 9), "da": F.round("da", 9)})


@query("k2_best_model_per_node", "rule:s series:s method:s mase:5 da:4", f"WITH {TEST}, {_METRIC}, {_BEST} SELECT 'mase' AS rule, series, method, mase, da FROM bst UNION ALL SELECT 'da', series, method, mase, da FROM bda")
def _(s, d):
    m = _rounded(s, d)
    return ev.best_model(m, "mase").withColumn("rule", F.lit("mase")).unionByName(ev.best_model(m, "da", largest=True).withColumn("rule", F.lit("da")))


@query("k2_winner_counts", "method:s wins:i share:4", f"WITH {TEST}, {_METRIC}, {_BEST} SELECT method, count(*) AS wins, 100.0 * count(*) / (SELECT count(*) FROM bst) AS share FROM bst GROUP BY 1")
def _(s, d):
    return ev.winner_counts(ev.best_model(_rounded(s, d), "mase"))


@query("k3_best_combination", "mae:4 rmse:4 mase:5 n:i", f"WITH {TEST}, {_METRIC}, {_BEST} SELECT avg(mae) AS mae, avg(rmse) AS rmse, avg(mase) AS mase, count(*) AS n FROM bst")
def _(s, d):
    return ev.best_model(_rounded(s, d), "mase").agg(F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"), F.avg("mase").alias("mase"), F.count(F.lit(1)).alias("n"))


_VAL = f"{RUNS}, vs AS (SELECT series, method || '/' || arm || '/' || seed AS method, avg(mase) AS score FROM runs WHERE block = 'val' GROUP BY 1, 2), k5 AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY round(score, 9), method) AS rank FROM vs QUALIFY row_number() OVER (PARTITION BY series ORDER BY round(score, 9), method) <= 5)"


def _named(s, d):
    return runs(s, d).withColumn("method", F.concat_ws("/", "method", "arm", F.col("seed").cast("string")))


@query("k4_five_best_on_validation", "series:s method:s score:5 rank:i", f"WITH {_VAL} SELECT * FROM k5")
def _(s, d):
    return ev.k_best(_named(s, d).filter("block = 'val'"), 5)


@query("r4_pivot_methods", "series:s origin:i " + " ".join(f"{m}:5" for m in METHODS), f"WITH {TEST} SELECT series, origin, " + ", ".join(f"max(mase) FILTER (method = '{m}') AS {m}" for m in METHODS) + " FROM main GROUP BY 1, 2")
def _(s, d):
    return ev.pivot_methods(main(s, d), METHODS)


@query("u5_complete_methods", "method:s units:i", f"WITH {TEST}, c AS (SELECT * FROM main WHERE NOT (method = 'Naive' AND origin % 50 = 3)) SELECT method, count(*) AS units FROM (SELECT DISTINCT method, series, origin FROM c) GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM (SELECT DISTINCT series, origin FROM c))")
def _(s, d):
    return ev.complete_methods(main(s, d).filter("not (method = 'Naive' and origin % 50 = 3)"))


_PAIR = "pair AS (SELECT series, origin, max(mase) FILTER (method = 'NaiveMean') AS a, max(mase) FILTER (method = 'SeasonalNaive') AS b FROM main GROUP BY 1, 2)"


def pairs(s, d, a="NaiveMean", bb="SeasonalNaive"):
    return ev.paired(main(s, d), "method", a, bb, ["series", "origin"])


@query("j14_paired_errors", "series:s origin:i a:5 b:5", f"WITH {TEST}, {_PAIR} SELECT * FROM pair")
def _(s, d):
    return pairs(s, d)


@query("d19_residual_stats", "method:s n:i mean:4 std:4 min:3 max:3 skewness:5 kurtosis:5", f"WITH {TEST} SELECT method, count(*) AS n, avg(actual - pred) AS mean, stddev_samp(actual - pred) AS std, min(actual - pred) AS min, max(actual - pred) AS max, skewness(actual - pred) AS skewness, kurtosis(actual - pred) AS kurtosis FROM main GROUP BY 1")
def _(s, d):
    e = F.col("actual") - F.col("pred")
    g = main(s, d).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.avg(e).alias("mean"), F.stddev_samp(e).alias("std"), F.min(e).alias("min"), F.max(e).alias("max"), F.skewness(e).alias("_g1"), F.kurtosis(e).alias("_g2"))
    n = F.col("n").cast("double")
    return g.withColumns({"skewness": F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2), "kurtosis": ((n + 1) * F.col("_g2") + 6) * (n - 1) / ((n - 2) * (n - 3))})


# --- combinations and comparisons ------------------------------------------------------------------------------

@query("m10_combine_forecasts", "how:s series:s origin:i pred:4 mase:5", f"""WITH {_VAL}, tst AS (SELECT *, method || '/' || arm || '/' || seed AS name FROM runs WHERE block = 'test'),
c AS (SELECT 'mean' AS how, series, origin, avg(pred) AS pred, max(actual) AS actual, max(scale) AS scale FROM tst WHERE arm = 'main' GROUP BY 2, 3
UNION ALL SELECT 'median', series, origin, quantile_cont(pred, 0.5), max(actual), max(scale) FROM tst WHERE arm = 'main' GROUP BY 2, 3
UNION ALL SELECT 'best5', t.series, origin, avg(pred), max(actual), max(scale) FROM tst t JOIN k5 ON k5.series = t.series AND k5.method = name GROUP BY 2, 3
UNION ALL SELECT 'pick1', t.series, origin, avg(pred), max(actual), max(scale) FROM tst t JOIN k5 ON k5.series = t.series AND k5.method = name AND rank = 1 GROUP BY 2, 3)
SELECT how, series, origin, pred, abs(actual - pred) / scale AS mase FROM c""")
def _(s, d):
    r = _named(s, d)
    best = ev.k_best(r.filter("block = 'val'"), 5).select("series", "method", "rank")
    t, m = r.filter("block = 'test'"), r.filter("block = 'test' and arm = 'main'")
    parts = {"mean": ev.combine_forecasts(m), "median": ev.combine_forecasts(m, "median"), "best5": ev.combine_forecasts(t.join(best, ["series", "method"])), "pick1": ev.combine_forecasts(t.join(best.filter("rank = 1"), ["series", "method"]))}
    out = None
    for k, p in parts.items():
        p = p.withColumn("how", F.lit(k))
        out = p if out is None else out.unionByName(p)
    return out


@query("m16_tune_on_validation", "series:s method:s arm:s score:5", f"""WITH {RUNS}, v AS (SELECT series, method, arm, avg(mase) AS score FROM runs WHERE block = 'val' AND method IN ('NaiveMean', 'SeasonalNaive') GROUP BY 1, 2, 3)
SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY series, method ORDER BY round(score, 9), arm) = 1""")
def _(s, d):
    v = runs(s, d).filter("block = 'val' and method in ('NaiveMean', 'SeasonalNaive')").groupBy("series", "method", "arm").agg(F.avg("mase").alias("score"))
    return v.groupBy("series", "method").agg(F.min_by(F.struct("arm", "score"), F.struct(F.round("score", 9), "arm")).alias("r")).select("series", "method", "r.*")


@query("m18_operational_metrics", "method:s rel_mae_geo:5 mae:4 bias:4 direction:4 n_direction:i mae_total:4", f"""WITH {TEST}, j AS (SELECT m.*, r.pred AS prev, r.ae AS rae FROM main m JOIN main r ON r.method = 'Naive' AND r.series = m.series AND r.origin = m.origin),
pe AS (SELECT method, series, avg(ae) / nullif(avg(rae), 0) AS rel FROM j GROUP BY 1, 2), g AS (SELECT method, exp(avg(ln(rel)) FILTER (rel > 0)) AS rel_mae_geo FROM pe GROUP BY 1),
a AS (SELECT method, avg(ae) AS mae, avg(actual - pred) AS bias, 100.0 * avg(CASE WHEN sign(actual - prev) <> 0 AND sign(pred - prev) <> 0 THEN CAST(sign(actual - prev) = sign(pred - prev) AS INT) END) AS direction,
 count(*) FILTER (sign(actual - prev) <> 0 AND sign(pred - prev) <> 0) AS n_direction FROM j GROUP BY 1),
t AS (SELECT method, avg(x) AS mae_total FROM (SELECT method, origin, abs(sum(actual) - sum(pred)) AS x FROM main GROUP BY 1, 2) GROUP BY 1)
SELECT * FROM g JOIN a USING (method) JOIN t USING (method)""")
def _(s, d):
    return ev.operational_metrics(main(s, d))


@query("m19_bottom_up_vs_top_down", "method:s mae_bottom_up:4 mae_top_down:4 n:i", f"""WITH {TEST}, tot AS (SELECT 'total' AS series, ds, sum(y) AS y FROM series GROUP BY ds), ti AS (SELECT ds, y, lag(y) OVER (ORDER BY ds) AS p1, avg(y) OVER (ORDER BY ds ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING) AS p90 FROM tot),
bu AS (SELECT method, ds, sum(actual) AS actual, sum(pred) AS pred FROM main WHERE method IN ('Naive', 'NaiveMean') GROUP BY 1, 2)
SELECT method, avg(abs(actual - pred)) AS mae_bottom_up, avg(abs(y - CASE WHEN method = 'Naive' THEN p1 ELSE p90 END)) AS mae_top_down, count(*) AS n FROM bu JOIN ti USING (ds) GROUP BY 1""")
def _(s, d):
    bu = main(s, d).filter("method in ('Naive', 'NaiveMean')").groupBy("method", "ds").agg(F.sum("actual").alias("actual"), F.sum("pred").alias("pred"))
    tot = b.series(s, d).groupBy("ds").agg(F.sum("y").alias("y")).withColumn("series", F.lit("total"))
    td = ev.rolling_results(tot, {("Naive", "main", 42): SW.sql_lag(1), ("NaiveMean", "main", 42): SW.sql_back("avg(y)", 90)}).filter("block = 'test'").select("method", "ds", F.col("ae").alias("td"))
    return bu.join(td, ["method", "ds"]).groupBy("method").agg(F.avg(F.abs(F.col("actual") - F.col("pred"))).alias("mae_bottom_up"), F.avg("td").alias("mae_top_down"), F.count(F.lit(1)).alias("n"))


_AB = "count(*) AS n, avg(a) AS mean_a, avg(b) AS mean_b, 100 * (avg(b) - avg(a)) / avg(a) AS delta_pct, count(*) FILTER (a < b) AS wins, count(*) FILTER (a > b) AS losses, count(*) FILTER (a = b) AS ties"
_ABC = "n:i mean_a:5 mean_b:5 delta_pct:4 wins:i losses:i ties:i"
_ARMS = f"{RUNS}, arms AS (SELECT series, origin, method, max(mase) FILTER (arm = 'main') AS a, max(mase) FILTER (arm = 'k30') AS b, max(mase) FILTER (arm = 'k10') AS b10, max(mase) FILTER (arm = 'k5') AS b5 FROM runs WHERE block = 'test' AND method IN ('NaiveMean','SeasonalNaive') GROUP BY 1, 2, 3)"


def arm_pairs(s, d, arm="k30"):
    return ev.paired(runs(s, d).filter("block = 'test' and method in ('NaiveMean','SeasonalNaive')"), "arm", "main", arm, ["series", "origin", "method"])


@query("m25_ablation_compare", f"grp:s {_ABC}", f"WITH {_ARMS} SELECT 'all' AS grp, {_AB} FROM arms UNION ALL SELECT series, {_AB} FROM arms GROUP BY series UNION ALL SELECT method, {_AB} FROM arms GROUP BY method")
def _(s, d):
    p = arm_pairs(s, d)
    return (ev.ablation(p).withColumn("grp", F.lit("all")).unionByName(ev.ablation(p, ["series"]).withColumnRenamed("series", "grp"))
            .unionByName(ev.ablation(p, ["method"]).withColumnRenamed("method", "grp")))


def _ab(c):
    return f"count(*) AS n, avg(a) AS mean_a, avg({c}) AS mean_b, 100 * (avg({c}) - avg(a)) / avg(a) AS delta_pct, count(*) FILTER (a < {c}) AS wins, count(*) FILTER (a > {c}) AS losses, count(*) FILTER (a = {c}) AS ties"


@query("m26_k_ablation", f"k:s {_ABC}", f"WITH {_ARMS}" + " UNION ALL ".join(f" SELECT '{k}' AS k, {_ab(c)} FROM arms" for k, c in (("k30", "b"), ("k10", "b10"), ("k5", "b5"))))
def _(s, d):
    out = None
    for k in ("k30", "k10", "k5"):
        x = ev.ablation(arm_pairs(s, d, k)).withColumn("k", F.lit(k))
        out = x if out is None else out.unionByName(x)
    return out


def _tests(s, d):
    """(name, series, origin, a, b): the recent mean against every other method, from one pivot."""
    wide = ev.pivot_methods(main(s, d), METHODS)
    return wide.selectExpr("series", "origin", "NaiveMean AS a", "stack(3, 'Naive', Naive, 'NaiveDrift', NaiveDrift, 'SeasonalNaive', SeasonalNaive) AS (name, b)").filter("a is not null and b is not null")


_WX = f"""{TEST}, tp AS (SELECT a.series, a.origin, b.method AS name, a.mase AS a, b.mase AS b, round(a.mase - b.mase, 12) AS dd FROM main a JOIN main b ON a.series = b.series AND a.origin = b.origin WHERE a.method = 'NaiveMean' AND b.method <> 'NaiveMean'),
rk AS (SELECT name, dd, abs(dd) AS ab, rank() OVER (PARTITION BY name ORDER BY abs(dd)) + (count(*) OVER (PARTITION BY name, abs(dd)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY name, abs(dd)) AS t FROM tp WHERE dd <> 0),
w0 AS (SELECT name, CAST(count(*) AS DOUBLE) AS m, sum(r) FILTER (dd > 0) AS rp, sum(t * t - 1) AS tc FROM rk GROUP BY 1),
w1 AS (SELECT name, m, least(rp, m * (m + 1) / 2 - rp) AS statistic, (rp - m * (m + 1) / 4) / sqrt((m * (m + 1) * (2 * m + 1) - tc / 2.0) / 24) AS z FROM w0),
cn AS (SELECT name, count(*) AS n, count(*) FILTER (dd < 0) AS wins, count(*) FILTER (dd = 0) AS ties, count(*) FILTER (dd > 0) AS losses FROM tp GROUP BY 1),
wx AS (SELECT *, {two_sided_sql('z')} AS p FROM w1 JOIN cn USING (name))"""


@query("m27_wilcoxon_signed_rank", "name:s n:i m:i wins:i ties:i losses:i statistic:1 z:5 p:6", f"WITH {_WX} SELECT * FROM wx")
def _(s, d):
    return inf.wilcoxon(_tests(s, d), ["name"])


_PS = f"""{TEST}, ps AS (SELECT a.series, b.method AS name, round(avg(b.mase - a.mase) / sqrt(var_pop(b.mase - a.mase) / count(*)), 6) AS t FROM main a JOIN main b ON a.series = b.series AND a.origin = b.origin WHERE a.method = 'NaiveMean' AND b.method <> 'NaiveMean' GROUP BY 1, 2),
pv AS (SELECT series, name, round({two_sided_sql('t')}, 12) AS p FROM ps), o AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY p, name) AS r, count(*) OVER (PARTITION BY series) AS m FROM pv)"""


@query("m28_holm_benjamini_hochberg", "series:s name:s p:6 p_holm:6 p_bh:6", f"""WITH {_PS} SELECT series, name, p, max(least(1, (m - r + 1) * p)) OVER (PARTITION BY series ORDER BY r) AS p_holm,
min(least(1, p * m / r)) OVER (PARTITION BY series ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p_bh FROM o""")
def _(s, d):
    t = _tests(s, d).groupBy("series", "name").agg(F.round(F.try_divide(F.avg(F.col("b") - F.col("a")), F.sqrt(F.var_pop(F.col("b") - F.col("a")) / F.count(F.lit(1)))), 6).alias("t"))
    return inf.adjust_p(t.withColumn("p", F.round(F.expr(two_sided_sql("t")), 12)), ["series"])


_DRAW = """dd AS (SELECT origin, sum(a) AS sa, sum(b) AS sb, row_number() OVER (ORDER BY origin) - 1 AS t, count(*) OVER () AS tt FROM pair GROUP BY 1),
blk AS (SELECT draw, k, CAST('0x' || substr(md5('0:' || draw || ':' || k), 1, 8) AS BIGINT) % tt AS st, tt FROM (SELECT unnest(range(2000)) AS draw), (SELECT any_value(tt) AS tt FROM dd), LATERAL (SELECT unnest(range(CAST(ceil(tt / 5) AS BIGINT))) AS k)),
dr AS (SELECT draw, (st + o) % tt AS t FROM blk, (SELECT unnest(range(5)) AS o) WHERE k * 5 + o < tt), bx AS (SELECT draw, 100 * (sum(sb) / sum(sa) - 1) AS x FROM dr JOIN dd USING (t) GROUP BY 1),
ci AS (SELECT (SELECT 100 * (sum(sb) / sum(sa) - 1) FROM dd) AS delta, quantile_cont(x, 0.025) AS lo95, quantile_cont(x, 0.975) AS hi95, quantile_cont(x, 0.05) AS lo90, quantile_cont(x, 0.95) AS hi90 FROM bx)"""


@query("m29_block_bootstrap_ci", "delta:5 lo95:5 hi95:5 lo90:5 hi90:5", f"WITH {TEST}, {_PAIR}, {_DRAW} SELECT * FROM ci")
def _(s, d):
    return inf.block_bootstrap(pairs(s, d))


@query("m30_equivalence_verdict", "comparison:s verdict:s", f"""WITH {TEST}, {_PAIR}, {_DRAW} SELECT 'SeasonalNaive vs NaiveMean' AS comparison, CASE WHEN lo90 > -2 AND hi90 < 2 THEN 'equivalent' WHEN lo95 > 0 OR hi95 < 0 THEN 'different' ELSE 'inconclusive' END AS verdict FROM ci""")
def _(s, d):
    c = inf.block_bootstrap(pairs(s, d))
    return c.select(F.lit("SeasonalNaive vs NaiveMean").alias("comparison"), inf.verdict(F.col("lo90"), F.col("hi90"), F.col("lo95"), F.col("hi95")).alias("verdict"))


@query("m31_hodges_lehmann", "series:s n:i estimate:6", f"WITH {TEST}, {_PAIR} SELECT x.series, (SELECT count(*) FROM pair p WHERE p.series = x.series) AS n, quantile_cont(((x.b - x.a) + (y.b - y.a)) / 2, 0.5) AS estimate FROM pair x JOIN pair y ON x.series = y.series AND x.origin <= y.origin GROUP BY 1")
def _(s, d):
    return inf.hodges_lehmann(pairs(s, d), ["series"])


@query("m32_diebold_mariano", "series:s n:i statistic:5 p:6", f"""WITH {TEST}, {_PAIR}, g AS (SELECT series, count(*) AS n, avg(b - a) / sqrt(var_pop(b - a) / count(*)) * sqrt((count(*) - 1.0) / count(*)) AS statistic FROM pair GROUP BY 1),
c AS (SELECT *, n - 1 AS nu, (n - 1) / (n - 1 + statistic * statistic) AS c2 FROM g),
w AS (SELECT *, list_sum([pow(c2, k) * CASE WHEN nu % 2 = 0 THEN exp(lgamma(k + 0.5) - lgamma(k + 1) - lgamma(0.5)) ELSE exp(lgamma(k + 1) + lgamma(1.5) - lgamma(k + 1.5)) END for k in range(0, nu // 2)]) AS sm FROM c)
SELECT series, n, statistic, 1 - CASE WHEN nu % 2 = 0 THEN sqrt(1 - c2) * sm ELSE 2 / pi() * (acos(sqrt(c2)) + sqrt((1 - c2) * c2) * coalesce(sm, 0)) END AS p FROM w""")
def _(s, d):
    return inf.diebold_mariano(pairs(s, d), ["series"])


def _mcs_sql(rounds: int, alpha: float = 0.10) -> str:
    q = f"""WITH {TEST}, dl AS (SELECT origin, method, avg(mase) AS loss FROM main GROUP BY 1, 2),
dp AS (SELECT origin, row_number() OVER (ORDER BY origin) - 1 AS t, count(*) OVER () AS tt FROM (SELECT DISTINCT origin FROM dl)),
blk AS (SELECT draw, k, CAST('0x' || substr(md5('0:' || draw || ':' || k), 1, 8) AS BIGINT) % tt AS st, tt FROM (SELECT unnest(range(2000)) AS draw), (SELECT any_value(tt) AS tt FROM dp), LATERAL (SELECT unnest(range(CAST(ceil(tt / 5) AS BIGINT))) AS k)),
dr AS (SELECT draw, (st + o) % tt AS t FROM blk, (SELECT unnest(range(5)) AS o) WHERE k * 5 + o < tt),
cell AS (SELECT draw, method, avg(loss) AS m FROM dr JOIN dp USING (t) JOIN dl USING (origin) GROUP BY 1, 2 UNION ALL SELECT -1, method, avg(loss) FROM dl GROUP BY 2),
a1 AS (SELECT DISTINCT method FROM cell), p0 AS (SELECT 0.0 AS p, '' AS worst, TRUE AS go)"""
    for i in range(1, rounds + 1):
        q += f""", d{i} AS (SELECT draw, method, m - avg(m) OVER (PARTITION BY draw) AS d FROM cell JOIN a{i} USING (method)),
s{i} AS (SELECT method, max(d) FILTER (draw = -1) AS base, stddev_samp(d) FILTER (draw >= 0) AS sd FROM d{i} GROUP BY 1), t{i} AS (SELECT max(base / sd) AS tmax, arg_max(method, base / sd) AS worst FROM s{i}),
b{i} AS (SELECT draw, max((d - base) / sd) AS tb FROM d{i} JOIN s{i} USING (method) WHERE draw >= 0 GROUP BY 1),
p{i} AS (SELECT greatest(avg(CAST(tb >= tmax AS INT)), any_value(o.p)) AS p, any_value(t{i}.worst) AS worst, any_value(o.go) AS run, any_value(o.go) AND greatest(avg(CAST(tb >= tmax AS INT)), any_value(o.p)) < {alpha} AS go FROM b{i}, t{i}, p{i - 1} o),
a{i + 1} AS (SELECT method FROM a{i} WHERE NOT (method = (SELECT worst FROM p{i}) AND (SELECT go FROM p{i})))"""
    out = " UNION ALL ".join(f"SELECT worst AS method, p FROM p{i} WHERE run" for i in range(1, rounds + 1))
    return q + f", gone AS ({out}) SELECT a1.method, coalesce(gone.p, 1.0) AS p, CAST(coalesce(gone.p, 1.0) >= {alpha} AS INT) AS kept FROM a1 LEFT JOIN gone USING (method)"


@query("m33_model_confidence_set", "method:s p:4 kept:i", _mcs_sql(len(METHODS) - 1))
def _(s, d):
    return inf.model_confidence_set(main(s, d))


_DIR = """di AS (SELECT m.series, m.method, m.actual > r.pred AS ya, m.pred > r.pred AS xa FROM main m JOIN main r ON r.method = 'Naive' AND r.series = m.series AND r.origin = m.origin WHERE m.method <> 'Naive' AND m.actual <> r.pred AND m.pred <> r.pred),
dj AS (SELECT method, CAST(count(*) AS DOUBLE) AS n, avg(CAST(ya = xa AS INT)) AS hit, avg(CAST(ya AS INT)) AS py, avg(CAST(xa AS INT)) AS px FROM di GROUP BY 1),
dk AS (SELECT *, py * px + (1 - py) * (1 - px) AS ps FROM dj), dl AS (SELECT *, ps * (1 - ps) / n - ((pow(2*py-1, 2) * px * (1-px) + pow(2*px-1, 2) * py * (1-py)) / n + 4*py*px*(1-py)*(1-px)/(n*n)) AS vv FROM dk),
dm AS (SELECT method, n, hit, CASE WHEN vv > 0 THEN (hit - ps) / sqrt(vv) END AS statistic FROM dl)"""


@query("m34_pesaran_timmermann", "method:s n:i hit:5 statistic:5 p:6", f"WITH {TEST}, {_DIR} SELECT *, CASE WHEN statistic IS NOT NULL THEN 1 - {cdf_sql('statistic')} END AS p FROM dm")
def _(s, d):
    m = main(s, d)
    ref = m.filter("method = 'Naive'").select("series", "origin", F.col("pred").alias("prev"))
    j = m.filter("method <> 'Naive'").join(ref, ["series", "origin"]).filter((F.col("actual") != F.col("prev")) & (F.col("pred") != F.col("prev")))
    return inf.pesaran_timmermann(j, ["method"], F.col("actual") > F.col("prev"), F.col("pred") > F.col("prev"))


@query("m35_rank_correlation", "n:i rho:6", f"""WITH {RUNS}, g AS (SELECT method || arm || seed AS m, round(avg(mase) FILTER (block = 'val'), 9) AS v, round(avg(mase) FILTER (block = 'test'), 9) AS t FROM runs GROUP BY 1),
r AS (SELECT rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS a, rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2.0 AS b FROM g) SELECT count(*) AS n, corr(a, b) AS rho FROM r""")
def _(s, d):
    g = _named(s, d).groupBy("method").agg(F.round(F.avg(F.when(F.col("block") == "val", F.col("mase"))), 9).alias("v"), F.round(F.avg(F.when(F.col("block") == "test", F.col("mase"))), 9).alias("t"))
    return inf.rank_correlation(g, "v", "t")


_BROKEN = "brk AS (SELECT series, origin, method, pred FROM main WHERE NOT (method = 'NaiveDrift' AND origin % 40 = 7) UNION ALL SELECT series, origin, method, CASE WHEN series = '5-LOW' THEN NULL ELSE pred END FROM main WHERE method = 'Naive' AND origin % 25 = 0)"


@query("m36_completeness_check", "method:s expected:i present:i missing:i duplicated:i nulls:i", f"""WITH {TEST}, {_BROKEN}, c AS (SELECT method, series, origin, count(*) AS k, count(*) FILTER (pred IS NULL) AS z FROM brk GROUP BY 1, 2, 3)
SELECT method, 1250 AS expected, count(*) AS present, 1250 - count(*) AS missing, count(*) FILTER (k > 1) AS duplicated, sum(z) AS nulls FROM c GROUP BY 1 UNION ALL SELECT 'Theta', 1250, 0, 1250, 0, 0""")
def _(s, d):
    m = main(s, d).select("series", "origin", "method", "pred")
    extra = m.filter("method = 'Naive' and origin % 25 = 0").withColumn("pred", F.when(F.col("series") != "5-LOW", F.col("pred")))
    return ev.completeness(m.filter("not (method = 'NaiveDrift' and origin % 40 = 7)").unionByName(extra), b.series(s, d), [*METHODS, "Theta"], 250)


@query("m37_rescaled_error", "series:s scale_all:5 scale_new:5 scale_since:5", f"""WITH {_LATE}, li AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ds) - 1 AS i, count(*) OVER (PARTITION BY series) AS n, abs(y - lag(y) OVER (PARTITION BY series ORDER BY ds)) AS ad, lag(ds) OVER (PARTITION BY series ORDER BY ds) AS pd FROM late),
lf AS (SELECT series, min(i) AS f FROM li WHERE y <> 0 GROUP BY 1)
SELECT li.series, avg(ad) AS scale_all, avg(ad) FILTER (i - 1 >= CASE WHEN f >= 250 THEN f ELSE 0 END) AS scale_new, avg(ad) FILTER (i - 1 >= CASE WHEN f >= 250 THEN f ELSE 0 END AND pd >= DATE '1999-01-01') AS scale_since FROM li JOIN lf USING (series) WHERE i < n - 250 GROUP BY 1""")
def _(s, d):
    x = late_start(s, d)
    since = ev.rescaled_denominator(x, 250, "1999-01-01").select("series", F.col("scale_new").alias("scale_since"))
    return ev.rescaled_denominator(x, 250).join(since, "series")


@query("m39_half_sample_stability", f"half:s {_ABC}", f"WITH {_ARMS} SELECT CASE WHEN origin < 185 THEN 'first' ELSE 'second' END AS half, {_AB} FROM arms GROUP BY 1")
def _(s, d):
    return ev.ablation(arm_pairs(s, d).withColumn("half", F.when(F.col("origin") < 185, "first").otherwise("second")), ["half"])


_REC = f"{RUNS}, r3 AS (SELECT o.series, o.origin, o.mase AS off, z.mase AS zero, p.mase AS supplied FROM (SELECT * FROM runs WHERE arm = 'off') o JOIN (SELECT * FROM runs WHERE arm = 'zero') z USING (series, origin) JOIN (SELECT * FROM runs WHERE arm = 'supplied') p USING (series, origin))"


def _recovery(s, d, by):
    r = runs(s, d)
    arm = lambda a: r.filter(F.col("arm") == a).select("series", "origin", "mase")
    return ev.three_arm_recovery(arm("off"), arm("zero"), arm("supplied"), ["series", "origin"], by)


@query("m40_three_arm_recovery", "series:s n:i off:5 zero:5 supplied:5 wins:i losses:i ties:i recovered_pct:3 win_pct:4", f"""WITH {_REC} SELECT series, count(*) AS n, avg(off) AS off, avg(zero) AS zero, avg(supplied) AS supplied, count(*) FILTER (supplied < off) AS wins, count(*) FILTER (supplied > off) AS losses, count(*) FILTER (supplied = off) AS ties,
100 * (1 - (avg(supplied) - avg(off)) / (avg(zero) - avg(off))) AS recovered_pct, 100.0 * count(*) FILTER (supplied < off) / count(*) FILTER (supplied <> off) AS win_pct FROM r3 GROUP BY 1""")
def _(s, d):
    return _recovery(s, d, ["series"])


@query("m41_covariate_vs_gain", "n:i rho:6", f"""WITH {_REC}, g AS (SELECT series, round(100 * (avg(supplied) / avg(off) - 1), 9) AS gain FROM r3 GROUP BY 1), z AS (SELECT series, round(avg(CAST(y = 0 AS INT)), 9) AS zs FROM series GROUP BY 1),
r AS (SELECT rank() OVER (ORDER BY gain) + (count(*) OVER (PARTITION BY gain) - 1) / 2.0 AS a, rank() OVER (ORDER BY zs) + (count(*) OVER (PARTITION BY zs) - 1) / 2.0 AS b FROM g JOIN z USING (series)) SELECT count(*) AS n, corr(a, b) AS rho FROM r""")
def _(s, d):
    g = _recovery(s, d, ["series"]).select("series", F.round(100 * (F.col("supplied") / F.col("off") - 1), 9).alias("gain"))
    z = dg.zero_share(b.series(s, d)).select("series", F.round(F.col("zeros") / F.col("n"), 9).alias("zs"))
    return inf.rank_correlation(g.join(z, "series"), "gain", "zs")


@query("m42_compare_runs", "method:s cells:i different:i mean_old:5 mean_new:5", f"""WITH {TEST}, nw AS (SELECT series, origin, method, CASE WHEN method = 'NaiveMean' AND origin % 9 = 0 THEN mase * (1 + 1e-6) WHEN method = 'Naive' THEN mase * (1 + 1e-12) ELSE mase END AS mase FROM main)
SELECT m.method, count(*) AS cells, count(*) FILTER (abs(m.mase - nw.mase) / greatest(abs(m.mase), 1e-300) > 1e-9) AS different, avg(m.mase) AS mean_old, avg(nw.mase) AS mean_new FROM main m JOIN nw USING (series, origin, method) GROUP BY 1""")
def _(s, d):
    m = main(s, d)
    new = m.withColumn("mase", F.when((F.col("method") == "NaiveMean") & (F.col("origin") % 9 == 0), F.col("mase") * (1 + 1e-6)).when(F.col("method") == "Naive", F.col("mase") * (1 + 1e-12)).otherwise(F.col("mase")))
    return ev.compare_runs(m, new, ["series", "origin", "method"])


@query("m43_beats_random_walk", "n_series:i beaten:i", f"WITH {TEST}, g AS (SELECT series, method, avg(mase) AS m FROM main GROUP BY 1, 2), h AS (SELECT series, min(m) AS best, max(m) FILTER (method = 'Naive') AS ref FROM g GROUP BY 1) SELECT count(*) AS n_series, count(*) FILTER (best < ref - 1e-12) AS beaten FROM h")
def _(s, d):
    return ev.beats_reference(main(s, d))
