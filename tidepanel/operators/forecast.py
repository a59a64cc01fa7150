"""Benchmark forecasts, intervals and their way up the tree.  One row per series and day throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators import calendar as cal
from tidepanel.operators.features import SeriesWindow, add, ema_sql, ewm_sums

ALL = lambda: Window.partitionBy("series")
ORD = lambda: Window.partitionBy("series").orderBy("ds")


def positions(df: DataFrame) -> DataFrame:
    """Row index from 0 and length of each series."""
    return df.withColumns({"i": F.row_number().over(ORD()) - 1, "n": F.count(F.lit(1)).over(ALL())})


def series_ends(df: DataFrame, mean_window: int = 90, season: int = 5) -> DataFrame:
    """One row per series: what the benchmark forecasts need to know."""
    d = positions(df)
    age = F.col("n") - F.col("i")
    return d.groupBy("series").agg(
        F.max("ds").alias("last_ds"), F.count(F.lit(1)).alias("n"), F.max_by("y", "ds").alias("last"), F.min_by("y", "ds").alias("first"),
        F.avg(F.when(age <= mean_window, F.col("y"))).alias("mean"),
        F.transform(F.sort_array(F.collect_list(F.when(age <= season, F.struct("ds", "y")))), lambda x: x["y"]).alias("season"),
        F.count_if(F.col("y") != 0).alias("nonzero"))


def naive_forecasts(df: DataFrame, horizon: int, holidays: list[str], mean_window: int = 90, season: int = 5) -> DataFrame:
    """(series, h, ds, method, pred) for last value, drift, recent mean and seasonal naive."""
    e = cal.future_business_days(series_ends(df, mean_window, season), "last_ds", horizon, holidays)
    drift = F.coalesce(F.try_divide(F.col("last") - F.col("first"), F.col("n") - 1), F.lit(0.0))
    preds = {"Naive": F.col("last"), "NaiveDrift": F.col("last") + drift * F.col("h"), "NaiveMean": F.col("mean"),
             "SeasonalNaive": F.try_element_at("season", ((F.col("h") - 1) % F.size("season") + 1).cast("int"))}
    cells = F.array(*[F.struct(F.lit(m).alias("method"), p.cast("double").alias("pred")) for m, p in preds.items()])
    return e.select("series", "h", "ds", F.explode(cells).alias("x")).select("series", "h", "ds", "x.method", "x.pred")


def croston_levels(df: DataFrame, alpha: float = 0.1) -> DataFrame:
    """(series, ds, croston): SBA forecast known after each day.

    Size and gap smoothing are recursive averages over the non-zero days, so they are running weighted
    sums on that sub-series, carried forward to the other days."""
    d = positions(df)
    nz = d.filter("y <> 0")
    w = ORD()
    nz = nz.withColumns({"_k": F.row_number().over(w) - 1, "_gap": (F.col("i") - F.coalesce(F.lag("i", 1).over(w), F.lit(-1))).cast("double")})
    sw, span = SeriesWindow(), 2 / alpha - 1
    nz = nz.withColumns({"_y0": F.first("y").over(w), "_g0": F.first("_gap").over(w)})
    nz = ewm_sums(nz, sw, {"_sz": ("y", "_k", span), "_sp": ("_gap", "_k", span)})
    nz = add(nz, {"_z": ema_sql("_sz", "_k", "_y0", span), "_p": ema_sql("_sp", "_k", "_g0", span)})
    lv = nz.select("series", "ds", F.when(F.col("_k") >= 1, F.col("_z") / F.col("_p") * (1 - alpha / 2)).alias("_f"))
    j = d.join(lv, ["series", "ds"], "left")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    return j.select("series", "ds", F.coalesce(F.last("_f", ignorenulls=True).over(up), F.avg("y").over(up)).alias("croston"))


def seasonal_share(history: DataFrame, targets: DataFrame) -> DataFrame:
    """Month share x yearly mean x day-in-month share for every target (series, ds) row.

    Shares come from earlier years only (2-4, 1-3 and 2-6 years back); with no history for a part its
    plain fallback is used."""
    h = history.withColumns({"yy": F.year("ds"), "mm": F.month("ds"), "dd": F.dayofmonth("ds")})
    ym = h.groupBy("series", "yy", "mm").agg(F.sum("y").alias("v"))
    yt = ym.groupBy("series", "yy").agg(F.sum("v").alias("t"))
    t = targets.withColumns({"ty": F.year("ds"), "tm": F.month("ds"), "td": F.dayofmonth("ds")})
    key = t.select("series", "ty", "tm").distinct()
    back = lambda d, lo, hi: d.withColumn("yy", F.explode(F.sequence(F.col("ty") - hi, F.col("ty") - lo)))
    share = (back(key, 2, 4).join(yt.filter("t <> 0"), ["series", "yy"]).join(ym.withColumnRenamed("mm", "tm"), ["series", "yy", "tm"], "left")
             .groupBy("series", "ty", "tm").agg(F.avg(F.coalesce("v", F.lit(0.0)) / F.col("t")).alias("p")))
    yearly = back(key.select("series", "ty").distinct(), 1, 3).join(yt.filter("t <> 0"), ["series", "yy"]).groupBy("series", "ty").agg(F.avg("t").alias("a"))
    overall = h.groupBy("series").agg((F.sum("y") / F.countDistinct("yy")).alias("_all_year"), F.avg("y").alias("_all_mean"))
    day = (back(t.select("series", "ty", "tm", "td").distinct(), 2, 6).join(h.select("series", "yy", F.col("mm").alias("tm"), F.col("dd").alias("td"), "y"), ["series", "yy", "tm", "td"])
           .groupBy("series", "ty", "tm", "td").agg(F.avg("y").alias("dv")))
    month = (back(key, 2, 6).join(h.select("series", "yy", F.col("mm").alias("tm"), "dd", "y"), ["series", "yy", "tm"])
             .groupBy("series", "ty", "tm", "dd").agg(F.avg("y").alias("m")).groupBy("series", "ty", "tm").agg(F.sum("m").alias("mt")))
    mon_all = h.groupBy("series", F.col("mm").alias("tm")).agg(F.avg("y").alias("_mon_mean"), F.sum("y").alias("_mon_sum"))
    mon_avg = mon_all.groupBy("series").agg(F.avg("_mon_sum").alias("_mon_total"))
    j = (t.join(share, ["series", "ty", "tm"], "left").join(yearly, ["series", "ty"], "left").join(overall, "series", "left").join(day, ["series", "ty", "tm", "td"], "left")
         .join(month, ["series", "ty", "tm"], "left").join(mon_all.drop("_mon_sum"), ["series", "tm"], "left").join(mon_avg, "series", "left"))
    n1 = F.coalesce("p", F.lit(1 / 12)) * F.coalesce("a", "_all_year")
    n2 = F.coalesce(F.try_divide(F.coalesce("dv", "_mon_mean", "_all_mean"), F.coalesce("mt", "_mon_total")), F.lit(1 / 20))
    return j.select("series", "ds", (n1 * n2).alias("base"))


def calibrate_factor(df: DataFrame, window: int = 120, min_history: int = 500) -> DataFrame:
    """(series, factor, accepted): least-squares scale of the share baseline on the last ``window`` days."""
    d = positions(df)
    fit, hold = d.filter(F.col("i") < F.col("n") - window), d.filter((F.col("i") >= F.col("n") - window) & (F.col("n") >= window + min_history))
    b = seasonal_share(fit.select("series", "ds", "y"), hold.select("series", "ds")).join(hold.select("series", "ds", "y"), ["series", "ds"])
    g = b.groupBy("series").agg(F.count("base").alias("k"), F.sum(F.col("base") * F.col("y")).alias("_ba"), F.sum(F.col("base") * F.col("base")).alias("_bb"))
    f = F.when((F.col("k") >= 20) & (F.col("_bb") > 1e-9), F.try_divide("_ba", "_bb") - 1)
    return g.withColumn("factor", f).select("series", "factor", F.coalesce(F.col("factor").between(-2, 2).cast("int"), F.lit(0)).alias("accepted"))


def share_forecast(base: DataFrame, factors: DataFrame, default: float = 0.0) -> DataFrame:
    """Baseline x (1 + factor), with the default factor where none was accepted."""
    f = factors.filter("accepted = 1").select("series", "factor")
    return base.join(f, "series", "left").withColumn("pred", F.col("base") * (1 + F.coalesce("factor", F.lit(default)))).drop("factor")


def clip_to_polarity(value: Column, polarity: Column) -> Column:
    return F.when(polarity > 0, F.greatest(value, F.lit(0.0))).when(polarity < 0, F.least(value, F.lit(0.0))).otherwise(value)


def forecastable(df: DataFrame, min_obs: int = 10) -> DataFrame:
    """Series with enough observations that are not all zero."""
    ok = df.groupBy("series").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("y") != 0).alias("_z")).filter((F.col("_n") >= min_obs) & (F.col("_z") > 0)).select("series")
    return df.join(ok, "series", "left_semi")


def route_models(forecasts: DataFrame, model_map: DataFrame) -> DataFrame:
    """Each node's forecast by the model its map names."""
    return forecasts.join(model_map.withColumnRenamed("model", "method"), ["series", "method"])


def walk_forward_windows(df: DataFrame, horizon: int, n_windows: int, min_train: int = 300) -> DataFrame:
    """Train and test bounds of each window, counted back from the end of the series."""
    d = positions(df)
    per = d.groupBy("series").agg(F.count(F.lit(1)).alias("n")).withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(n_windows - 1))))
    per = per.withColumn("ts", F.col("n") - horizon - F.col("w") * horizon).withColumn("te", F.least(F.col("ts") + horizon, F.col("n")))
    day = lambda name, c: d.select("series", F.col("i").alias(c), F.col("ds").alias(name))
    per = per.withColumns({"_a": F.col("ts") - 1, "_b": F.col("ts"), "_c": F.col("te") - 1})
    out = per.join(day("train_end", "_a"), ["series", "_a"], "left").join(day("test_start", "_b"), ["series", "_b"], "left").join(day("test_end", "_c"), ["series", "_c"], "left")
    return out.select("series", "w", F.greatest("ts", F.lit(0)).alias("train_n"), F.greatest(F.col("te") - F.col("ts"), F.lit(0)).alias("test_n"), "train_end", "test_start", "test_end",
                      ((F.col("ts") >= min_train) & (F.col("te") - F.col("ts") >= 1)).cast("int").alias("enough"))


def split_train_test(df: DataFrame, test_share: float) -> DataFrame:
    d = positions(df)
    return d.withColumn("part", F.when(F.col("i") < F.floor(F.col("n") * (1 - test_share)), "train").otherwise("test")).drop("i", "n")


# --- intervals -----------------------------------------------------------------------------------------

def _last_ewma(start: Column, span: int) -> Column:
    """Exponential average of absolute changes from row ``start`` to the end of the series."""
    m = F.col("n") - 1 - start                                 # number of changes
    a = 2.0 / (F.least(F.lit(span), m) + 1)
    age = F.col("n") - 1 - F.col("i")
    x = F.abs(F.col("y") - F.col("_l"))
    return F.sum(F.when(F.col("i") == start + 1, F.pow(1 - a, age) * x).when(F.col("i") > start + 1, a * F.pow(1 - a, age) * x))


def calibrate_intervals(df: DataFrame, horizon: int, n_windows: int = 2, alpha: float = 0.05, vol_span: int = 60, min_train: int = 300) -> DataFrame:
    """(series, h, scale, q_lo, q_hi, vol_ratio) from rolling-origin errors of the last-value forecast.

    Scale per step is a median absolute error made monotone in the step; quantiles are empirical over all
    standardised errors (horizon x windows values per series); the ratio compares recent and backtest volatility."""
    d = positions(df).withColumn("_l", F.lag("y", 1).over(ORD()))
    w = F.floor((F.col("n") - 1 - F.col("i")) / horizon)
    start = F.col("n") - (F.col("_w") + 1) * horizon
    e = d.withColumn("_w", w).filter((F.col("_w") < n_windows) & (start >= min_train)).withColumn("h", F.col("i") - start + 1)
    origin = d.select("series", F.col("i").alias("_o"), F.col("y").alias("_base"))
    e = e.withColumn("_o", start - 1).join(origin, ["series", "_o"]).withColumn("err", F.col("y") - F.col("_base"))
    step = e.groupBy("series", "h").agg((1.4826 * F.percentile(F.abs("err"), F.lit(0.5))).alias("_raw"))
    pos = F.percentile(F.when(F.col("_raw") > 0, F.col("_raw")), F.lit(0.5)).over(ALL())
    step = step.withColumn("_r", F.when(F.col("_raw") > 0, F.col("_raw")).otherwise(F.greatest(F.coalesce(pos, F.lit(1e-6)), F.lit(1e-6))))
    step = step.withColumn("scale", F.max("_r").over(Window.partitionBy("series").orderBy("h"))).select("series", "h", "scale")
    z = e.join(step, ["series", "h"]).withColumn("z", F.col("err") / F.col("scale"))
    q = z.groupBy("series").agg(F.count("z").alias("n_errors"), F.percentile("z", F.lit(alpha / 2)).alias("_a"), F.percentile("z", F.lit(1 - alpha / 2)).alias("_b"), F.max("_w").alias("_wmax"))
    few = F.col("n_errors") < 20
    q = q.withColumns({"_a": F.when(few, -1.96).otherwise(F.col("_a")), "_b": F.when(few, 1.96).otherwise(F.col("_b"))})
    narrow = F.col("_b") - F.col("_a") < 0.5
    q = q.withColumns({"q_lo": F.when(narrow, F.least("_a", F.lit(-0.25))).otherwise(F.col("_a")), "q_hi": F.when(narrow, F.greatest("_b", F.lit(0.25))).otherwise(F.col("_b"))})
    v = d.join(q.select("series", "_wmax"), "series")
    s_now = F.greatest(F.col("n") - max(3 * vol_span, 120), F.lit(0))
    s_bt = F.greatest(F.col("n") - (F.col("_wmax") + 1) * horizon - 3 * vol_span, F.lit(0))
    v = v.groupBy("series").agg(_last_ewma(s_now, vol_span).alias("_now"), _last_ewma(s_bt, vol_span).alias("_bt"))
    ratio = F.when(F.col("_bt") > 1e-9, F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.col("_now") / F.col("_bt")))).otherwise(1.0)
    return step.join(q.select("series", "q_lo", "q_hi", "n_errors"), "series").join(v.select("series", ratio.alias("vol_ratio")), "series")


def fallback_intervals(df: DataFrame, horizon: int, alpha: float = 0.05) -> DataFrame:
    """Interval parameters from the spread of daily changes, widening with the root of the step."""
    d = df.withColumn("_d", F.col("y") - F.lag("y", 1).over(ORD()))
    d = d.withColumn("_sd", F.stddev_samp("_d").over(ALL())).withColumn("_sy", F.stddev_pop("y").over(ALL()))
    d = d.withColumn("_b", F.when(F.coalesce(F.col("_sd"), F.lit(0.0)) > 0, F.col("_sd")).otherwise(F.greatest("_sy", F.lit(1e-6))))
    z = F.col("_d") / F.col("_b")
    g = d.groupBy("series").agg(F.max("_b").alias("base"), F.count("_d").alias("_k"), F.percentile(z, F.lit(alpha / 2)).alias("_a"), F.percentile(z, F.lit(1 - alpha / 2)).alias("_z"))
    enough = F.col("_k") > 20
    g = g.select("series", "base", F.when(enough, F.col("_a")).otherwise(-1.96).alias("q_lo"), F.when(enough, F.col("_z")).otherwise(1.96).alias("q_hi"), F.lit(1.0).alias("vol_ratio"))
    return g.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("scale", F.col("base") * F.sqrt("h")).drop("base")


def apply_intervals(forecasts: DataFrame, calib: DataFrame) -> DataFrame:
    """Bounds of each forecast; steps past the calibrated horizon use its last scale."""
    c = calib.select("series", F.col("h").alias("_h"), (F.col("scale") * F.col("vol_ratio")).alias("_s"), "q_lo", "q_hi")
    top = c.groupBy("series").agg(F.max("_h").alias("_hm"))
    j = forecasts.join(top, "series").withColumn("_h", F.least("h", "_hm")).join(c, ["series", "_h"])
    return j.withColumns({"lower": F.col("pred") + F.col("q_lo") * F.col("_s"), "upper": F.col("pred") + F.col("q_hi") * F.col("_s")}).drop("_h", "_hm", "_s", "q_lo", "q_hi")


# Share of the historical deviation used as a constant band, by model class.
BAND_SHARE = {"NAIVE": 0.3, "APUVA": 0.5, "PROPHET": 0.3, "TREE": 0.1}


def constant_ci(forecasts: DataFrame, history: DataFrame, shares: dict[str, float], default: float = 0.3) -> DataFrame:
    """pred +- 1.96 x (share by model class) x deviation of the history."""
    sd = history.groupBy("series").agg(F.stddev_pop("y").alias("_sd"))
    share = F.lit(default)
    for m, v in shares.items():
        share = F.when(F.upper("method") == m.upper(), v).otherwise(share)
    return forecasts.join(sd, "series").withColumn("half", 1.96 * share * F.col("_sd")).withColumns(
        {"lower": F.col("pred") - F.col("half"), "upper": F.col("pred") + F.col("half")}).drop("_sd", "half")


def combine_halfwidths(sum_h: Column, sum_h2: Column, rho: Column) -> Column:
    r = F.greatest(F.lit(0.0), F.least(F.lit(1.0), rho))
    return F.sqrt(F.greatest(sum_h2 + r * (sum_h * sum_h - sum_h2), F.lit(0.0)))


def apply_adjustments(leaves: DataFrame, adjustments: DataFrame) -> DataFrame:
    """Leaf values plus the signed sum of all adjustments whose node and date range cover them."""
    sign = F.when(F.col("kind") == "+", F.col("amount")).otherwise(-F.col("amount"))
    a = adjustments.select(F.col("node").alias("_n"), "start_date", "end_date", sign.alias("_a"))
    hits = leaves.join(a, (F.col("node") == F.col("_n")) & F.col("ds").between(F.col("start_date"), F.col("end_date"))).groupBy("node", "ds").agg(F.sum("_a").alias("adjustment"))
    return leaves.join(hits, ["node", "ds"], "left").withColumn("adjustment", F.coalesce("adjustment", F.lit(0.0))).withColumn("adjusted", F.round(F.col("value") + F.col("adjustment"), 2))
