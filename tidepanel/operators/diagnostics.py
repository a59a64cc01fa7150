"""Series diagnostics at daily grain: outliers, breaks, stationarity, distribution, data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.normal import cdf, cdf_sql, ppf, ppf_sql, safe_corr
from tidepanel.functions.ranks import sliced_counts

ALL = lambda: Window.partitionBy("series")
ORD = lambda: Window.partitionBy("series").orderBy("ds")


def outliers_iqr(df: DataFrame, k: float = 1.5) -> DataFrame:
    q = df.withColumn("_q1", F.percentile("y", F.lit(0.25)).over(ALL())).withColumn("_q3", F.percentile("y", F.lit(0.75)).over(ALL()))
    lo, hi = F.col("_q1") - k * (F.col("_q3") - F.col("_q1")), F.col("_q3") + k * (F.col("_q3") - F.col("_q1"))
    q = q.withColumn("lower", lo).withColumn("upper", hi)
    score = F.when(F.col("y") > F.col("upper"), F.col("y") - F.col("upper")).when(F.col("y") < F.col("lower"), F.col("y") - F.col("lower")).otherwise(0.0)
    return q.withColumn("score", score).withColumn("is_outlier", (score != 0).cast("int")).drop("_q1", "_q3")


def outliers_zscore(df: DataFrame, threshold: float = 3.0) -> DataFrame:
    z = F.try_divide(F.col("y") - F.avg("y").over(ALL()), F.stddev_pop("y").over(ALL()))
    return df.withColumn("score", F.coalesce(z, F.lit(0.0))).withColumn("is_outlier", (F.abs("score") > threshold).cast("int"))


def outliers_mad(df: DataFrame, threshold: float = 3.5) -> DataFrame:
    """Modified z-score; a zero MAD falls back to the mean absolute deviation."""
    d = df.withColumn("_m", F.percentile("y", F.lit(0.5)).over(ALL())).withColumn("_d", F.abs(F.col("y") - F.col("_m")))
    d = d.withColumn("_mad", F.percentile("_d", F.lit(0.5)).over(ALL())).withColumn("_alt", F.avg("_d").over(ALL()))
    dev = F.col("y") - F.col("_m")
    s = F.when(F.col("_mad") > 0, F.try_divide(0.6745 * dev, F.col("_mad"))).otherwise(F.coalesce(F.try_divide(dev, 1.253314 * F.col("_alt")), F.lit(0.0)))
    return d.withColumn("score", s).withColumn("is_outlier", (F.abs("score") > threshold).cast("int")).drop("_m", "_d", "_mad", "_alt")


def summarize_outliers(flagged: DataFrame) -> DataFrame:
    """Outliers with direction, ranked by absolute score within their series."""
    w = Window.partitionBy("series").orderBy(F.abs("score").desc(), "ds")
    return (flagged.filter("is_outlier = 1").withColumn("direction", F.when(F.col("score") > 0, "Tinggi").otherwise("Rendah"))
            .withColumn("rank", F.row_number().over(w)).select("series", "ds", "y", "score", "direction", "rank"))


def structural_breaks(df: DataFrame, max_breaks: int = 5, min_size: int = 60, min_gain: float = 0.01) -> DataFrame:
    """Rows labelled with their segment after binary segmentation by squared error.

    Each round splits at most one segment per series, for all series at once; everything is windows on
    (series, segment), so the single shuffle by series serves all rounds."""
    total = F.sum(F.col("y") * F.col("y")).over(ALL()) - F.pow(F.sum("y").over(ALL()), F.lit(2)) / F.count(F.lit(1)).over(ALL())
    d = df.withColumn("_i", F.row_number().over(ORD()) - 1).withColumn("_tot", total).withColumn("seg", F.lit(1)).withColumn("_open", F.lit(True))
    for _ in range(max_breaks):
        seg = Window.partitionBy("series", "seg")
        run = seg.orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
        d = d.withColumns({"_ls": F.coalesce(F.sum("y").over(run), F.lit(0.0)), "_p": F.count(F.lit(1)).over(run), "_m": F.count(F.lit(1)).over(seg), "_ss": F.sum("y").over(seg)})
        right = F.col("_m") - F.col("_p")
        # squared sums cancel out of the gain, so only plain prefix sums are needed
        gain = (F.try_divide(F.col("_ls") * F.col("_ls"), F.col("_p")) + F.try_divide(F.pow(F.col("_ss") - F.col("_ls"), F.lit(2)), right)
                - F.col("_ss") * F.col("_ss") / F.col("_m"))
        ok = (F.col("_p") >= min_size) & (right >= min_size)
        d = d.withColumn("_g", F.when(ok, gain))
        best = F.max(F.when(F.col("_g") > 0, F.struct(F.col("_g").alias("g"), (-F.col("_i")).alias("i"), F.col("seg").alias("s")))).over(ALL())
        d = d.withColumn("_b", best)
        take = F.coalesce(F.col("_open") & (F.col("_tot") > 0) & (F.col("_b.g") >= min_gain * F.col("_tot")), F.lit(False))
        d = d.withColumn("_open", take).withColumn("seg", F.when(take & (F.col("seg") == F.col("_b.s")) & (F.col("_i") >= -F.col("_b.i")), F.col("seg") * 2 + 1)
                                                  .when(take & (F.col("seg") == F.col("_b.s")), F.col("seg") * 2).otherwise(F.col("seg") * 1))
    return d.select("series", "ds", "y", F.col("_i").alias("i"), "seg")


def segment_stats(segments: DataFrame) -> DataFrame:
    return segments.groupBy("series", "seg").agg(F.min("i").alias("start_idx"), F.max("i").alias("end_idx"), F.min("ds").alias("start_ds"), F.count(F.lit(1)).alias("n"),
                                                 F.avg("y").alias("mean"), F.stddev_pop("y").alias("std")).drop("seg")


def cusum(df: DataFrame) -> DataFrame:
    d = df.withColumn("_e", F.col("y") - F.avg("y").over(ALL()))
    return d.withColumn("cusum", F.sum("_e").over(ORD())).drop("_e")


def kpss(df: DataFrame, critical: float = 0.463, max_cov: int = 21) -> DataFrame:
    """Level-stationarity statistic with the data-driven Bartlett bandwidth.

    The long-run variance comes from moving sums of length L+1 (prefix sum minus the prefix sum L+1 rows
    back), so the bandwidth may differ per series and needs no bound.  The bandwidth itself needs n^(2/9)
    autocovariances; a series so long that ``max_cov`` does not cover them is an error (n over 890,000 by default)."""
    d = df.withColumns({"_i": F.row_number().over(ORD()), "n": F.count(F.lit(1)).over(ALL()), "_e": F.col("y") - F.avg("y").over(ALL())})
    d = d.withColumn("_c", F.sum("_e").over(ORD()))
    lags = d.select("*", *[(F.col("_e") * F.lag("_e", k).over(ORD())).alias(f"_g{k}") for k in range(1, max_cov + 1)])
    cov_lags = F.floor(F.pow(F.col("n"), F.lit(2.0 / 9)))
    cov_lags = F.when(cov_lags <= max_cov, cov_lags).otherwise(F.raise_error(F.lit(f"kpss: a series needs more than max_cov = {max_cov} autocovariances")).cast("bigint"))
    prods = F.array(*[F.coalesce(F.sum(f"_g{k}"), F.lit(0.0)) for k in range(1, max_cov + 1)])
    s = lags.groupBy("series", "n").agg(F.sum(F.col("_e") * F.col("_e")).alias("_g0"), F.sum(F.col("_c") * F.col("_c")).alias("_eta"), prods.alias("_pr"))
    s = s.withColumn("_k", F.slice("_pr", F.lit(1), cov_lags.cast("int")))
    two = lambda e, f: F.aggregate(F.transform(e, f), F.lit(0.0), lambda a, x: a + x)
    s = s.withColumn("_s0", F.col("_g0") / F.col("n") + two(F.col("_k"), lambda x: x / (F.col("n") / 2.0)))
    s = s.withColumn("_s1", two(F.col("_k"), lambda x, i: (i + 1) * x / (F.col("n") / 2.0)))
    width = F.floor(1.1447 * F.pow(F.pow(F.try_divide(F.col("_s1"), F.col("_s0")), F.lit(2)), F.lit(1 / 3)) * F.pow(F.col("n"), F.lit(1 / 3)))
    s = s.withColumn("lags", F.least(F.coalesce(width, F.lit(0)), F.col("n") - 1)).select("series", "n", "_eta", "lags")
    now = d.select("series", "_i", "_c").join(s, "series")
    back = d.select("series", F.col("_i").alias("_bi"), F.col("_c").alias("_bc")).withColumnRenamed("series", "_bs")
    j = now.join(back, (F.col("series") == F.col("_bs")) & (F.col("_bi") == F.col("_i") - F.col("lags") - 1), "left")
    mov = F.pow(F.col("_c") - F.coalesce(F.col("_bc"), F.lit(0.0)), F.lit(2)) + F.when((F.col("_i") >= F.col("n") - F.col("lags")) & (F.col("_i") < F.col("n")), F.pow("_c", F.lit(2))).otherwise(0.0)
    out = j.groupBy("series", "n", "lags", "_eta").agg(F.sum(mov).alias("_lr"))
    var = F.col("_lr") / (F.col("n") * (F.col("lags") + 1))
    return out.withColumn("statistic", F.try_divide(F.col("_eta") / (F.col("n") * F.col("n")), var)).select("series", "n", "lags", "statistic", (F.col("statistic") < critical).cast("int").alias("stationary"))


def dickey_fuller(df: DataFrame, critical: float = -2.86) -> DataFrame:
    """t statistic of the lagged level in a regression of the change on a constant and the level."""
    d = df.withColumn("_x", F.lag("y", 1).over(ORD())).withColumn("_d", F.col("y") - F.col("_x"))
    g = d.filter("_x is not null").groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("_d", "_x").alias("slope"), F.regr_sxx("_d", "_x").alias("_sxx"),
                                                         F.regr_syy("_d", "_x").alias("_syy"), F.regr_sxy("_d", "_x").alias("_sxy"))
    s2 = (F.col("_syy") - F.col("slope") * F.col("_sxy")) / (F.col("n") - 2)
    return g.withColumn("statistic", F.try_divide(F.col("slope"), F.sqrt(F.try_divide(s2, F.col("_sxx"))))).select("series", "n", "slope", "statistic", (F.col("statistic") < critical).cast("int").alias("stationary"))


def acf(df: DataFrame, nlags: int = 40) -> DataFrame:
    """(series, n, k, acf, band, significant): one window pass, one grouped sum per lag."""
    d = df.withColumn("_e", F.col("y") - F.avg("y").over(ALL()))
    d = d.select("series", "_e", *[(F.col("_e") * F.lag("_e", k).over(ORD())).alias(f"_g{k}") for k in range(1, nlags + 1)])
    g = d.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_e") * F.col("_e")).alias("_g0"), *[F.sum(f"_g{k}").alias(f"_s{k}") for k in range(1, nlags + 1)])
    cells = F.array(F.struct(F.lit(0).alias("k"), F.col("_g0").alias("c")), *[F.struct(F.lit(k).alias("k"), F.coalesce(F.col(f"_s{k}"), F.lit(0.0)).alias("c")) for k in range(1, nlags + 1)])
    x = g.select("series", "n", "_g0", F.explode(cells).alias("x")).filter(F.col("x.k") <= F.least(F.lit(nlags), F.greatest(F.lit(1), F.floor(F.col("n") / 2) - 1)))
    band = 1.96 / F.sqrt("n")
    return x.select("series", "n", F.col("x.k").alias("k"), F.try_divide(F.col("x.c"), F.col("_g0")).alias("acf"), band.alias("band")).withColumn("significant", (F.abs("acf") > F.col("band")).cast("int"))


def pacf(df: DataFrame, nlags: int = 40) -> DataFrame:
    """Partial autocorrelations by the Durbin-Levinson recursion over the bias-adjusted ACF vector."""
    a = acf(df, nlags).withColumn("r", F.col("acf") * F.col("n") / (F.col("n") - F.col("k")))
    v = a.groupBy("series").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "r"))), lambda x: x["r"]).alias("r"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    none = F.array().cast("array<double>")

    def step(acc, k):
        phi = acc["phi"]
        fwd, rev = F.slice(F.col("r"), F.lit(2), k - 1), F.reverse(F.slice(F.col("r"), F.lit(2), k - 1))
        top = F.element_at("r", k + 1) - dot(phi, rev)
        last = F.try_divide(top, 1 - dot(phi, fwd))
        nxt = F.concat(F.zip_with(phi, F.reverse(phi), lambda p, q: p - last * q), F.array(last))
        return F.struct(nxt.alias("phi"), F.concat(acc["out"], F.array(last)).alias("out"))

    start = F.struct(none.alias("phi"), none.alias("out"))
    got = v.select("series", F.aggregate(F.sequence(F.lit(1), F.size("r") - 1), start, step)["out"].alias("p"))
    return got.select("series", F.posexplode("p").alias("k", "pacf")).withColumn("k", F.col("k") + 1)


def distribution_stats(df: DataFrame) -> DataFrame:
    g = df.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("std"), F.skewness("y").alias("_s"), F.kurtosis("y").alias("_k")).filter("n >= 8 and std > 0")
    shrink = (F.col("n") - 1) / F.col("n")
    g = g.withColumn("skewness", F.col("_s") * F.pow(shrink, F.lit(1.5))).withColumn("kurtosis_excess", (F.col("_k") + 3) * shrink * shrink - 3)
    jb = F.col("n") / 6.0 * (F.pow("skewness", F.lit(2)) + F.pow("kurtosis_excess", F.lit(2)) / 4)
    return g.withColumn("jb", jb).withColumn("jb_p", F.exp(-F.col("jb") / 2)).withColumn("normal", (F.col("jb_p") >= 0.05).cast("int")).drop("_s", "_k")


def qq_points(df: DataFrame) -> DataFrame:
    """Ordered sample against normal quantiles (Blom positions), with both distribution functions."""
    w = Window.partitionBy("series").orderBy("y", "ds")
    d = df.withColumns({"i": F.row_number().over(w), "n": F.count(F.lit(1)).over(ALL()), "_m": F.avg("y").over(ALL()), "_s": F.stddev_samp("y").over(ALL())})
    d = d.withColumn("p", (F.col("i") - 0.375) / (F.col("n") + 0.25)).withColumn("z", (F.col("y") - F.col("_m")) / F.col("_s"))
    return d.filter("_s > 0").select("series", "ds", "y", "i", "n", "z", ppf("p").alias("theoretical"), (F.col("i") / F.col("n")).alias("ecdf"), cdf("z").alias("normal_cdf"))


def qq_summary(points: DataFrame) -> DataFrame:
    """Quartile line, its fit and the Kolmogorov-Smirnov distance per series."""
    q = points.groupBy("series").agg(F.percentile("y", F.lit(0.25)).alias("_a"), F.percentile("y", F.lit(0.75)).alias("_b"))
    t = F.expr(ppf_sql("CAST(0.75 AS DOUBLE)"))
    q = q.withColumn("slope", (F.col("_b") - F.col("_a")) / (2 * t)).withColumn("intercept", F.col("_a") + F.col("slope") * t)
    j = points.join(q, "series")
    res = F.col("y") - (F.col("slope") * F.col("theoretical") + F.col("intercept"))
    return j.groupBy("series", "slope", "intercept").agg((1 - F.sum(res * res) / (F.var_pop("y") * F.count(F.lit(1)))).alias("r_squared"), F.max(F.abs(F.col("ecdf") - F.col("normal_cdf"))).alias("ks_distance"))


def k2_sql(n: str, g1: str, g2: str) -> dict[str, str]:
    """D'Agostino's skewness and kurtosis z-scores as SQL text over sample size and moments."""
    n = f"CAST({n} AS DOUBLE)"
    y = f"({g1} * sqrt((({n}+1)*({n}+3))/(6.0*({n}-2))))"
    b2 = f"(3.0*({n}*{n}+27*{n}-70)*({n}+1)*({n}+3)/(({n}-2.0)*({n}+5)*({n}+7)*({n}+9)))"
    w2 = f"(-1 + sqrt(2*({b2}-1)))"
    zs = f"(1/sqrt(0.5*ln({w2})) * ln({y}/sqrt(2.0/({w2}-1)) + sqrt(power({y}/sqrt(2.0/({w2}-1)),2)+1)))"
    e = f"(3.0*({n}-1)/({n}+1))"
    v = f"(24.0*{n}*({n}-2)*({n}-3)/(({n}+1)*({n}+1)*({n}+3)*({n}+5)))"
    x = f"(({g2}+3-{e})/sqrt({v}))"
    sb = f"(6.0*({n}*{n}-5*{n}+2)/(({n}+7)*({n}+9))*sqrt((6.0*({n}+3)*({n}+5))/({n}*({n}-2)*({n}-3))))"
    a = f"(6.0+8.0/{sb}*(2.0/{sb}+sqrt(1+4.0/({sb}*{sb}))))"
    d = f"(1+{x}*sqrt(2/({a}-4.0)))"
    zk = f"((1-2/(9.0*{a}) - sign({d})*power(abs((1-2.0/{a})/{d}), 1.0/3))/sqrt(2/(9.0*{a})))"
    return {"z_skew": zs, "z_kurt": zk}


def normality_tests(df: DataFrame) -> DataFrame:
    """D'Agostino K2 and Anderson-Darling per series."""
    g = df.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.skewness("y").alias("g1"), F.kurtosis("y").alias("g2"))
    z = k2_sql("n", "g1", "g2")
    k2 = g.withColumn("_zs", F.expr(z["z_skew"])).withColumn("_zk", F.expr(z["z_kurt"])).select("series", (F.col("_zs") * F.col("_zs") + F.col("_zk") * F.col("_zk")).alias("k2")).withColumn("k2_p", F.exp(-F.col("k2") / 2))
    pts = qq_points(df).withColumn("_up", F.expr(cdf_sql("(-z)")))
    term = (2 * F.col("i") - 1) * F.ln(F.greatest("normal_cdf", F.lit(1e-300))) + (2 * (F.col("n") + 1 - F.col("i")) - 1) * F.ln(F.greatest("_up", F.lit(1e-300)))
    ad = pts.groupBy("series", "n").agg((-F.col("n") - F.sum(term) / F.col("n")).alias("ad"))
    crit = F.round(0.787 / (1 + 4.0 / F.col("n") - 25.0 / (F.col("n") * F.col("n"))), 3)
    return ad.withColumn("ad_critical", crit).withColumn("ad_normal", (F.col("ad") < F.col("ad_critical")).cast("int")).join(k2, "series")


# Royston's polynomials (1995): the two outer weights by powers of 1 / sqrt(n), and mean and spread of the
# transformed statistic by powers of n (up to 11 values) or ln n (beyond).
SW_LAST, SW_NEXT = (0.221157, -0.147981, -2.071190, 4.434685, -2.706056), (0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SW_FEW = {"shift": (-2.273, 0.459), "mean": (0.5440, -0.39978, 0.025054, -0.0006714), "spread": (1.3822, -0.77857, 0.062767, -0.0020322)}
SW_MANY = {"mean": (-1.5861, -0.31082, -0.083751, 0.0038915), "spread": (-0.4803, -0.082676, 0.0030302)}


def _polynomial(x: str, values, first: int = 0) -> str:
    return "(" + " + ".join(f"CAST({v!r} AS DOUBLE) * power({x}, {i})" for i, v in enumerate(values, first)) + ")"


def shapiro_sql() -> dict[str, str]:
    """SQL text over the sums of a group: n, mm (squared normal scores), m1, m2 (largest and next score), xm (values times
    scores), xe1, xe2 (largest less smallest value, next ones), ss (squared deviations)."""
    u = "(1 / sqrt(n))"
    a1 = f"CASE WHEN n = 3 THEN sqrt(0.5) ELSE m1 / sqrt(mm) + {_polynomial(u, SW_LAST, 1)} END"
    a2 = f"CASE WHEN n > 5 THEN m2 / sqrt(mm) + {_polynomial(u, SW_NEXT, 1)} ELSE 0 END"
    w = ("least(1.0, power(a1 * xe1 + CASE WHEN n > 5 THEN a2 * xe2 + (xm - m1 * xe1 - m2 * xe2) / sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) "
         "WHEN n > 3 THEN (xm - m1 * xe1) / sqrt((mm - 2 * m1 * m1) / (1 - 2 * a1 * a1)) ELSE 0 END, 2) / ss)")
    few = f"((-ln({_polynomial('n', SW_FEW['shift'])} - ln(1 - w)) - {_polynomial('n', SW_FEW['mean'])}) / exp({_polynomial('n', SW_FEW['spread'])}))"
    many = f"((ln(1 - w) - {_polynomial('ln(n)', SW_MANY['mean'])}) / exp({_polynomial('ln(n)', SW_MANY['spread'])}))"
    z = f"CASE WHEN n <= 11 THEN {few} ELSE {many} END"
    return {"a1": a1, "a2": a2, "w": w, "z": z}


def shapiro_wilk(df: DataFrame, keys: tuple[str, ...] = ("series",), value: str = "y", run: int = 10_000, level: float = 0.05) -> DataFrame:
    """(keys, n, w, p_value, normal): Shapiro and Wilk's statistic with Royston's weights, over groups of any size.

    A group is never ordered in one task: ranks come from slices, equal values take the mean weight of their ranks, and
    long runs of one value are spread as pieces of ``run`` ranks.  The weighted sum is then a plain sum.  Null values
    are left out; groups of under 3 values or of one value have null results.  The p-value was fitted for up to 5,000
    values; for 3 it is exact.
    """
    k = list(keys)
    ranks = sliced_counts(df.withColumn("_v", F.col(value).cast("double")), k, "_v").withColumn("total", F.col("total").cast("bigint"))
    pieces = ranks.withColumn("_piece", F.explode(F.expr(f"sequence(0, (n - 1) div {run})")))
    lo = F.col("before") + 1 + F.col("_piece") * run
    pieces = pieces.select(*k, "_v", "total", lo.alias("lo"), F.least(F.col("before") + F.col("n"), lo + run - 1).alias("hi")).repartition(*k, "_v", "lo")
    each = pieces.withColumn("i", F.explode(F.expr("sequence(lo, hi)")))
    score = f"(-{ppf_sql('((total + 1 - i - 0.375D) / (total + 0.25D))')})"          # one formula on either side of the middle
    each = each.withColumn("_m", F.when(F.col("i") * 2 > F.col("total"), F.expr(ppf_sql("((i - 0.375D) / (total + 0.25D))"))).otherwise(F.expr(score)))
    at = lambda rank, col: F.sum(F.when(F.col("i") == rank, F.col(col)).otherwise(0.0))
    n = F.col("total")
    g = each.groupBy(*k, F.col("total").alias("n")).agg(
        F.sum(F.col("_m") * F.col("_m")).alias("mm"), F.sum(F.col("_m") * F.col("_v")).alias("xm"), at(n, "_m").alias("m1"), at(n - 1, "_m").alias("m2"),
        (at(n, "_v") - at(F.lit(1), "_v")).alias("xe1"), (at(n - 1, "_v") - at(F.lit(2), "_v")).alias("xe2"), (F.var_pop("_v") * F.count(F.lit(1))).alias("ss"))
    text = shapiro_sql()
    g = g.withColumn("n", F.col("n").cast("double")).withColumns({"a1": F.expr(text["a1"]), "a2": F.expr(text["a2"])})
    g = g.withColumn("w", F.when((F.col("n") >= 3) & (F.col("ss") > 0), F.expr(text["w"]))).withColumn("z", F.when(F.col("w") < 1, F.expr(text["z"])))
    exact = F.greatest(F.lit(0.0), 6 / F.lit(3.141592653589793) * (F.asin(F.sqrt("w")) - F.asin(F.sqrt(F.lit(0.75)))))
    p = F.when(F.col("w").isNull(), F.lit(None).cast("double")).when(F.col("n") == 3, exact).when(F.col("w") >= 1, 1.0).otherwise(F.expr(f"1 - {cdf_sql('z')}"))
    return g.withColumn("p_value", p).select(*k, F.col("n").cast("bigint").alias("n"), "w", "p_value", (F.col("p_value") >= level).cast("int").alias("normal"))


def zero_runs(df: DataFrame, min_run: int = 2) -> DataFrame:
    z = (F.col("y") == 0).cast("int")
    d = df.withColumn("_z", z).withColumn("_t", F.coalesce((F.col("_z") != F.lag("_z", 1).over(ORD())).cast("int"), F.lit(1))).withColumn("_g", F.sum("_t").over(ORD()))
    return d.filter("_z = 1").groupBy("series", "_g").agg(F.min("ds").alias("start_ds"), F.max("ds").alias("end_ds"), F.count(F.lit(1)).alias("days")).filter(F.col("days") >= min_run).drop("_g")


def date_gaps(df: DataFrame, business: bool = True) -> DataFrame:
    d = df.select("series", "ds").distinct().withColumn("from_ds", F.lag("ds", 1).over(ORD()))
    return d.withColumn("days", F.datediff("ds", "from_ds")).filter(F.col("days") > (4 if business else 1)).select("series", "from_ds", F.col("ds").alias("to_ds"), "days")


def zero_share(df: DataFrame, limit: float = 30.0) -> DataFrame:
    return df.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 0).alias("zeros"), (100.0 * F.count_if(F.col("y") == 0) / F.count(F.lit(1))).alias("zero_pct"),
                                    (100.0 * F.count_if(F.col("y") == 0) / F.count(F.lit(1)) > limit).cast("int").alias("flagged"))


def seasonal_decompose(df: DataFrame, period: int = 5) -> DataFrame:
    """Additive decomposition: centred mean, phase means, both ends of the trend from a line over one period."""
    h = period // 2
    d = df.withColumns({"i": F.row_number().over(ORD()) - 1, "n": F.count(F.lit(1)).over(ALL())})
    mid = ORD().rowsBetween(-h, h)
    if period % 2:
        ma = F.avg("y").over(mid)
    else:
        ma = (F.sum("y").over(mid) - (F.lag("y", h).over(ORD()) + F.lead("y", h).over(ORD())) / 2) / period
    d = d.withColumn("_t", F.when((F.col("i") >= h) & (F.col("i") < F.col("n") - h), ma))
    first, last = F.lit(h), F.col("n") - 1 - h
    head = (F.col("i") >= first) & (F.col("i") < F.least(first + period, last))
    tail = (F.col("i") >= F.greatest(first, last - period)) & (F.col("i") < last)
    line = lambda m: (F.regr_slope(F.when(m, F.col("_t")), F.col("i")).over(ALL()), F.regr_intercept(F.when(m, F.col("_t")), F.col("i")).over(ALL()))
    (k0, b0), (k1, b1) = line(head), line(tail)
    d = d.withColumn("trend", F.when(F.col("i") < first, k0 * F.col("i") + b0).when(F.col("i") > last, k1 * F.col("i") + b1).otherwise(F.col("_t")))
    d = d.withColumn("_phase", F.col("i") % period).withColumn("_d", F.col("y") - F.col("trend"))
    d = d.withColumn("_pm", F.avg("_d").over(Window.partitionBy("series", "_phase")))
    centre = F.sum(F.when(F.col("i") < period, F.col("_pm"))).over(ALL()) / period
    d = d.withColumn("seasonal", F.col("_pm") - centre)
    return d.select("series", "ds", "y", "trend", "seasonal", (F.col("_d") - F.col("seasonal")).alias("resid"))


def external_contract(df: DataFrame, row_col: str, date_col: str, features: list[str], panel_end: Column | None = None, max_lag: int = 30) -> DataFrame:
    """(rule, kind, count) for every broken rule of an uploaded sheet: errors block it, warnings do not."""
    names = df.columns
    spark = df.sparkSession
    if date_col not in names:
        return spark.range(1).select(F.lit("missing_date_column").alias("rule"), F.lit("error").alias("kind"), F.lit(1).cast("bigint").alias("count"))
    d = df.withColumn("_ds", F.col(date_col).try_cast("date"))
    prev = d.select((F.col(row_col) + 1).alias(row_col), F.col("_ds").alias("_prev"))
    d = d.join(prev, row_col, "left")
    has = [F.count(F.col(c).try_cast("double")) for c in features]
    m = d.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_ds").isNull()).alias("bad"), F.countDistinct("_ds").alias("nd"), F.count("_ds").alias("nv"), F.min("_ds").alias("lo"), F.max("_ds").alias("hi"),
              F.count_if(F.col("_ds") < F.col("_prev")).alias("down"), *([sum(((h == 0).cast("int") for h in has), F.lit(0)).alias("dead")] if features else [F.lit(0).alias("dead")]))
    holes = F.datediff("hi", "lo") + 1 - F.col("nd")
    lag = F.datediff(panel_end, F.col("hi")) if panel_end is not None else F.lit(0)
    rule = lambda n, k, c: F.struct(F.lit(n).alias("rule"), F.lit(k).alias("kind"), c.cast("bigint").alias("count"))
    rules = [rule("empty_file", "error", (F.col("n") == 0).cast("int")), rule("unparseable_dates", "error", F.col("bad")), rule("duplicate_dates", "error", F.col("nv") - F.col("nd")),
             rule("no_feature_columns", "error", F.lit(0 if features else 1)), rule("columns_without_numbers", "warning", F.col("dead")), rule("unsorted_dates", "warning", F.col("down")),
             rule("missing_calendar_days", "warning", holes), rule("ends_before_panel", "warning", F.when(lag > max_lag, lag).otherwise(0))]
    return m.select(F.explode(F.array(*rules)).alias("r")).select("r.*").filter("count > 0")


def sign_polarity(df: DataFrame, threshold: float = 0.995, min_nonzero: int = 100) -> DataFrame:
    """+1 / -1 for series locked to one side, 0 otherwise."""
    g = df.groupBy("series").agg(F.count_if(F.col("y") != 0).alias("nonzero"), F.count_if(F.col("y") > 0).alias("_pos"))
    share = F.try_divide(F.col("_pos"), F.col("nonzero"))
    pol = F.when(F.col("nonzero") < min_nonzero, 0).when(share >= threshold, 1).when(share <= 1 - threshold, -1).otherwise(0)
    return g.select("series", "nonzero", pol.alias("polarity"))


def from_first_report(df: DataFrame, min_zeros: int = 250) -> DataFrame:
    """Drop structural zeros before the first non-zero value when there are many of them."""
    d = df.withColumn("_i", F.row_number().over(ORD()) - 1).withColumn("_f", F.min(F.when(F.col("y") != 0, F.col("_i"))).over(Window.partitionBy("series").orderBy("ds").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return d.filter((F.coalesce(F.col("_f"), F.lit(0)) < min_zeros) | (F.col("_i") >= F.col("_f"))).drop("_i", "_f")


def series_descriptives(df: DataFrame) -> DataFrame:
    d = from_first_report(df).withColumn("_l", F.lag("y", 1).over(ORD()))
    return d.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("sd"), F.percentile("y", F.lit(0.5)).alias("median"),
                                   (100.0 * F.count_if(F.col("y") == 0) / F.count(F.lit(1))).alias("zero_pct"), F.skewness("y").alias("skew"), F.kurtosis("y").alias("kurt"), safe_corr(F.col("y"), F.col("_l")).alias("acf1"))


def zero_share_by_regime(df: DataFrame, last_n: int = 30) -> DataFrame:
    d = df.withColumns({"_i": F.row_number().over(ORD()) - 1, "_n": F.count(F.lit(1)).over(ALL())}).withColumn("_f", F.min(F.when(F.col("y") != 0, F.col("_i"))).over(ALL()))
    pct = lambda cond: 100.0 * F.avg(F.when(cond, (F.col("y") == 0).cast("int")))
    return d.groupBy("series").agg(F.min(F.when(F.col("_i") == F.col("_f"), F.col("ds"))).alias("first_ds"), pct(F.lit(True)).alias("zero_total"),
                                   pct(F.col("_i") >= F.col("_f")).alias("zero_since"), pct(F.col("_i") >= F.col("_n") - last_n).alias("zero_last"))
