"""Rolling-origin results and their summaries.  Result tables are long: series, origin, method, arm, seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.ranks import exact_quantiles
from tidepanel.operators.features import add
from tidepanel.operators.forecast import positions

ORD = lambda *k: Window.partitionBy(*k).orderBy("ds")


def rolling_results(df: DataFrame, preds: dict[tuple, str], n_test: int = 250, n_val: int = 60) -> DataFrame:
    """One-step forecasts of every origin in the validation and test blocks; methods are (name, arm, seed) -> SQL.

    A forecast made at origin t uses rows before t only, so each method is a window expression and all
    origins of all series come out of one pass; nothing is refitted per origin."""
    d = positions(df).withColumn("_d", F.abs(F.col("y") - F.lag("y", 1).over(ORD("series"))))
    d = add(d, {f"_p{j}": e for j, e in enumerate(preds.values())})
    scale = F.avg(F.when(F.col("i") < F.col("n") - n_test, F.col("_d"))).over(Window.partitionBy("series"))
    d = d.withColumn("scale", scale).filter(F.col("i") >= F.col("n") - n_test - n_val)
    cells = ", ".join(f"'{m}', '{a}', {s}, CAST(_p{j} AS DOUBLE)" for j, (m, a, s) in enumerate(preds))
    x = d.selectExpr("series", f"i - (n - {n_test + n_val}) AS origin", "ds", f"CASE WHEN i >= n - {n_test} THEN 'test' ELSE 'val' END AS block", "y AS actual", "scale",
                     f"stack({len(preds)}, {cells}) AS (method, arm, seed, pred)").filter("pred is not null")
    return x.withColumn("ae", F.abs(F.col("actual") - F.col("pred"))).withColumn("mase", F.try_divide("ae", "scale"))


def accuracy_metrics(runs: DataFrame, keys=("series", "method")) -> DataFrame:
    keys = list(keys)
    w = ORD(*keys)
    r = runs.withColumn("_da", F.signum(F.col("actual") - F.lag("actual", 1).over(w))).withColumn("_dp", F.signum(F.col("pred") - F.lag("pred", 1).over(w)))
    e, ab = F.col("pred") - F.col("actual"), F.abs(F.col("pred") - F.col("actual"))
    return r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(ab).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (100 * F.avg(F.when(F.col("actual") != 0, F.try_divide(ab, F.abs("actual"))))).alias("mape"),
        (100 * F.avg(ab / ((F.abs("actual") + F.abs("pred")) / 2 + 1e-8))).alias("smape"), (1 - F.try_divide(F.sum(e * e), F.var_pop("actual") * F.count(F.lit(1)))).alias("r2"),
        (100 * F.avg(F.when(F.col("_da").isNotNull(), (F.col("_da") == F.col("_dp")).cast("int")))).alias("da"), F.avg("mase").alias("mase"), F.avg(e).alias("bias"))


def metric_summary(metrics: DataFrame, columns: list[str]) -> DataFrame:
    return metrics.groupBy("method").agg(*[F.avg(c).alias(c) for c in columns], F.count(F.lit(1)).alias("series_count"))


def best_model(metrics: DataFrame, metric: str, key: str = "series", largest: bool = False) -> DataFrame:
    """The winning row of each series (ties to the first name); largest for direction accuracy."""
    m = F.col(metric) if not largest else -F.col(metric)
    ok = metrics.filter(F.col(metric).isNotNull())
    row = F.struct(*[c for c in metrics.columns if c != key])
    return ok.groupBy(key).agg(F.min_by(row, F.struct(m, "method")).alias("r")).select(key, "r.*")


def winner_counts(best: DataFrame) -> DataFrame:
    g = best.groupBy("method").agg(F.count(F.lit(1)).alias("wins"))
    return g.join(F.broadcast(best.agg(F.count(F.lit(1)).alias("_t")))).select("method", "wins", (100.0 * F.col("wins") / F.col("_t")).alias("share"))


def k_best(runs: DataFrame, k: int, metric: str = "mase") -> DataFrame:
    g = runs.groupBy("series", "method").agg(F.avg(metric).alias("score"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("series").orderBy(F.round("score", 9), "method"))).filter(F.col("rank") <= k)


def rank_table(runs: DataFrame, key: str = "method", metric: str = "mase") -> DataFrame:
    """Mean, median, maximum and count per method; the median is exact for any number of rows."""
    g = runs.groupBy(key).agg(F.avg(metric).alias("mean"), F.max(metric).alias("max"), F.count(metric).alias("n"))
    return g.join(exact_quantiles(runs, [key], metric, {"median": 0.5}), key).orderBy("mean")


def median_over_windows(results: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Median metric over the few walk-forward windows of a cell."""
    return results.groupBy(*keys).agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in columns], F.count(F.lit(1)).alias("n_window"))


def unit_average(runs: DataFrame, keys=("series", "origin")) -> DataFrame:
    """Average methods and seeds per unit: first over seeds, then over methods."""
    s = runs.groupBy(*keys, "method").agg(F.avg("mase").alias("m"))
    return s.groupBy(*keys).agg(F.avg("m").alias("mase"), F.count(F.lit(1)).alias("methods"))


def per_quarter(runs: DataFrame) -> DataFrame:
    g = runs.groupBy(F.trunc("ds", "quarter").alias("quarter"), "method").agg(F.avg("mase").alias("mase"))
    best = F.min(F.struct(F.round("mase", 9), "method")).over(Window.partitionBy("quarter"))
    return g.withColumn("winner", best["method"])


def seed_spread(runs: DataFrame) -> DataFrame:
    s = runs.groupBy("method", "seed").agg(F.avg("mase").alias("m"))
    return s.groupBy("method").agg(F.count(F.lit(1)).alias("seeds"), F.min("m").alias("lowest"), F.max("m").alias("highest"), (100 * (F.max("m") / F.min("m") - 1)).alias("range_pct"))


def pivot_methods(runs: DataFrame, methods: list[str], value: str = "mase") -> DataFrame:
    return runs.groupBy("series", "origin").agg(*[F.max(F.when(F.col("method") == m, F.col(value))).alias(m) for m in methods])


def complete_methods(runs: DataFrame) -> DataFrame:
    """Methods that have a result on every unit."""
    units = runs.select("series", "origin").distinct().agg(F.count(F.lit(1)).alias("_u"))
    g = runs.groupBy("method", "series", "origin").agg(F.max("mase").alias("_m")).groupBy("method").agg(F.count("_m").alias("units"))
    return g.join(F.broadcast(units)).filter(F.col("units") == F.col("_u")).drop("_u")


def paired(runs: DataFrame, side: str, a: str, b: str, keys: list[str], metric: str = "mase") -> DataFrame:
    """(keys, a, b) for units on which both sides of a comparison have a result."""
    pick = lambda v: F.max(F.when(F.col(side) == v, F.col(metric)))
    return runs.filter(F.col(side).isin(a, b)).groupBy(*keys).agg(pick(a).alias("a"), pick(b).alias("b")).filter("a is not null and b is not null")


def ablation(pairs: DataFrame, by: list[str] = ()) -> DataFrame:
    """Reference a against arm b: means, percent change, wins of the reference, ties."""
    g = pairs.groupBy(*by) if by else pairs.groupBy()
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), (100 * (F.avg("b") - F.avg("a")) / F.avg("a")).alias("delta_pct"),
                 F.count_if(F.col("a") < F.col("b")).alias("wins"), F.count_if(F.col("a") > F.col("b")).alias("losses"), F.count_if(F.col("a") == F.col("b")).alias("ties"))


def combine_forecasts(runs: DataFrame, how: str = "mean") -> DataFrame:
    """Equal-weight mean or median over the (few) methods of a unit."""
    agg = F.avg("pred") if how == "mean" else F.percentile("pred", F.lit(0.5))
    g = runs.groupBy("series", "origin").agg(agg.alias("pred"), F.max("actual").alias("actual"), F.max("scale").alias("scale"))
    return g.withColumn("mase", F.abs(F.col("actual") - F.col("pred")) / F.col("scale"))


def operational_metrics(runs: DataFrame, reference: str = "Naive") -> DataFrame:
    """Geometric relative MAE, bias, hit rate of the direction and MAE of the total flow."""
    ref = runs.filter(F.col("method") == reference).select("series", "origin", F.col("pred").alias("_prev"), F.col("ae").alias("_rae"))
    j = runs.join(ref, ["series", "origin"])
    sa, sp = F.signum(F.col("actual") - F.col("_prev")), F.signum(F.col("pred") - F.col("_prev"))
    ok = (sa != 0) & (sp != 0)
    per = j.groupBy("method", "series").agg(F.avg("ae").alias("_m"), F.avg("_rae").alias("_r"), F.sum("ae").alias("_sae"), F.sum(F.col("actual") - F.col("pred")).alias("_sb"), F.count(F.lit(1)).alias("_k"),
                                            F.count_if(ok).alias("_nd"), F.count_if(ok & (sa == sp)).alias("_hd"))
    rel = F.try_divide("_m", "_r")
    g = per.groupBy("method").agg(F.exp(F.avg(F.when(rel > 0, F.ln(rel)))).alias("rel_mae_geo"), (F.sum("_sae") / F.sum("_k")).alias("mae"), (F.sum("_sb") / F.sum("_k")).alias("bias"),
                                  F.try_divide(100.0 * F.sum("_hd"), F.sum("_nd")).alias("direction"), F.sum("_nd").alias("n_direction"))
    tot = runs.groupBy("method", "origin").agg(F.abs(F.sum("actual") - F.sum("pred")).alias("_t")).groupBy("method").agg(F.avg("_t").alias("mae_total"))
    return g.join(tot, "method")


def completeness(runs: DataFrame, series: DataFrame, methods: list[str], n_origins: int) -> DataFrame:
    """Expected cells against present ones per method: missing, duplicated and empty."""
    cell = runs.groupBy("method", "series", "origin").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("pred").isNull()).alias("z"))
    have = cell.groupBy("method").agg(F.count(F.lit(1)).alias("present"), F.count_if(F.col("k") > 1).alias("duplicated"), F.sum("z").alias("nulls"))
    want = series.select("series").distinct().agg((F.count(F.lit(1)) * n_origins).alias("expected")).select("expected", F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return want.join(have, "method", "left").select("method", "expected", z("present"), (F.col("expected") - F.coalesce("present", F.lit(0))).alias("missing"), z("duplicated"), z("nulls"))


def rescaled_denominator(df: DataFrame, n_test: int, since: str | None = None, min_zeros: int = 250) -> DataFrame:
    """(series, scale_all, scale_new): error denominator on all training rows and on rows from the first report (and since a day)."""
    d = positions(df).withColumn("_f", F.min(F.when(F.col("y") != 0, F.col("i"))).over(Window.partitionBy("series")))
    d = d.filter(F.col("i") < F.col("n") - n_test).withColumn("_p", F.lag("i", 1).over(ORD("series"))).withColumn("_d", F.abs(F.col("y") - F.lag("y", 1).over(ORD("series"))))
    first = F.when(F.col("_f") >= min_zeros, F.col("_f")).otherwise(F.lit(0))
    ok = F.col("_p") >= first
    if since:
        ok = ok & (F.lag("ds", 1).over(ORD("series")) >= F.lit(since).cast("date"))
    d = d.withColumn("_ok", ok)
    return d.groupBy("series").agg(F.avg("_d").alias("scale_all"), F.avg(F.when(F.col("_ok"), F.col("_d"))).alias("scale_new"))


def three_arm_recovery(off: DataFrame, zero: DataFrame, supplied: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Share of the damage done by zero-filling that supplying the data takes back."""
    j = off.withColumnRenamed("mase", "off").join(zero.withColumnRenamed("mase", "zero"), keys).join(supplied.withColumnRenamed("mase", "supplied"), keys)
    win, lose = F.count_if(F.col("supplied") < F.col("off")), F.count_if(F.col("supplied") > F.col("off"))
    g = j.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("off").alias("off"), F.avg("zero").alias("zero"), F.avg("supplied").alias("supplied"), win.alias("wins"), lose.alias("losses"),
                           F.count_if(F.col("supplied") == F.col("off")).alias("ties"))
    return g.withColumns({"recovered_pct": 100 * (1 - F.try_divide(F.col("supplied") - F.col("off"), F.col("zero") - F.col("off"))), "win_pct": F.try_divide(100.0 * F.col("wins"), F.col("wins") + F.col("losses"))})


def compare_runs(old: DataFrame, new: DataFrame, keys: list[str], rtol: float = 1e-9) -> DataFrame:
    j = old.select(*keys, F.col("mase").alias("_o")).join(new.select(*keys, F.col("mase").alias("_n")), keys)
    rel = F.abs(F.col("_o") - F.col("_n")) / F.greatest(F.abs("_o"), F.lit(1e-300))
    return j.groupBy("method").agg(F.count(F.lit(1)).alias("cells"), F.count_if(rel > rtol).alias("different"), F.avg("_o").alias("mean_old"), F.avg("_n").alias("mean_new"))


def beats_reference(runs: DataFrame, reference: str = "Naive") -> DataFrame:
    """One row: in how many series the best method beats the reference."""
    g = runs.groupBy("series", "method").agg(F.avg("mase").alias("m")).groupBy("series").agg(F.min("m").alias("best"), F.max(F.when(F.col("method") == reference, F.col("m"))).alias("ref"))
    return g.agg(F.count(F.lit(1)).alias("n_series"), F.count_if(F.col("best") < F.col("ref") - 1e-12).alias("beaten"))
