"""Joins that line series up in time.  Windows run per series at daily grain (one row per day)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

W_UP = lambda keys, order="ds": Window.partitionBy(*keys).orderBy(order)


def ffill(col: Column, keys, order="ds", limit: int | None = None) -> Column:
    lo = Window.unboundedPreceding if limit is None else -limit
    return F.last(col, ignorenulls=True).over(W_UP(keys, order).rowsBetween(lo, 0))


def head_value(col: Column, keys, order="ds") -> Column:
    """First known value of a series.  After a forward fill only leading rows are empty, so this is their
    backward fill; one value per series costs O(n) where a frame to the end would cost O(n^2)."""
    return F.first(col, ignorenulls=True).over(W_UP(keys, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def on_dates(long_df: DataFrame, dates: DataFrame, names: list[str]) -> DataFrame:
    """Every listed name on every target date; NULL where the source has no row (exact match)."""
    grid = dates.select("ds").distinct().select("ds", F.explode(F.array(*[F.lit(n) for n in names])).alias("name"))
    return grid.join(long_df, ["name", "ds"], "left")


def merge_external(dates: DataFrame, external: DataFrame, names: list[str], how: str = "left") -> DataFrame:
    """External series joined on date, then forward fill, backward fill and median fill."""
    ext_days = external.select("ds").distinct()
    keep = {"left": dates.select("ds").distinct(),
            "inner": dates.select("ds").distinct().join(ext_days, "ds", "left_semi"),
            "outer": dates.select("ds").union(ext_days).distinct()}[how]
    g = on_dates(external, keep, names)
    filled = g.withColumn("value", F.coalesce(ffill(F.col("value"), ["name"]), head_value(F.col("value"), ["name"])))
    med = F.percentile("value", F.lit(0.5)).over(Window.partitionBy("name"))
    return filled.withColumn("value", F.coalesce("value", med))


def align_asof(external: DataFrame, dates: DataFrame, names: list[str]) -> DataFrame:
    """Last value at or before each target date; dates before the first value take the first one after."""
    targets = dates.select("ds").distinct().select("ds", F.explode(F.array(*[F.lit(n) for n in names])).alias("name"))
    both = (external.select("name", "ds", "value", F.lit(0).alias("target"))
            .unionByName(targets.select("name", "ds", F.lit(None).cast("double").alias("value"), F.lit(1).alias("target"))))
    w = Window.partitionBy("name").orderBy("ds", "target")
    back = F.last("value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    got = both.withColumn("value", back).filter("target = 1").drop("target")
    return got.withColumn("value", F.coalesce("value", head_value(F.col("value"), ["name"])))


def roll_map(calendar: DataFrame) -> DataFrame:
    """(day, ds): first calendar day at or after each day from the calendar's first day on; one row per day."""
    before = F.lag("ds", 1).over(Window.partitionBy(F.lit(1)).orderBy("ds"))          # one row per calendar day
    steps = calendar.select("ds").distinct().withColumn("lo", F.coalesce(F.date_add(before, 1), F.col("ds")))
    return steps.select(F.explode(F.sequence("lo", "ds")).alias("day"), "ds")


def roll_to_next_business_day(df: DataFrame, calendar: DataFrame, date_col: str) -> DataFrame:
    """Replace the date by the next calendar day, which for any date before the calendar is its first day.

    Days past the end of the calendar drop out, as no later day is known for them."""
    m = roll_map(calendar).withColumnRenamed("ds", "_to")                       # one row per day of the calendar's span
    first = calendar.agg(F.min("ds").alias("_first"))
    at = F.when(F.col(date_col).isNotNull(), F.greatest(date_col, "_first"))
    rolled = df.join(F.broadcast(first)).withColumn("_at", at).join(F.broadcast(m), F.col("_at") == F.col("day"))
    return rolled.drop("day", "_at", "_first", date_col).withColumnRenamed("_to", date_col)


def period_join(df: DataFrame, periods: DataFrame, date_col: str = "ds") -> DataFrame:
    """Rows with every reporting period that covers their date.

    Periods are spread over their days, so this is an equi join on the date instead of a range join; a date
    in two overlapping periods belongs to both."""
    days = periods.withColumn("_d", F.explode(F.sequence("start_date", "end_date")))
    return df.join(days, F.col(date_col) == F.col("_d")).drop("_d")


def merge_override(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Columns of the second source replace same-named columns of the first."""
    dup = [c for c in right.columns if c != key and c in left.columns]
    return left.drop(*dup).join(right, key, how)


def combine_sources(*sources: DataFrame) -> DataFrame:
    """Union of (name, ds, value) sources; for a name held by several, the last source wins entirely."""
    tagged = None
    for p, s in enumerate(sources):
        t = s.select("name", "ds", "value", F.lit(p).alias("_p"))
        tagged = t if tagged is None else tagged.unionByName(t)
    owner = tagged.groupBy("name").agg(F.max("_p").alias("_p"))
    return tagged.join(owner, ["name", "_p"]).drop("_p")


def lag_pairs(df: DataFrame, lags: list[int], keys=("series",), value: str = "y") -> DataFrame:
    """(series, ds, y, k, y_lag): every point next to its value k rows before."""
    w = W_UP(keys)
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_l{k}").alias("y_lag")) for k in lags])
    cols = [F.lag(value, k).over(w).alias(f"_l{k}") if k else F.col(value).alias("_l0") for k in lags]
    return (df.select(*keys, "ds", value, *cols).select(*keys, "ds", value, F.explode(cells).alias("x"))
              .select(*keys, "ds", value, "x.k", "x.y_lag").filter("y_lag is not null"))


def forward_gap(df: DataFrame, keys=("name",)) -> DataFrame:
    """Leading rows without data per series, their share, and the flag beyond ten percent."""
    i = F.row_number().over(W_UP(keys))
    g = df.withColumn("_i", i).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("value").isNotNull(), F.col("_i"))).alias("_f"))
    lead = F.coalesce(F.col("_f") - 1, F.col("n"))
    return g.select(*keys, "n", lead.alias("n_leading"), (100.0 * lead / F.col("n")).alias("share_pct"), (100.0 * lead / F.col("n") > 10).cast("int").alias("flagged"))
