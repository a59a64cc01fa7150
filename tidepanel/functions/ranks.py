"""Order statistics over groups of any size.

A plain ranking window puts a whole group into one task.  Here a group is first reduced to
(value, count), then split by value at approximate quantiles; each slice is ordered on its own and
shifted by the running total of the slices below it.  Cut points only steer the split, so ranks and
quantiles are exact however rough the cuts are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.session import cut_lineage

#: A table of a few rows per group is broadcast up to this many rows.
FEW = 100_000


def slice_count(df: DataFrame) -> int:
    """As many slices per group as the session has shuffle partitions, 16 at least."""
    return max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _accuracy(slices: int) -> int:
    return max(1000, 20 * slices)


def _cuts(df: DataFrame, keys: list[str], value: str, slices: int, shares: list[float] | None = None) -> DataFrame:
    """(keys, _cuts): ascending approximate quantiles at the given shares, else the edges of ``slices`` even slices."""
    probs = ", ".join(f"{p!r}D" for p in shares or [i / slices for i in range(1, slices)])
    return df.groupBy(*keys).agg(F.expr(f"array_distinct(percentile_approx(`{value}`, array({probs}), {_accuracy(slices)}))").alias("_cuts"))


def _below(df: DataFrame, value: str, most: int) -> DataFrame:
    """``_slice``: how many of a row's at most ``most`` cuts lie below its value, by halving."""
    df, step = df.withColumn("_slice", F.lit(0)), 1 << (max(most, 1).bit_length() - 1)
    while step:
        df = df.withColumn("_slice", F.col("_slice") + F.when(F.get("_cuts", F.col("_slice") + (step - 1)) < F.col(value), step).otherwise(0))
        step >>= 1
    return df


def _settled(small: DataFrame) -> DataFrame:
    """A table of a few rows per group, worked out once and broadcast while it has few rows: the size that Spark expects
    of an aggregate is that of its input, which would shuffle all rows by group."""
    small = cut_lineage(small)
    return F.broadcast(small) if small.count() <= FEW else small


def _attach(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Join per-key facts back; without keys the other side is one row."""
    return df.join(small, keys) if keys else df.join(F.broadcast(small))


def sliced_counts(df: DataFrame, keys: list[str], value: str, slices: int | None = None, carry: tuple = ()) -> DataFrame:
    """(keys, value, n, before, total): how often a value occurs and how many rows lie below it.

    ``carry`` are further aggregates to keep per distinct value."""
    slices = slices or slice_count(df)
    vals = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), *carry)
    cut = _below(_attach(vals, _cuts(vals, keys, value, slices), keys), value, slices - 1).drop("_cuts")
    per = cut.groupBy(*keys, "_slice").agg(F.sum("n").alias("_ns"))
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    below = per.select(*keys, "_slice",                      # at most `slices` rows per key
                       (F.sum("_ns").over(over.orderBy("_slice")) - F.col("_ns")).alias("_off"),
                       F.sum("_ns").over(over).alias("total"))
    w = Window.partitionBy(*keys, "_slice").orderBy(value)
    return (cut.join(below, [*keys, "_slice"])
               .withColumn("before", F.col("_off") + F.sum("n").over(w) - F.col("n"))
               .drop("_slice", "_off"))


def average_ranks(df: DataFrame, keys: list[str], value: str, slices: int | None = None) -> DataFrame:
    """(keys, value, n, rank): rank of each distinct value, ties averaged."""
    return sliced_counts(df, keys, value, slices).select(
        *keys, value, "n", "total", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], slices: int | None = None) -> DataFrame:
    """Linear-interpolation quantiles per key, one column per named probability.

    Cuts lie close on both sides of each probability, and rows are only counted per slice: at a cut or between two.
    The slices that hold a wanted position, one or two per probability and key, are the only rows shuffled and ordered."""
    slices = slices or slice_count(df)
    known = df.select(*keys, value).filter(F.col(value).isNotNull())
    shares = sorted({min(max(p + side / _accuracy(slices), 0.0), 1.0) for p in probs.values() for side in (-2, 2)})
    cut = _below(_attach(known, _settled(_cuts(known, keys, value, slices, shares)), keys), value, len(shares))
    at_cut = F.when(F.get("_cuts", F.col("_slice")) == F.col(value), 1).otherwise(0)
    cut = cut.withColumn("_slice", 2 * F.col("_slice") + at_cut).drop("_cuts")
    per = cut.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_ns"))
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))            # at most `slices` rows per key
    per = per.withColumn("_off", F.sum("_ns").over(over.orderBy("_slice")) - F.col("_ns")).withColumn("total", F.sum("_ns").over(over))
    inside = lambda k: (F.col("_off") <= k) & (k < F.col("_off") + F.col("_ns"))
    wanted = [inside(f(F.lit(p) * (F.col("total") - 1))) for p in probs.values() for f in (F.floor, F.ceil)]
    held = _settled(per.filter(reduce(lambda a, b: a | b, wanted)).drop("_ns"))
    w = Window.partitionBy(*keys, "_slice").orderBy(value)
    c = (cut.join(held, [*keys, "_slice"]).groupBy(*keys, "_slice", "_off", "total", value).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("before", F.col("_off") + F.sum("n").over(w) - F.col("n")))

    def at(k):
        return F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col(value)))

    aggs = []
    for name, p in probs.items():
        h = F.lit(p) * (F.col("total") - 1)
        lo = F.floor(h)
        aggs += [at(lo).alias(f"_{name}_lo"), at(F.ceil(h)).alias(f"_{name}_hi"), F.max(h - lo).alias(f"_{name}_w")]
    got = c.groupBy(*keys).agg(*aggs)
    return got.select(*keys, *[(F.col(f"_{n}_lo") + F.col(f"_{n}_w") * (F.col(f"_{n}_hi") - F.col(f"_{n}_lo"))).alias(n) for n in probs])


def global_row_number(df: DataFrame, order: str, tie: str, name: str = "rn", slices: int | None = None) -> DataFrame:
    """1..N over the whole table in (order, tie) order without a single-task window."""
    slices = slices or slice_count(df)
    kind = dict(df.dtypes)[order]
    key = F.col(order).cast("timestamp") if kind.startswith(("timestamp", "date")) else F.col(order)
    d = df.withColumn("_k", key.cast("double"))
    d = _below(d.join(F.broadcast(_cuts(d, [], "_k", slices))), "_k", slices - 1).drop("_cuts", "_k")
    per = d.groupBy("_slice").agg(F.count(F.lit(1)).alias("_ns"))
    below = per.select("_slice", (F.sum("_ns").over(Window.partitionBy(F.lit(0)).orderBy("_slice")) - F.col("_ns")).alias("_off"))
    w = Window.partitionBy("_slice").orderBy(order, tie)
    return d.join(F.broadcast(below), "_slice").withColumn(name, F.col("_off") + F.row_number().over(w)).drop("_slice", "_off")
