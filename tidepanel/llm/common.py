"""Helpers that several corpus operators share: scratch tables, word counts, spread ranks, components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.session import scratch_path

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Rows that a Python worker gets at once, unless the session says otherwise: texts are long, and a worker holds a
    batch several times over (Arrow, pandas, results)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(rows))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: later passes see the same rows even if executors are lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def random_key(seed: int, *cols: Column) -> Column:
    """Uniform integer in [0, 2**32) that depends on the seed and the columns only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed).cast("bigint"), *cols), 32)


def spread_rank(df: DataFrame, group: Sequence[str], key: str, ties: Sequence[str], total: int,
                rank: str = "rank", weight: str | None = None, before: str = "before", slice_rows: int = 20_000) -> DataFrame:
    """Rank rows of each group by ``key`` (from 0, gapless) without bringing a group into one task.

    ``key`` is uniform in [0, 2**32); every group is cut into equal key ranges, about ``slice_rows`` rows each were
    one group to hold all ``total`` rows.  Slices are ranked apart and shifted by the counts of the slices before.
    With ``weight``, ``before`` gets the sum of the weights of the rows ahead in the group.  Groups may be null.
    """
    n = max(1, -(-total // slice_rows))
    by = [*group, "_slice"]
    cut = df.withColumn("_slice", F.floor(F.col(key) * F.lit(n) / F.lit(1 << 32)).cast("int"))
    w = Window.partitionBy(*by).orderBy(key, *ties)
    local = cut.withColumn("_pos", F.row_number().over(w).cast("bigint") - 1)
    sums = [F.count(F.lit(1)).alias("_n")]
    if weight:
        local = local.withColumn("_ahead", F.coalesce(F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        sums.append(F.sum(weight).alias("_w"))
    prior = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1) if group else \
        Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(*by).agg(*sums).withColumn("_n0", F.coalesce(F.sum("_n").over(prior), F.lit(0)))
    if weight:
        starts = starts.withColumn("_w0", F.coalesce(F.sum("_w").over(prior), F.lit(0)))
    starts = starts.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], "_n0", *(["_w0"] if weight else []))
    on = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)]
    out = local.join(starts, on).withColumn(rank, F.col("_pos") + F.col("_n0"))
    if weight:
        out = out.withColumn(before, F.col("_ahead") + F.col("_w0"))
    return out.select(*df.columns, rank, *([before] if weight else []))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: (id, component) for every id that has an edge; the component is its smallest id.

    Each round hooks every id to its smallest neighbour, follows the hooks to their roots by doubling, and keeps
    only the edges between different roots.  Ids and edges stay in tables; a hot id is a row like any other, since
    the hooks are one row per id and minima are combined before the shuffle.
    """
    e = stored(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    whole = None
    while True:
        hooks = (e.union(e.select("b", "a")).groupBy("a").agg(F.min("b").alias("b"))
                  .select(F.col("a").alias("id"), F.least("a", "b").alias("root")))
        hooks = stored(hooks, "hooks")
        while True:
            up = hooks.select(F.col("id").alias("_id"), F.col("root").alias("_up"))
            jumped = stored(hooks.join(up, F.col("root") == F.col("_id")).select("id", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("moved")), "hooks")
            moved = not jumped.where("moved").isEmpty()
            hooks = jumped.select("id", "root")
            if not moved:
                break
        if whole is None:
            whole = hooks
        else:
            up = hooks.select(F.col("id").alias("_id"), F.col("root").alias("_up"))
            whole = stored(whole.join(up, F.col("root") == F.col("_id"), "left").select("id", F.coalesce("_up", "root").alias("root")), "hooks")
        ra, rb = (hooks.select(F.col("id").alias(f"_{c}"), F.col("root").alias(f"_r{c}")) for c in "ab")
        e = stored(e.join(ra, F.col("a") == F.col("_a")).join(rb, F.col("b") == F.col("_b"))
                    .select(F.least("_ra", "_rb").alias("a"), F.greatest("_ra", "_rb").alias("b")).where("a <> b").distinct(), "edges")
        if e.isEmpty():
            return whole.select("id", F.col("root").alias("component"))
