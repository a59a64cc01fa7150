"""Table maintenance: append, upsert, score updates, dedup, set comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.ranks import global_row_number


def _row(df: DataFrame, keys) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in keys])


def dedupe(df: DataFrame, keys: list[str], order: list[str], keep: str = "first") -> DataFrame:
    """One row per key, the first or last in order (``none`` leaves the rows as they are).

    An aggregate instead of a ranking window: copies of a hot key collapse before the shuffle."""
    if keep == "none":
        return df
    pick = F.min_by if keep == "first" else F.max_by
    kept = df.groupBy(*keys).agg(pick(_row(df, keys), F.struct(*order)).alias("r"))
    return kept.select(*keys, "r.*")


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key occurs more than once."""
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return df.join(twice, keys, "left_semi")


def conflicting_duplicates(df: DataFrame, keys: list[str], numbers: list[str], texts: list[str], rtol: float = 1e-9) -> DataFrame:
    """Keys held by several rows whose contents really differ."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                              *[(F.max(c) - F.min(c)).alias(f"_r_{c}") for c in numbers],
                              *[F.max(F.abs(F.col(c))).alias(f"_m_{c}") for c in numbers],
                              *[x for c in texts for x in (F.min(c).alias(f"_lo_{c}"), F.max(c).alias(f"_hi_{c}"),)])
    bad = F.lit(False)
    for c in numbers:
        bad = bad | F.coalesce(F.col(f"_r_{c}") > rtol * F.greatest(F.col(f"_m_{c}"), F.lit(1e-300)), F.lit(False))
    for c in texts:
        bad = bad | F.coalesce(F.col(f"_lo_{c}") != F.col(f"_hi_{c}"), F.lit(False))
    return g.filter("n > 1").select(*keys, "n", bad.cast("int").alias("conflict"))


def drop_arm(df: DataFrame, condition: Column) -> DataFrame:
    """Rows of a faulty arm removed; rows for which the condition is unknown stay."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def tail(df: DataFrame, keys: list[str], n: int, order: str = "ds") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def append_new_days(existing: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    """Add days later than the table's last one; with ``force`` days already present are replaced."""
    if force:
        return existing.join(new.select("ds").distinct(), "ds", "left_anti").unionByName(new)
    last = existing.agg(F.max("ds").alias("_last"))
    fresh = new.join(F.broadcast(last)).filter(F.col("_last").isNull() | (F.col("ds") > F.col("_last"))).drop("_last")
    return existing.unionByName(fresh)


def append_gap(existing: DataFrame, new: DataFrame) -> DataFrame:
    """One row: last stored day, first and last new day, and the days missing between."""
    a = existing.agg(F.max("ds").alias("last_ds"))
    b = new.agg(F.min("ds").alias("first_new"), F.max("ds").alias("last_new"))
    return a.join(b).withColumn("gap_days", F.greatest(F.datediff("first_new", "last_ds") - 1, F.lit(0)))


def accepted_articles(batch: DataFrame) -> DataFrame:
    """Articles that can be scored (a title) or already are (a polarity)."""
    return batch.filter((F.trim("title") != "") | F.col("polarity").isNotNull())


def upsert_articles(table: DataFrame, batch: DataFrame, order: list[str]) -> DataFrame:
    """Insert-or-ignore by uid: stored rows, scores included, are never overwritten."""
    fresh = dedupe(accepted_articles(batch), ["uid"], order)
    return table.unionByName(fresh.join(table.select("uid"), "uid", "left_anti").select(*table.columns))


def upsert_counts(table: DataFrame, batch: DataFrame) -> DataFrame:
    """One row: accepted distinct articles of a batch, how many are new, how many duplicates."""
    ids = accepted_articles(batch).select("uid").distinct()
    known = table.select("uid", F.lit(1).alias("_k")).distinct()
    return ids.join(known, "uid", "left").agg(
        F.count(F.lit(1)).alias("accepted"), F.count_if(F.col("_k").isNull()).alias("new"), F.count("_k").alias("duplicate"))


def write_scores(table: DataFrame, scores: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Table with score columns replaced where a new score exists (scores hold one row per key)."""
    new = scores.select(key, *[F.col(c).alias(f"_n_{c}") for c in columns])
    j = table.join(new, key, "left")
    keep = [c for c in table.columns if c not in columns]
    return j.select(*keep, *[F.coalesce(F.col(f"_n_{c}"), F.col(c)).alias(c) for c in columns])


def append_stream_items(existing: DataFrame, items: DataFrame, key: str, order: str) -> DataFrame:
    """Add unknown items and continue the running number ``no`` in time order."""
    fresh = dedupe(items, [key], [order]).join(existing.select(key), key, "left_anti")
    numbered = global_row_number(fresh, order, key, "_rn")
    top = existing.agg(F.coalesce(F.max("no"), F.lit(0)).alias("_max"))
    out = numbered.join(F.broadcast(top)).withColumn("no", F.col("_max") + F.col("_rn"))
    return existing.unionByName(out.select(*existing.columns))


def missing_per_entity(df: DataFrame, entities: list[str]) -> DataFrame:
    """(entity, ds): days some entity reports and this one does not."""
    have = df.groupBy("ds").agg(F.collect_set("entity").alias("have"))     # at most one entry per entity
    return have.select("ds", F.explode(F.array_except(F.array(*[F.lit(e) for e in entities]), "have")).alias("entity"))


def date_set_comparison(df: DataFrame, entities: list[str], samples: int = 5) -> DataFrame:
    """Per entity: number of missing days and the first few of them (grain: one row per day)."""
    missing = missing_per_entity(df, entities).withColumn("_i", F.row_number().over(Window.partitionBy("entity").orderBy("ds")))
    first = F.sort_array(F.collect_list(F.when(F.col("_i") <= samples, F.date_format("ds", "yyyy-MM-dd"))))
    return missing.groupBy("entity").agg(F.count(F.lit(1)).alias("n_missing"), F.concat_ws(", ", first).alias("examples"))


def missing_calendar_days(df: DataFrame, keys: list[str]) -> DataFrame:
    """Days between the first and last of a key that have no row."""
    days = df.select(*keys, "ds").distinct()
    full = days.groupBy(*keys).agg(F.min("ds").alias("lo"), F.max("ds").alias("hi")).select(*keys, F.explode(F.sequence("lo", "hi")).alias("ds"))
    return full.join(days, [*keys, "ds"], "left_anti")


def missing_until(df: DataFrame, keys: list[str], asof: str) -> DataFrame:
    """Days after the last row of a key up to the day before ``asof``."""
    last = df.groupBy(*keys).agg(F.max("ds").alias("hi"))
    end = F.date_sub(F.lit(asof).cast("date"), 1)
    return last.filter(F.col("hi") < end).select(*keys, F.explode(F.sequence(F.date_add("hi", 1), end)).alias("ds"))
