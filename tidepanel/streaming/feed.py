"""Article feed as a stream: resumable ingest, dedup, business-day windows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidepanel.operators.tables import accepted_articles, dedupe


def read_feed(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    """Files of a landing folder in arrival order; the trigger size bounds a batch, not the feed."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _stored(spark: SparkSession, store: str) -> DataFrame | None:
    """The store, or None before the first batch; any other read problem stays an error."""
    try:
        return spark.read.parquet(store)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def insert_new(batch: DataFrame, store: str, order: list[str], key: str = "uid", first: Callable[[DataFrame], None] | None = None) -> list:
    """Append the batch's rows whose key the store doesn't hold, the first of each key in the batch; the days it touched.
    ``first`` gets these rows before they are stored.

    The store is partitioned by publication day, and equal keys have equal days, so only the partitions of the batch's
    days are read: their list, a few dates, is the partition filter.  A batch replayed after a failure finds its rows
    stored and adds nothing."""
    spark = batch.sparkSession
    fresh = dedupe(batch, [key], order).withColumn("published_day", F.to_date("published_utc"))
    # a kept frame has all shuffle partitions, which for a batch are mostly start-up
    fresh = new = fresh.coalesce(2 * spark.sparkContext.defaultParallelism).persist()
    try:
        days = [r[0] for r in fresh.select("published_day").distinct().collect()]
        if not days:
            return days
        known = _stored(spark, store)
        if known is not None:
            held = F.col("published_day").isin([d for d in days if d is not None])
            held = held | F.col("published_day").isNull() if None in days else held
            new = fresh.join(known.filter(held).select(key), key, "left_anti")
        if first is not None:
            first(new)
        # rebalance splits a hot day over several files and keeps small days in one
        new.hint("rebalance", "published_day").write.mode("append").partitionBy("published_day").parquet(store)
        return days
    finally:
        fresh.unpersist()


def _write_once(spark: SparkSession, path: str, rows: Callable[[], DataFrame]) -> None:
    """One file of a few rows; what a finished write left there stays."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        rows().coalesce(1).write.mode("overwrite").parquet(path)


def _drain(stream: DataFrame, checkpoint: str, put) -> None:
    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def ingest_feed(stream: DataFrame, store: str, checkpoint: str, order: list[str]) -> None:
    """Drain the feed into the store, insert-or-ignore by uid, articles that cannot be scored left out.

    Exactly-once in effect; late articles, however late, are stored like any other and keep their own business day."""
    _drain(stream, checkpoint, lambda batch, _id: insert_new(accepted_articles(batch), store, order))


def stream_dedup(stream: DataFrame, store: str, checkpoint: str, order: list[str], key: str = "uid") -> None:
    """First copy of each key into the store.  What was seen is the store itself, so a repeat is known at any age and
    a late first copy is kept."""
    _drain(stream, checkpoint, lambda batch, _id: insert_new(batch, store, order, key))


def tumbling_from_store(stream: DataFrame, store: str, table: str, checkpoint: str, order: list[str], key: str = "uid") -> None:
    """Counts and mean polarity per business day, revised whenever a batch touches the day, at any lateness.

    Only a batch's new rows are counted: their sums per business day are kept in ``<store>-sums``, and a touched day is the
    total of its sums, however many rows the store holds.  Sums are written before the rows and once per batch, so a batch
    replayed after a failure, when some or all of its rows are stored, changes nothing.  Rows that the store held before its
    first batch here are summed once; from then on only this function may add to it.  ``latest_revision`` reads the result."""
    sums = f"{store.rstrip('/')}-sums"

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stream_id = spark.sparkContext.getLocalProperty("sql.streaming.queryId")        # kept with the checkpoint

        def count(new: DataFrame) -> None:
            _write_once(spark, f"{sums}/stream=before/batch=-1", lambda: _day_sums(new.limit(0) if (held := _stored(spark, store)) is None else held))
            _write_once(spark, f"{sums}/stream={stream_id}/batch={batch_id}", lambda: _day_sums(new))

        days = [d for d in insert_new(batch, store, order, key, count) if d is not None]
        if days:
            touched = {d + dt.timedelta(k) for d in days for k in (0, 1)}            # a day's news count for it or the next
            total = spark.read.parquet(sums).filter(F.col("business_date").isin(list(touched))).groupBy("business_date", "scorer")
            _means(total.agg(F.sum("n_news").alias("n_news"), F.sum("s").alias("s"))).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    _drain(stream, checkpoint, put)


def _day_sums(df: DataFrame, time: str = "published_utc") -> DataFrame:
    w = F.window(time, "1 day", "1 day", "9 hours")
    g = df.filter("polarity is not null").groupBy(w.alias("w"), "scorer").agg(F.count(F.lit(1)).alias("n_news"), F.sum("polarity").alias("s"))
    return g.select(F.to_date(F.col("w.end")).alias("business_date"), "scorer", "n_news", "s")


def _means(sums: DataFrame) -> DataFrame:
    return sums.select("business_date", "scorer", "n_news", (F.col("s") / F.col("n_news")).alias("polarity"))


def business_day_tumbling(df: DataFrame, time: str = "published_utc") -> DataFrame:
    """Counts and mean polarity per business day: a day runs from 09:00 UTC (16:00 at the desk) to 09:00."""
    return _means(_day_sums(df, time))


def latest_revision(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest revision of each key, by batch."""
    t = spark.read.parquet(path)
    row = F.struct(*[c for c in t.columns if c not in keys])
    return t.groupBy(*keys).agg(F.max_by(row, "batch").alias("r")).select(*keys, "r.*")
