"""Forecast versions as append-only tables: values by version, metadata, and a list of deletions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.session import drop_scratch

_META = "version_id string, created string, model_config map<string,string>, info map<string,string>"


def save_version(forecast: DataFrame, root: str, version_id: str, created: str, model_config: dict, info: dict) -> None:
    """One partition per version; saving an id again replaces that partition only."""
    spark = forecast.sparkSession
    (forecast.withColumn("version_id", F.lit(version_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version_id").parquet(f"{root}/values"))
    spark.createDataFrame([(version_id, created, model_config, info)], _META).write.mode("append").parquet(f"{root}/metadata")
    spark.createDataFrame([(version_id, False)], "version_id string, deleted boolean").withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{root}/status")


def delete_version(spark: SparkSession, root: str, version_id: str) -> None:
    """Mark as deleted; readers leave the partition out from then on."""
    spark.createDataFrame([(version_id, True)], "version_id string, deleted boolean").withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{root}/status")


def purge_version(spark: SparkSession, root: str, version_id: str) -> None:
    """Delete a version and its stored values."""
    delete_version(spark, root, version_id)
    drop_scratch(spark, f"{root}/values/version_id={version_id}")


def list_versions(spark: SparkSession, root: str) -> DataFrame:
    live = spark.read.parquet(f"{root}/status").groupBy("version_id").agg(F.max_by("deleted", F.struct("at", "deleted")).alias("d")).filter("not d").select("version_id")
    meta = spark.read.parquet(f"{root}/metadata").groupBy("version_id").agg(F.max_by(F.struct("created", "model_config", "info"), "created").alias("m"))
    return meta.join(live, "version_id").select("version_id", "m.*").orderBy(F.desc("created"))


def load_version(spark: SparkSession, root: str, version_id: str) -> DataFrame:
    """Values of one version (a partition filter); an unknown or deleted id is an error."""
    if not list_versions(spark, root).filter(F.col("version_id") == version_id).take(1):
        raise FileNotFoundError(f"version {version_id} not found")
    return spark.read.parquet(f"{root}/values").filter(F.col("version_id") == version_id)


def version_summary(spark: SparkSession, root: str) -> DataFrame:
    """Nodes per model of every live version."""
    v = list_versions(spark, root).select("version_id", F.explode("model_config").alias("node", "model"))
    return v.groupBy("version_id", "model").agg(F.count(F.lit(1)).alias("nodes"))
