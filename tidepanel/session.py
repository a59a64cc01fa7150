"""Session helpers: builder defaults, shared-folder scratch paths, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidepanel", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def is_local(master: str) -> bool:
    """One process on one machine: ``local``, ``local[8]``; ``local-cluster`` has executors of its own."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a one-process session may go without: it gets a folder of its own."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    if not is_local(spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="tidepanel-")
    spark.conf.set("spark.checkpoint.dir", path)
    _delete_at_exit(spark, path)
    return path


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared folder; what is written there goes when the session's JVM ends."""
    path = os.path.join(shared_dir(spark), "scratch", f"{name}-{uuid.uuid4().hex[:12]}")
    _delete_at_exit(spark, path)
    return path


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder early."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint on the shared folder, so lost executors do not lose the result."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
