"""Session defaults and size checks shared by all jobs."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(
    name: str, *, master: str | None = None, shuffle_partitions: int | None = None, extra: dict | None = None
) -> SparkSession:
    """A session with adaptive execution on; cluster settings win where they are given."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(extra or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, fallback: str | None = None) -> str:
    """The folder all executors can reach, as the cluster names it.

    ``fallback`` is for tests and local runs, where the setting is absent.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if folder:
        return folder
    if fallback is not None:
        return fallback
    raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")


def spread(df: DataFrame, *keys: str, pieces: int = 1) -> DataFrame:
    """Give costly per-row work all cores when the input has fewer pieces than that.

    A small input in one file is shuffled once by ``keys``; a large one already
    has more splits than cores and is left as it is. ``pieces`` is the number of
    tasks for each core: more make the longest one shorter.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * pieces, *keys) if df.rdd.getNumPartitions() < cores * pieces else df


def local_fallback(spark: SparkSession) -> str | None:
    """A temporary folder for local sessions, where every task shares this machine; none on a cluster."""
    return tempfile.mkdtemp(prefix="spark-") if spark.sparkContext.master.startswith("local") else None


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the cluster's shared folder, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark, local_fallback(spark)))
    return df.checkpoint()
