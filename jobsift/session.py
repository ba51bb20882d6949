"""Spark session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # of a JSON key that a reply has twice the last one counts
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def get_spark(master: str | None = None, app: str = "jobsift", shuffle_partitions: int | None = None) -> SparkSession:
    """Create (or reuse) a session; settings that spark-submit or a file gives are kept.

    Only a local master gets a driver memory and a number of shuffle partitions from
    here (``BENCH_CPUS``, 8 by default), and those too only where none is set.
    """
    given = SparkConf()
    wanted = dict(DEFAULTS)
    if (master or given.get("spark.master", "local[*]")).startswith("local"):
        wanted |= {"spark.sql.shuffle.partitions": str(shuffle_partitions or os.environ.get("BENCH_CPUS", "8")), "spark.driver.memory": "16g"}
    elif shuffle_partitions:
        wanted["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in wanted.items():
        if not given.contains(key):
            builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def prepare(spark: SparkSession) -> None:
    """What a session made elsewhere needs: the JSON setting and a folder for lineage cuts."""
    key = "spark.sql.variant.allowDuplicateKeys"
    spark.conf.set(key, DEFAULTS[key])
    ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only where none is configured.

    A cluster names its shared folder in ``spark.checkpoint.dir``; we use it as given.
    Only a local-mode session without the setting (tests, laptops) gets a fresh temp
    folder, because a machine-local folder would lose checkpoints with an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; name a shared folder for lineage cuts")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="jobsift-ckpt-"))
    return sc.getCheckpointDir()


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete an intermediate folder below the checkpoint folder."""
    if not path.startswith(ensure_checkpoint_dir(spark).rstrip("/") + "/"):
        raise ValueError(f"not an intermediate folder: {path}")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def spread(table: DataFrame, key: str) -> DataFrame:
    """Deal out a just-read table that has fewer input splits than the session has cores.

    Text work is CPU-bound; a table stored as one row group would run in one task. A
    table of many splits, as on a cluster, is returned as it is, without a shuffle.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores, key)
