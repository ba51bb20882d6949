"""Lineage cuts and table access shared by the operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from jobsift.session import ensure_checkpoint_dir

_RUN = uuid.uuid4().hex


def shared_folder(spark: SparkSession) -> str:
    """This run's folder below the shared folder that ``spark.checkpoint.dir`` names."""
    root = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/llm-{_RUN}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table of this run (and nothing outside its folder)."""
    if not path.startswith(shared_folder(spark)):
        raise ValueError(f"not an intermediate table of this run: {path}")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Kept:
    """A table written once in the shared folder; ``df`` reads it, ``drop`` removes it."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex[:12]}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)


def keep(df: DataFrame, name: str) -> Kept:
    """Write ``df`` to the shared folder and read it back.

    This is the only lineage cut used: the copy survives lost executors, and later
    stages restart from it. Tables still there when the session ends are removed.
    """
    return Kept(df, name)


@atexit.register
def _sweep() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            delete(spark, shared_folder(spark))
        except Exception:  # noqa: BLE001 - the session may already be gone
            pass


def unused(df: DataFrame, name: str) -> str:
    """``name``, with more underscores before it while ``df`` has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark from wherever the folder lives."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that tasks can import it."""
    context = spark.sparkContext
    if getattr(context, "_jobsift_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="jobsift-")) / "jobsift.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, path.relative_to(top.parent))
    context.addPyFile(str(archive))
    context._jobsift_shipped = True
