"""Sinks (K1, K2): the stored-jobs table with a unique link, batch or streaming.

The table is a Spark table of the columns of the reference's ``jobs`` table, bucketed by link
at a path of its own. Uniqueness of ``link`` is kept by the writer: the first row per link
inside the batch, then an anti-join against the links stored, which reads the buckets in
place: only the batch is shuffled, never what is stored. With a single writer (one streaming
query, or ``foreachBatch``) appends never race. Texts are stored whole.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsift.operators.dedup import cut_lineage, release
from jobsift.operators.rank import ARRIVAL

BUCKETS = 64

JOBS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("applied", T.BooleanType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("published_at", T.StringType()),
])


def link_id(link: Column) -> Column:
    """The generated key of a stored job: a positive 63-bit hash of its unique link."""
    return F.xxhash64(link).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def bucketed_table(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], buckets: int = BUCKETS) -> str:
    """The name of the table at ``path``, bucketed by ``keys``, registered in this session; made if absent."""
    name = "jobsift_" + hashlib.md5(path.encode()).hexdigest()
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    by, at = ", ".join(f"`{k}`" for k in keys), path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({by}) INTO {buckets} BUCKETS LOCATION '{at}'")
    spark.catalog.refreshTable(name)    # another session (a stream has its own) may have appended
    return name


def append_rows(rows: DataFrame, name: str, keys: list[str], buckets: int = BUCKETS, overwrite: bool = False) -> None:
    """Append to a bucketed table, one file a bucket; ``overwrite`` replaces its rows."""
    rows.repartition(buckets, *keys).write.insertInto(name, overwrite=overwrite)


def new_unique_rows(batch: DataFrame, stored_links: DataFrame, as_of: str) -> DataFrame:
    """K1 core: first row per link of the batch, minus links already stored, with the
    table defaults (applied=false, created_at=as_of) and the link's key.

    The first row is an aggregate, combined before the shuffle, so a link that half of the
    rows share comes as one row a task.
    """
    order = [c for c in ("search_id", *ARRIVAL) if c in batch.columns]
    usable = batch.where(F.col("link").isNotNull() & F.col("title").isNotNull())
    fields = F.struct("title", "company", "location", "description", "source", "published_at")
    firsts = usable.groupBy("link").agg(F.min_by(fields, F.struct(*order)).alias("_f")).select("link", "_f.*")
    fresh = firsts.join(stored_links.select("link"), "link", "left_anti")
    return fresh.select(
        link_id(F.col("link")).alias("id"), "title", "company", "location", "link", "description", "source",
        F.lit(False).alias("applied"),
        F.to_timestamp(F.lit(as_of)).alias("created_at"),
        "published_at",
    )


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    return spark.table(bucketed_table(spark, path, JOBS_SCHEMA, ["link"]))


def jobs_init(spark: SparkSession, path: str, reset: bool = False) -> None:
    """K2: create the empty typed table if absent; ``reset`` empties it."""
    name = bucketed_table(spark, path, JOBS_SCHEMA, ["link"])
    if reset:
        append_rows(spark.createDataFrame([], JOBS_SCHEMA), name, ["link"], overwrite=True)


def append_unique(batch: DataFrame, path: str, as_of: str) -> int:
    """K1: append the batch's new links to the table; returns rows appended."""
    spark = batch.sparkSession
    stored = read_jobs(spark, path).select("link")
    # written aside first, since the table that is read is the one appended to
    new, seen = cut_lineage(new_unique_rows(batch, stored, as_of), {"n": F.count(F.lit(1))})
    append_rows(new, bucketed_table(spark, path, JOBS_SCHEMA, ["link"]), ["link"])
    release(new)
    return seen["n"]


def stream_append_unique(stream: DataFrame, path: str, checkpoint_path: str, as_of: str):
    """K1 on a stream: each micro-batch goes through ``append_unique`` (one writer)."""
    def write(batch_df: DataFrame, _epoch: int) -> None:
        append_unique(batch_df, path, as_of)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_path)
