"""The stored CVs (B5) as a bucketed table that takes the log in batches.

A batch adds the last event of each of its users, and reads nothing of what is stored. The
state of a user is the last of these events by (ts, event_id), so batches may come late, in
any order or twice. The table is bucketed by user: reading the state shuffles nothing.
``compact`` writes one row a user as a new table, clears included, since an older upload may
still come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobsift.operators import cv as B
from jobsift.streaming.sinks import append_rows, bucketed_table

KEY = ["user_id"]


class CvStore:
    """Last events per user below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, log: DataFrame) -> None:
        """Add a batch of the log (user_id, ts, event_id, action, text); its first sets the types."""
        last = B.last_events(log)
        append_rows(last, bucketed_table(self.spark, self.path, last.schema, KEY), KEY)

    def events(self) -> DataFrame:
        """Every user's last event. Before the first batch there is no table: an error."""
        rows = self.spark.read.parquet(self.path)
        return B.last_events(self.spark.table(bucketed_table(self.spark, self.path, rows.schema, KEY)))

    def stored(self) -> DataFrame:
        """(user_id, cv_text) of the users with a CV."""
        return B.stored_cvs(self.events())

    def compact(self, path: str) -> CvStore:
        """The same state in a new table with one row a user."""
        whole = CvStore(self.spark, path)
        whole.add(self.events())
        return whole


def stream_cvs(log: DataFrame, store: CvStore, checkpoint_path: str):
    """``CvStore.add`` on a stream of log rows."""
    return log.writeStream.foreachBatch(lambda rows, _: store.add(rows)).option("checkpointLocation", checkpoint_path)
