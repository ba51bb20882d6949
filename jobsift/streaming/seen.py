"""De-duplication across batches (E3, E4): the seen-sets as stored state.

The reference's seen-sets last one call. Here they are two bucketed tables, the links and the
fingerprints of approved rows by scope, so that postings can come in batches, from files or
a stream, and get the labels that one run over all of them in order would give. A batch is
matched against the state first (the buckets are read in place, only the batch is
shuffled), then settled within itself by the rounds of ``greedy_two_key``.

State rows carry the number of the batch that approved them, and a batch reads only what
earlier ones left. A batch that is run again, after a crash between its steps or by a
stream that replays it, therefore finds the state it found before and gives the same labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsift.operators import dedup as E
from jobsift.streaming.sinks import append_rows, bucketed_table

SCOPE = list(E.SCOPE)


class SeenKeys:
    """Approved links and fingerprints of all batches so far, below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, key: str) -> str:
        schema = T.StructType([T.StructField("search_id", T.LongType()), T.StructField("term_no", T.IntegerType()),
                               T.StructField(key, T.StringType()), T.StructField("batch", T.LongType())])
        return bucketed_table(self.spark, f"{self.path}/{key}", schema, [*SCOPE, key])

    def before(self, key: str, batch: int) -> DataFrame:
        """Distinct (scope, key) approved by earlier batches."""
        return self.spark.table(self._table(key)).where(F.col("batch") < batch).select(*SCOPE, key).distinct()

    def add(self, approved: DataFrame, batch: int) -> None:
        for key in ("link", "fingerprint"):
            rows = approved.select("search_id", "term_no", key, F.lit(batch).cast("long").alias("batch"))
            append_rows(rows, self._table(key), [*SCOPE, key])


def dedup_batch(annotated: DataFrame, seen: SeenKeys, batch: int) -> DataFrame:
    """E3 and E5 of one batch: its annotated rows with their dispositions, after all batches
    of lower numbers. The approved rows' keys are added to the state."""
    links, prints = seen.before("link", batch), seen.before("fingerprint", batch)
    candidates = annotated.where("candidate").join(links, [*SCOPE, "link"], "left_anti").join(prints, [*SCOPE, "fingerprint"], "left_anti")
    approved, _ = E.greedy_two_key(candidates)
    marked = (E.label(annotated, approved)
              .join(links.withColumn("_old_link", F.lit(True)), [*SCOPE, "link"], "left")
              .join(prints.withColumn("_old_print", F.lit(True)), [*SCOPE, "fingerprint"], "left"))
    told = F.col("disposition")
    disposition = (F.when(told == E.INVALID, told).when(F.col("_old_link") | (told == E.DUP_LINK), F.lit(E.DUP_LINK))
                   .when(F.col("_old_print"), F.lit(E.DUP_FINGERPRINT)).otherwise(told))
    labelled = E.cut_lineage(marked.withColumn("disposition", disposition).select(*annotated.columns, "disposition"))
    seen.add(approved, batch)
    return labelled


def stream_dedup(stream: DataFrame, seen: SeenKeys, out: str, checkpoint_path: str):
    """``dedup_batch`` on a stream of annotated rows; the labelled rows of batch n go to ``out/batch=n``."""
    def write(rows: DataFrame, batch: int) -> None:
        dedup_batch(E.cut_lineage(rows), seen, batch).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_path)
