"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, BPE encoding.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs, sf_dir)``, works on
all rows its predecessor kept and returns a DataFrame, which is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.llm.bpe_codec import bpe_encode, digests
from jobsift.llm.decontaminate import contaminated
from jobsift.llm.line_dedup import line_dedup
from jobsift.llm.minhash import minhash_dedup
from jobsift.llm.store import delete, shared_folder, table, unused
from jobsift.llm.toxicity import learn, score_toxicity

WORD_BPE = "word_bpe_49k.json"
PERCENT = 80


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` without the ids in ``rejected(doc_id)``; null ids stay."""
    name = unused(docs, "_rejected")
    out = rejected.where("doc_id is not null").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(out, docs["doc_id"].cast("long") == F.col(name), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject; a null id is kept.

    Texts of any length count whole; null and empty ones get the model's bias. Rows of one id
    go together when one of them is rejected. Columns are untouched; an empty table stays empty.
    """
    model = learn(docs, table(spark, sf_dir, "labels"))
    return _without(docs, score_toxicity(docs, model).where("predicted = 1"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their site's boilerplate lines; ``n_chars`` follows the text.

    Copies of a text are one page here: the next stage is the one to drop them. Null hosts
    form one host; a null text stays null, a text of boilerplate alone becomes empty; no row
    goes. Columns named like the operator's own come back as they were.
    """
    cleaned = line_dedup(docs, distinct=True)
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return (cleaned.withColumn("n_chars", n_chars) if "n_chars" in docs.columns else cleaned).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of smallest id.

    Null and empty texts are in no group and stay, and so do null ids. Rows of one id go or stay together.
    """
    return _without(docs, minhash_dedup(docs, PERCENT).where("not kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.

    Null and empty texts hold none, and items without words are in none. Null ids stay; rows
    of one id go together when one of them holds a passage. Without items all stay.
    """
    return _without(docs, contaminated(docs, table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the remaining documents, with the digests of ids and decoded text.

    One row an input row, repeated rows and null ids included; a null text counts as empty
    and has no ids. Other columns are not read.
    """
    encoded = bpe_encode(docs, public_tokenizers.path(WORD_BPE))
    return digests(encoded.select("doc_id", "ids", "decoded"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("minhash_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("bpe_codec", encode),
]

# The classifier, the fingerprints and the tokenizer are not expressible in SQL; tests/llm
# holds every stage against a brute-force version.
ORACLE_SQL = None


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS = 2_000    # whole texts that a Python task receives at once


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the tables between them lie in the shared folder."""
    docs, before = table(spark, sf_dir, "documents"), None
    rows = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(min(ROWS, int(rows)) if int(rows) > 0 else ROWS))
    try:
        for name, stage in STAGES:
            path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex[:12]}"
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
            docs = spark.read.schema(out.schema).parquet(path)
            if before:
                delete(spark, before)
            before = path
    finally:
        spark.conf.set(BATCH, rows)
    return docs
