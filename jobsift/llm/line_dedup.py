"""Operator 6: remove boilerplate lines by their frequency within one site.

For every host the pages that contain a line are counted and divided by the host's
pages; a line above the ratio is boilerplate *there* and is dropped from that host's
pages only. Counting groups by (host, line hash), pre-aggregated before the shuffle, so
neither a host with a third of all pages nor a line on all pages meets in one task.

A host's boilerplate list is short whatever the host's size: a page with ``m`` distinct
lines adds ``m / pages`` to the sum of ratios, so at most (mean distinct lines a page) /
ratio lines can exceed the ratio. The lists join back on the host. Spark broadcasts that
table while it is under ``spark.sql.autoBroadcastJoinThreshold`` and shuffles beyond it,
splitting hot hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsift.llm.store import keep, unused

RATIO = 0.05
MIN_PAGES = 3
_EDGES = " \t\r\x0b\x0c"


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(_EDGES))


def _print(line: Column) -> Column:
    """128 bits of the trimmed line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, distinct: bool = False) -> DataFrame:
    """``host, lines``: prints of the lines on more than ``ratio`` of the host's pages."""
    pages = docs.select(F.col(host).alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if distinct:
        pages = pages.groupBy("host", _print(F.col("text"))).agg(F.any_value("text").alias("text"))
    pages = pages.select("host", F.split("text", "\n").alias("lines"))
    total = pages.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    lines = pages.select("host", F.explode(F.array_distinct(F.transform("lines", _trimmed))).alias("line")).where("line <> ''")
    counts = (lines.select("host", _print(F.col("line")).alias("p")).groupBy("host", "p")
              .agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages))
    return (counts.join(total.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of")))
            .where(F.col("pages") > ratio * F.col("total"))
            .groupBy("host").agg(F.collect_list("p").alias("lines")))


def line_dedup(docs: DataFrame, host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, distinct: bool = False) -> DataFrame:
    """Drop boilerplate lines from ``docs(doc_id, text, <host>, ...)``.

    A line is what stands between ``\\n``; it is compared without leading and trailing
    blanks, case kept. A line counts once a page. It is dropped where it is on more than
    ``ratio`` of its host's pages, and on at least ``min_pages`` of them.

    All rows and columns of ``docs`` come back in place, ``text`` without those lines, and
    ``n_lines``, ``n_dropped`` (which replace columns of these names). Blank lines stay. A
    null text stays null with 0 lines; an empty text is one blank line. Null hosts form
    one host. Repeated rows are pages of their own, or with ``distinct`` the equal texts of
    a host are one page, a null text being equal to an empty one. A page of boilerplate only becomes
    an empty text; no row is dropped.
    """
    found = keep(boilerplate(docs, host, ratio, min_pages, distinct), "boilerplate")
    # names that no column of the caller has
    at, drop, left = (unused(docs, x) for x in ("_host", "_drop", "_kept"))
    lists = found.df.select(F.col("host").alias(at), F.col("lines").alias(drop))
    joined = docs.withColumn("text", F.col("text").cast("string")).join(lists, docs[host].eqNullSafe(F.col(at)), "left")
    lines = F.split("text", "\n")
    stays = F.filter(lines, lambda x: (_trimmed(x) == "") | ~F.array_contains(drop, _print(_trimmed(x))))
    kept = joined.withColumn(left, F.when(F.col(drop).isNull(), lines).otherwise(stays))
    return kept.select(
        *[F.array_join(left, "\n").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines) - F.size(left)).cast("long").alias("n_dropped"))
