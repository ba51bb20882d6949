"""Aggregation and reporting (J1-J3): counters, log lines, funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsift.operators import dedup as E

# --- fixed values ------------------------------------------------------------
LOG_LINK = " (Session Link Match)"
LOG_FINGERPRINT = " (Session Fingerprint Match)"
LOG_MISSING = " -> Missing keyword: '"
LOG_IRRELEVANT = " -> No core relation to '"
# ---------------------------------------------------------------------------


def disposition_counts(labelled: DataFrame, grid: DataFrame | None = None, keys=("search_id", "term_no")) -> DataFrame:
    """Approved / duplicated / missing keyword / irrelevant / invalid per term.

    With ``grid`` given, terms without any row still get a line of zeros.
    """
    d = F.col("disposition")
    counts = labelled.groupBy(*keys).agg(
        F.count_if(d == E.APPROVED).alias("approved"),
        F.count_if(d.isin(E.DUP_LINK, E.DUP_FINGERPRINT)).alias("duplicated"),
        F.count_if(d == E.MISSING_KEYWORD).alias("rejected_missing_keyword"),
        F.count_if(d == E.IRRELEVANT).alias("rejected_strict_relevance"),
        F.count_if(d == E.INVALID).alias("rejected_invalid"),
    )
    if grid is None:
        return counts
    names = ["approved", "duplicated", "rejected_missing_keyword", "rejected_strict_relevance", "rejected_invalid"]
    j = grid.select(*keys).distinct().join(counts, list(keys), "left")
    return j.select(*keys, *[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in names])


def log_line(company: Column, title: Column, disposition: Column, missing_word: Column, term: Column) -> Column:
    """The reference's log text for a dropped row (null for approved/invalid)."""
    head = F.concat(F.lit("["), F.coalesce(company, F.lit("")), F.lit("] "), F.coalesce(title, F.lit("")))
    return (
        F.when(disposition == E.DUP_LINK, F.concat(head, F.lit(LOG_LINK)))
        .when(disposition == E.DUP_FINGERPRINT, F.concat(head, F.lit(LOG_FINGERPRINT)))
        .when(disposition == E.MISSING_KEYWORD, F.concat(head, F.lit(LOG_MISSING), missing_word, F.lit("'")))
        .when(disposition == E.IRRELEVANT, F.concat(head, F.lit(LOG_IRRELEVANT), term, F.lit("'")))
    )


def funnel(scored: DataFrame, key: str = "search_id") -> DataFrame:
    """Jobs scored and jobs passing the threshold, per search."""
    return scored.groupBy(key).agg(
        F.count("*").alias("jobs_scored"),
        F.count_if(F.col("passed")).alias("jobs_passed"),
    )
