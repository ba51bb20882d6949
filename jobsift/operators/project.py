"""Projections (G1-G6): posting fields as the reference fills and displays them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from jobsift.functions import dates as D
from jobsift.functions import text as T

# --- fixed values ------------------------------------------------------------
NO_LOCATION = "Not provided"
NO_DESCRIPTION = "Detailed description available on the source link."
NO_DESCRIPTION_LEGACY = "Detalhes no link."
REMOTE_PREFIX = "Remote, "
RECENT = "Recente"
NO_SCORE = "N/A"
NO_FEEDBACK = "A IA não gerou feedback para esta vaga."
SOURCE_CLASSES = (("linkedin", "badge-linkedin"), ("indeed", "badge-indeed"), ("glassdoor", "badge-glassdoor"))
GENERIC_CLASS = "badge-generic"
# ---------------------------------------------------------------------------


def remote_location(location: Column, remote_search: Column, is_remote: Column) -> Column:
    """Prefix 'Remote, ' when the search or the row is remote and the text lacks
    'remote' ('Remoto' does not count)."""
    loc = F.coalesce(location, F.lit(NO_LOCATION))
    remote = F.coalesce(remote_search, F.lit(False)) | F.coalesce(is_remote, F.lit(False))
    return F.when(remote & ~F.lower(loc).contains("remote"), F.concat(F.lit(REMOTE_PREFIX), loc)).otherwise(loc)


def published(df: DataFrame, column: str, as_of: str) -> Column:
    """F2 for the column's type: dates and timestamps are formatted, texts are parsed."""
    typed = isinstance(df.schema[column].dataType, (DateType, TimestampType, TimestampNTZType))
    return D.format_date_value(F.col(column)) if typed else D.format_date(column, as_of)


def posting_projection(df: DataFrame, as_of: str, remote_search: Column | None = None) -> DataFrame:
    """G1: the 7 posting fields (plus the row keys) of approved rows."""
    rs = remote_search if remote_search is not None else F.col("remote_search")
    desc = F.col("description")
    return df.select(
        *[c for c in ("search_id", "term_no", "loc_no", "source_no") if c in df.columns],
        "seq",
        F.col("title"),
        F.coalesce("company", F.lit("")).alias("company"),
        remote_location(F.col("location"), rs, F.col("is_remote")).alias("location"),
        F.col("job_url").alias("link"),
        F.when(desc.isNull() | (desc == ""), F.lit(NO_DESCRIPTION)).otherwise(desc).alias("description"),
        T.source_lower("site").alias("source"),
        published(df, "date_posted", as_of).alias("published_at"),
    )


def posting_projection_legacy(df: DataFrame, as_of: str) -> DataFrame:
    """The 8 legacy fields with the legacy date rule and the processing stamp."""
    desc = F.col("description")
    return df.select(
        "seq",
        F.col("title"),
        F.col("company"),
        F.col("location"),
        F.col("job_url").alias("link"),
        F.when(desc.isNull() | (desc == ""), F.lit(NO_DESCRIPTION_LEGACY)).otherwise(desc).alias("description"),
        F.lower(F.coalesce(F.col("site"), F.lit("none"))).alias("source"),
        D.format_date_legacy("date_posted").alias("published_at"),
        D.created_stamp(as_of).alias("created_at"),
    )


def source_class(source: Column) -> Column:
    """Display class by substring, linkedin before indeed before glassdoor."""
    out = F.lit(GENERIC_CLASS)
    for needle, cls in reversed(SOURCE_CLASSES):
        out = F.when(source.contains(needle), F.lit(cls)).otherwise(out)
    return out


def source_label(source: Column) -> Column:
    """First letter upper, the rest lower (not initcap, which does every word)."""
    return F.concat(F.upper(F.substring(source, 1, 1)), F.lower(F.substring(source, 2, 1 << 30)))


def card_labels(published_at: Column, score: Column, rationale: Column) -> tuple[Column, Column, Column]:
    """G6: 'Recente' for an empty/None date, 'N/A' for no score, fixed text for no rationale."""
    pub = F.when(published_at.isNull() | (published_at == "") | (published_at == "None"), F.lit(RECENT)).otherwise(published_at)
    sc = F.coalesce(score.cast("string"), F.lit(NO_SCORE))
    ra = F.when(rationale.isNull() | (rationale == ""), F.lit(NO_FEEDBACK)).otherwise(rationale)
    return pub, sc, ra
