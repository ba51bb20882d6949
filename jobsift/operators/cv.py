"""CV intake (B1-B5): page texts -> one CV per user, stored-CV log, effective CV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsift.functions.text import py_strip

# --- fixed values ------------------------------------------------------------
PAGE_SEPARATOR = "\n\n"
CV_EXTENSION = ".pdf"
# ---------------------------------------------------------------------------


def cv_file_filter(pages: DataFrame) -> DataFrame:
    """B2: only files whose name ends with .pdf, any case."""
    return pages.where(F.lower(F.col("file_name")).endswith(CV_EXTENSION))


def cv_concat(pages: DataFrame) -> DataFrame:
    """B1: every page text followed by a blank line, files then pages in order.

    One CV is one user's document, so the per-CV list is bounded by that document.
    """
    parts = F.array_sort(F.collect_list(F.struct("file_no", "page_no", "text")))
    body = F.array_join(F.transform(parts, lambda p: F.concat(p["text"], F.lit(PAGE_SEPARATOR))), "")
    return pages.groupBy("cv_id").agg(body.alias("cv_text"))


def cv_uploads(pages: DataFrame) -> DataFrame:
    """Uploads of this request: every user with files; text from the PDF files only
    (a user whose files are all non-PDF uploads an empty text)."""
    users = pages.select("cv_id").distinct()
    text = cv_concat(cv_file_filter(pages))
    return users.join(text, "cv_id", "left").select("cv_id", F.coalesce("cv_text", F.lit("")).alias("cv_text"))


def cv_store_update(log: DataFrame) -> DataFrame:
    """The stored CV per user after a log of uploads and clears.

    Blank uploads store nothing; the last remaining event (by ts, event_id) decides:
    a clear leaves no CV, an upload stores its text. ``max_by`` aggregates partially,
    so a user with a huge log is not gathered into one task.
    """
    return stored_cvs(last_events(log))


def last_events(log: DataFrame) -> DataFrame:
    """The last event per user that counts (user_id, ts, event_id, action, text); of no two
    orders of the log does it differ, so the last of parts' last events is that of the whole."""
    kept = log.where((F.col("action") == "clear") | (py_strip(F.coalesce("text", F.lit(""))) != ""))
    last = kept.groupBy("user_id").agg(
        F.max_by(F.struct("ts", "event_id", "action", "text"), F.struct("ts", "event_id")).alias("_last")
    )
    return last.select("user_id", "_last.*")


def stored_cvs(last: DataFrame) -> DataFrame:
    """B5 from every user's last event: a clear leaves no CV."""
    return last.where(F.col("action") == "upload").select("user_id", F.col("text").alias("cv_text"))


def cv_effective(uploads: DataFrame, stored: DataFrame) -> DataFrame:
    """A new upload wins (even when its text is blank: no fall back); without an
    upload the stored CV is used. Output user_id, cv_text, cv_origin."""
    u = uploads.select(F.col("cv_id").alias("user_id"), F.col("cv_text").alias("_new"), F.lit(True).alias("_up"))
    s = stored.select("user_id", F.col("cv_text").alias("_old"))
    j = u.join(s, "user_id", "full")
    has_upload = F.coalesce("_up", F.lit(False))
    return j.select(
        "user_id",
        F.when(has_upload, F.col("_new")).otherwise(F.coalesce("_old", F.lit(""))).alias("cv_text"),
        F.when(has_upload, F.lit("upload")).when(F.col("_old").isNotNull(), F.lit("stored")).otherwise(F.lit("none")).alias("cv_origin"),
    )


def cv_required(cvs: DataFrame) -> DataFrame:
    """A blank CV stops the search (the user's row is dropped)."""
    return cvs.where(py_strip(F.coalesce("cv_text", F.lit(""))) != "")
