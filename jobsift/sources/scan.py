"""Posting intake sources (A1-A4).

A1 re-aims the job-board scrape as a scan of a postings table: every cell of the search
grid (search, term, location) receives, in arrival order, its first ``quota`` postings
among those that match its term, country, age and remote flag on the scraped sites.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsift.functions import text as X
from jobsift.operators import relevance as D
from jobsift.operators.dedup import cut_lineage
from jobsift.operators.rank import first_rows, positions
from jobsift.sources import matching as M

log = logging.getLogger(__name__)

# --- fixed values (must equal the reference) --------------------------------
SCRAPE_SITES = ("linkedin", "indeed", "glassdoor")
# ---------------------------------------------------------------------------

KEYS = M.KEYS

POSTING_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("job_url", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("is_remote", T.BooleanType()),
    T.StructField("site", T.StringType()),
    T.StructField("date_posted", T.StringType()),
    T.StructField("posted_at", T.TimestampType()),
])


def empty_postings(spark: SparkSession) -> DataFrame:
    """A4: an empty typed frame; it flows through every operator unchanged."""
    return spark.createDataFrame([], POSTING_SCHEMA)


def read_parts(spark: SparkSession, path: str, schema: T.StructType | None = None) -> tuple[DataFrame, list[str]]:
    """The rows of a Parquet folder's readable files, written once, and the files left out.

    Files that fail while tasks read them are skipped. Which ones is told by the files that
    gave rows; only the others (empty or broken) are opened again, one by one.
    """
    reader = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    found = (reader.schema(schema) if schema else reader).parquet(path)
    kept = cut_lineage(found.select("*", F.col("_metadata.file_path").alias("_file")))
    gave = {r[0] for r in kept.select("_file").distinct().collect()}
    name = lambda x: x.rsplit("/", 1)[-1]
    silent = [x for x in found.inputFiles() if name(x) not in {name(y) for y in gave}]
    broken = []
    for file in silent:
        try:
            spark.read.schema(found.schema).parquet(file).write.format("noop").mode("overwrite").save()
        except Exception as exc:  # noqa: BLE001 - any reading error makes it a broken file
            log.warning("file skipped: %s: %s", file, exc)
            broken.append(file)
    return kept.drop("_file"), broken


def source_isolation(spark: SparkSession, loaders) -> tuple[DataFrame, list[str]]:
    """A3: run each source on its own; one that fails contributes zero rows, the others go on.

    ``loaders`` are callables returning DataFrames, or pairs (DataFrame, files left out) as
    ``read_parts`` gives them. Every source is written once in the shared folder, so a
    failure while its tasks run (a damaged file, a bad cast) ends with this source, as a
    missing path does; a source's rows are all there or none of them. Returns the union and
    an error text for every source that was skipped and every file left out.
    """
    frames, errors = [], []
    for number, load in enumerate(loaders):
        try:
            found = load()
            found, left_out = found if isinstance(found, tuple) else (found, [])
            frames.append(cut_lineage(found))
            errors += [f"source {number}: file left out: {x}" for x in left_out]
        except Exception as exc:  # noqa: BLE001 - any source error isolates that source
            log.warning("source %d skipped: %s", number, exc)
            errors.append(f"source {number}: {exc}")
    return (union_sources(frames) if frames else union_sources([empty_postings(spark)])), errors


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """A2: concatenate sources by column name; missing columns become null.

    ``source_no`` numbers the frames. ``(source_no, seq)`` is the key of a posting from
    here on and its place in arrival order, since ``seq`` is unique within a source only.
    """
    out = None
    for number, frame in enumerate(frames):
        indexed = frame.drop("source_no").withColumn("source_no", F.lit(number))
        out = indexed if out is None else out.unionByName(indexed, allowMissingColumns=True)
    return out


def site_filter(site_col: str = "site", sites=SCRAPE_SITES):
    return F.lower(F.col(site_col)).isin(*sites)


class FrameSource:
    """A frame of postings as a source for the scan."""

    def __init__(self, postings: DataFrame):
        self.postings = postings

    def kept(self, oldest_hours: int | None, sites, as_of: str) -> DataFrame:
        """The postings of the sites, without those older than any search asks for."""
        kept = self.postings.where(site_filter(sites=sites))
        return kept if oldest_hours is None else kept.where(D.recency(F.col("posted_at"), F.lit(oldest_hours), as_of))

    def words(self, oldest_hours: int | None, sites, as_of: str) -> M.Words:
        return M.FrameWords(self.kept(oldest_hours, sites, as_of))

    def rows(self, picked: DataFrame) -> DataFrame:
        """The postings with the keys in ``picked``."""
        return self.postings.join(picked.select(*KEYS).distinct(), list(KEYS), "left_semi")


def posting_scan(postings, grid: DataFrame, as_of: str, sites=SCRAPE_SITES) -> DataFrame:
    """A1: the grid's columns and ``source_no, seq, posted_at`` of every cell's postings.

    ``postings`` is a frame or a source (``FrameSource``, ``store.PostingStore``). Cells
    that ask for the same (term, country, remote flag, age) are one class. Terms meet
    postings through their words (``matching``), then the classes on term and country. Of a
    class with more hits than its cells' quotas only rows near the quota are sorted
    (``first_rows``); their positions are counted by a distributed sort, and the classes expand
    to their cells, each with its own quota; a null quota takes all. A limited search
    therefore never cuts an unlimited one, and a posting counts towards a quota only if it
    matches.
    """
    source = FrameSource(postings) if isinstance(postings, DataFrame) else postings
    cells = D.with_search_terms(grid, F.col("term"), F.col("filter_words")) if "term_norm" not in grid.columns else grid
    shape = ["term_norm", "country", "remote_search", "hours_old"]
    cells = cells.withColumn("_class", F.to_json(F.struct(*shape)))
    limit = F.when(F.bool_or(F.col("quota").isNull()), F.lit(None)).otherwise(F.max("quota")).cast("long")
    asked, told = cut_lineage(
        cells.groupBy("_class", *shape).agg(F.any_value("tokens").alias("tokens"), limit.alias("limit")).withColumn("_class_no", F.monotonically_increasing_id()),
        {"ageless": F.count_if(F.col("hours_old").isNull()), "most": F.max("hours_old"), "empty": F.count_if(F.col("term_norm") == "")})
    # from here on numbers stand for classes and terms: the rows of hits carry no text
    terms = cut_lineage(asked.select("term_norm").distinct().withColumn("_term", F.monotonically_increasing_id()))
    classes = cut_lineage(asked.drop("_class").join(terms, "term_norm"))
    # a literal bound lets readers skip partitions and row groups
    oldest = None if told["ageless"] or told["most"] is None else int(told["most"])
    found = M.term_matches(source.words(oldest, sites, as_of), classes, as_of)
    if told["empty"]:  # the empty term is in every description that is not empty
        every = source.kept(oldest, sites, as_of).where(X.normalize_text("description") != "").select(*KEYS, *M.FACTS)
        found = found.union(every.withColumn("_term", F.lit(terms.where("term_norm = ''").first()["_term"])))
    fits = D.recency(F.col("posted_at"), F.col("hours_old"), as_of) & (~F.col("remote_search") | F.coalesce("is_remote", F.lit(False)))
    hits = found.distinct().join(classes.drop("tokens", "term_norm"), ["_term", "country"]).where(fits).select("_class_no", "limit", *KEYS, "posted_at")
    ranked = positions(first_rows(hits, "_class_no", list(KEYS), "limit"), "_class_no", list(KEYS), "_at", cheap=True).where("limit is null or _at <= limit").drop("limit")
    numbered = cells.join(asked.select("_class", "_class_no"), "_class").drop("_class")
    return ranked.join(numbered, "_class_no").where(F.col("quota").isNull() | (F.col("_at") <= F.col("quota"))).drop("_class_no", "_at")
