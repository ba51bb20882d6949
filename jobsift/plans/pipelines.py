"""Pipelines (L1-L3): compositions of the operators for many searches at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsift.functions import text as X
from jobsift.operators import cv as B
from jobsift.operators import dedup as E
from jobsift.operators import plan as A
from jobsift.operators import project as G
from jobsift.operators import rank as I
from jobsift.operators import relevance as D
from jobsift.operators import scoring as H
from jobsift.sources import scan as S

NARROW = ["search_id", "term_no", "loc_no", "source_no", "seq", "title", "company", "link", "fingerprint",
          "valid", "missing_word", "relevant", "candidate"]
ROW = ["search_id", "term_no", "loc_no", "source_no", "seq"]
NUMBERS = {"link": "_link_no", "fingerprint": "_fingerprint_no"}

# --- fixed values of the legacy intake (must equal the reference) --------------
LEGACY_SITES = ("google", "linkedin", "indeed")
LEGACY_HOURS = 336
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class SearchSpec:
    """One search request (the form of the reference); None lifts a limit."""
    term: str
    filter_words: str = ""
    location: str = "Brazil"
    results_wanted: int | None = 30
    hours_old: int | None = 24
    min_score: int = 80


SPEC_SCHEMA = T.StructType([
    T.StructField("search_id", T.LongType()),
    T.StructField("term", T.StringType()),
    T.StructField("filter_words", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("results_wanted", T.IntegerType()),
    T.StructField("hours_old", T.IntegerType()),
    T.StructField("min_score", T.IntegerType()),
    T.StructField("form_ok", T.BooleanType()),
])


def spec_frame(spark: SparkSession, specs: list[SearchSpec]) -> DataFrame:
    rows = [(i + 1, s.term, s.filter_words, s.location, s.results_wanted, s.hours_old, s.min_score, True) for i, s in enumerate(specs)]
    return spark.createDataFrame(rows, SPEC_SCHEMA)


def grid_of(searches: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """A5-A12 for a table of searches, written once: the scan, the de-duplication and the
    reports all start from it."""
    return E.cut_lineage(A.plan_searches(searches, replies))


def annotate_rows(rows: DataFrame) -> DataFrame:
    """C1/C3/C4/C5 + D1-D6 flags for every (cell, posting) row."""
    return D.annotate(D.with_norms(rows))


@dataclass(frozen=True)
class Intake:
    """What an intake leaves: every row's label, the approved rows, the postings picked."""
    labelled: DataFrame
    keys: DataFrame
    cells: DataFrame
    postings: DataFrame

    @property
    def approved(self) -> DataFrame:
        return self.wide(self.keys)

    def wide(self, keys: DataFrame) -> DataFrame:
        """Approved rows, given by their keys, with their cell's and their posting's fields."""
        rows = self.postings.drop("title_norm", "desc_norm", "company_norm", "fingerprint")
        return keys.join(self.cells, ["search_id", "term_no", "loc_no"]).join(rows, list(S.KEYS))


def _in_order(rows: DataFrame, name: str, number: str) -> DataFrame:
    """(name, number) of the distinct values of a column, numbered in their order, with gaps."""
    return E.cut_lineage(rows.select(name).where(F.col(name).isNotNull()).distinct().orderBy(name).withColumn(number, F.monotonically_increasing_id()))


def intake(postings, grid: DataFrame, as_of: str) -> Intake:
    """L2 core for every cell of ``grid`` (A1 -> E5), over a frame of postings or a source.

    Texts are normalised per posting: once to match terms, and once for the postings that
    a cell took, which are written with their norms. Cells then meet them on the key.
    Numbers in the order of the links and fingerprints stand for these in the
    de-duplication, whose rows are one a cell and posting.
    """
    cells = D.with_search_terms(grid, F.col("term"), F.col("filter_words"))
    picked = E.cut_lineage(S.posting_scan(postings, cells, as_of))
    source = S.FrameSource(postings) if isinstance(postings, DataFrame) else postings
    normed = E.cut_lineage(D.with_norms(source.rows(picked)))
    facts = normed.drop("description", "location", "country", "is_remote", "site", "date_posted", "posted_at")
    for name, number in NUMBERS.items():
        facts = facts.join(_in_order(normed, name, number), name, "left")
    narrow = E.cut_lineage(D.annotate(picked.drop("posted_at").join(facts, list(S.KEYS))).select(*NARROW, *NUMBERS.values()))
    approved, _ = E.greedy_two_key(narrow.where("candidate").select(*ROW, *NUMBERS.values()), link=NUMBERS["link"], fp=NUMBERS["fingerprint"])
    labelled = E.label(narrow, approved, link=NUMBERS["link"], fp=NUMBERS["fingerprint"]).select(*NARROW, "disposition")
    return Intake(labelled, approved.select(*ROW), grid.select("search_id", "term_no", "loc_no", "remote_search"), normed)


def intake_pipeline(postings: DataFrame, grid: DataFrame, as_of: str) -> DataFrame:
    """L2: A1 -> E5 -> G1; the approved postings with their 7 fields."""
    return G.posting_projection(intake(postings, grid, as_of).approved, as_of)


def legacy_pipeline(postings: DataFrame, term: str, as_of: str, modifiers=D.ROLE_MODIFIERS, degree_words=D.DEGREE_WORDS,
                    benefit_words=D.BENEFIT_WORDS, location: str = "Brazil", google_term: str | None = None,
                    hours_old: int | None = LEGACY_HOURS, results_wanted: int | None = None, sites=LEGACY_SITES) -> DataFrame:
    """L3: the legacy rules for one search; no de-duplication, no keyword filter.

    The source gives the first ``results_wanted`` postings (None: all) of its sites within
    the age limit; the rules then choose among them. The web-search phrase (A13) is what
    the reference hands to its search engine; it comes back as column ``phrase``.
    """
    chosen = postings.where(S.site_filter(sites=sites) & D.recency(F.col("posted_at"), F.lit(hours_old).cast("int"), as_of))
    if results_wanted is not None:
        if results_wanted < 0:
            raise ValueError("a result count is negative")
        first = I.positions(chosen.select(F.lit(0).alias("_all"), *S.KEYS), "_all", list(S.KEYS), "_at").where(F.col("_at") <= results_wanted)
        chosen = chosen.join(first.select(*S.KEYS), list(S.KEYS), "left_semi")
    tn = X.normalize_text_legacy(F.lit(term))
    rows = chosen.select("*", X.normalize_text_legacy("title").alias("_tl"), X.normalize_text_legacy("description").alias("_dl"))
    mod = D.role_modifier_exclusion(F.col("_tl"), tn, modifiers)
    deg = D.degree_proximity(F.col("_dl"), tn, degree_words)
    ben = D.benefit_proximity(F.col("_dl"), tn, benefit_words)
    ok = rows.where(D.legacy_approval(F.col("_tl"), tn, mod, deg, ben))
    phrase = A.default_phrase(F.lit(term), F.lit(location), F.lit(google_term).cast("string"))
    return G.posting_projection_legacy(ok, as_of).withColumn("phrase", phrase)


@dataclass(frozen=True)
class Batch:
    """Searches ready to be scored: the listed postings, their texts and the users' CVs."""
    listed: DataFrame
    jobs: DataFrame
    cvs: DataFrame


def user_cvs(pages: DataFrame, upload_log: DataFrame) -> DataFrame:
    """The CV that each user searches with."""
    return B.cv_required(B.cv_effective(B.cv_uploads(pages), B.cv_store_update(upload_log)))


def search_batch(postings: DataFrame, cvs: DataFrame, searches: DataFrame, replies: DataFrame | None, as_of: str) -> Batch:
    """A -> B -> C -> D -> E -> I1: every accepted search of a user with a CV, expanded,
    scanned, de-duplicated and cut to its result count.

    ``searches`` are typed forms with ``user_id``; each belongs to one user, so each listed
    posting is scored against one CV.
    """
    cvs = E.cut_lineage(cvs)
    mine = searches.join(cvs.select("user_id"), "user_id", "left_semi")
    done = intake(postings, grid_of(mine, replies), as_of)
    wanted = mine.where("form_ok").select("search_id", "user_id", "results_wanted", "min_score")
    # the limit is taken on keys; only the rows it leaves are projected
    first = I.prefix_limit(done.keys.join(wanted.select("search_id", "results_wanted"), "search_id")).select(*ROW)
    listed = E.cut_lineage(G.posting_projection(done.wide(first), as_of).drop("description").join(wanted, "search_id"))
    jobs = (done.postings.join(listed.select(*S.KEYS).distinct(), list(S.KEYS), "left_semi")
            .select(*S.KEYS, X.scoring_text(F.col("description"), F.col("title")).alias("job_text")))
    return Batch(listed, E.cut_lineage(jobs), cvs)


def score_batch(batch: Batch, skills=H.FIXTURE_SKILLS, levels=H.FIXTURE_LEVELS) -> DataFrame:
    """H1/H2: the listed postings of each search against its user's CV."""
    pairs = batch.listed.withColumn("cv_id", F.col("user_id"))
    cvs = batch.cvs.select(F.col("user_id").alias("cv_id"), "cv_text")
    return H.rubric_score(pairs, cvs, batch.jobs, skills, levels, job_key=S.KEYS).drop("cv_id")


RESULT = ["user_id", "search_id", "rank", "term_no", "loc_no", "source_no", "seq", "title", "company", "location", "link", "source",
          "published_at", "score", "rationale"]


def ranked_results(scored: DataFrame) -> DataFrame:
    """D11 -> I2: the results each search shows."""
    return I.rank_by_score(scored.where(D.score_threshold(F.col("score"), F.col("min_score")))).select(*RESULT)


def search_pipeline(postings: DataFrame, pages: DataFrame, upload_log: DataFrame, searches: DataFrame, replies: DataFrame | None,
                    as_of: str, skills=H.FIXTURE_SKILLS, levels=H.FIXTURE_LEVELS) -> DataFrame:
    """L1 (flagship): every search of every user, scored by the rubric and ranked."""
    return ranked_results(score_batch(search_batch(postings, user_cvs(pages, upload_log), searches, replies, as_of), skills, levels))


def replied_pipeline(batch: Batch, answers: DataFrame) -> DataFrame:
    """L1 with the scores of a batch inference job: ``answers(search_id, source_no, seq,
    reply, error)``. H3-H7 replace H1; an abort voids its whole search, as in the
    reference, and a posting without an answer counts as failed."""
    keys = ["search_id", *S.KEYS]
    asked = batch.listed.select(*keys).distinct().join(answers, keys, "left")
    kept = H.batch_abort(H.parse_reply(asked))
    scored = H.attach_scores(batch.listed.join(kept.select("search_id").distinct(), "search_id", "left_semi"), kept.drop("status"), keys)
    return ranked_results(scored)
