"""Registered queries: one callable per operator key of the blueprint.

Each callable takes (spark, sf_dir) and returns a DataFrame over the whole tables
(adapter views of ``jobsift.sources.fixtures``). Column names match the DuckDB
oracle in ``jobsift.plans.oracle``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.functions import dates as DT
from jobsift.functions import text as X
from jobsift.operators import cv as B
from jobsift.operators import dedup as E
from jobsift.operators import plan as A
from jobsift.operators import project as G
from jobsift.operators import rank as I
from jobsift.operators import relevance as D
from jobsift.operators import report as J
from jobsift.operators import scoring as H
from jobsift.plans import pipelines as L
from jobsift.sources import fixtures as V
from jobsift.session import ensure_checkpoint_dir
from jobsift.sources import scan as S
from jobsift.sources.store import PostingStore
from jobsift.streaming import sinks as K
from jobsift.streaming.cvs import CvStore
from jobsift.streaming.seen import SeenKeys, dedup_batch

# --- fixed values of the fixture searches (FIXTURES.md §4) --------------------
AS_OF = V.AS_OF
TERM = "ther"
KEYWORDS = "thou"
TERM2 = "ther thou"
TERM3 = "de la"
FIXTURE_WORDS = ("the", "of", "and")
SPECS = (
    L.SearchSpec(TERM, KEYWORDS, "Brazil", 30, 720, 50),
    L.SearchSpec(TERM2, "", "remote", 30, 168, 40),
    L.SearchSpec(TERM3, "", "Remote Ireland", 30, 720, 60),
)
UNLIMITED = L.SearchSpec(TERM, "", "Brazil", None, 720, 0)
LEGACY_RESULTS = 200
REPLY_MIN_SCORE = 50
# ---------------------------------------------------------------------------

Query = Callable[[SparkSession, str], DataFrame]


# --- shared building blocks --------------------------------------------------

def _single(spark, sf_dir, term=TERM, filter_words=KEYWORDS) -> DataFrame:
    """Every posting under one search (scope search 1, term 0, location 0), annotated."""
    p = V.raw_postings(spark, sf_dir)
    rows = p.select(F.lit(1).cast("long").alias("search_id"), F.lit(0).alias("term_no"), F.lit(0).alias("loc_no"), "*")
    return D.annotate(D.with_norms(D.with_search_terms(rows, term, filter_words)))


def _labelled(spark, sf_dir) -> DataFrame:
    a = _single(spark, sf_dir).select(*L.NARROW)
    return E.dedup_two_key(E.cut_lineage(a))


def _spec_grid(spark, specs, replies=None) -> DataFrame:
    return L.grid_of(L.spec_frame(spark, list(specs)), replies)


def _single_grid(spark, term=TERM, filter_words=KEYWORDS):
    return _spec_grid(spark, [L.SearchSpec(term, filter_words, "Brazil", None, None, 0)])


def _searches(spark, sf_dir) -> DataFrame:
    return A.form_defaults(V.search_requests(spark, sf_dir))


def _planned(spark, sf_dir) -> DataFrame:
    return A.with_terms(_searches(spark, sf_dir), V.expansion_replies(spark, sf_dir))


def _quotas(spark, sf_dir) -> DataFrame:
    return A.with_quota(_planned(spark, sf_dir)).select("search_id", "n_terms", "quota", "location")


def _locations(spark, sf_dir) -> DataFrame:
    return A.resolve_country(A.expand_locations(_quotas(spark, sf_dir)))


def _parsed_replies(spark, sf_dir) -> DataFrame:
    return H.parse_reply(V.replies(spark, sf_dir))


def _cvs(spark, sf_dir) -> DataFrame:
    return L.user_cvs(V.cv_pages(spark, sf_dir), V.cv_upload_log(spark, sf_dir))


def _batch(spark, sf_dir) -> L.Batch:
    return L.search_batch(V.raw_postings(spark, sf_dir), _cvs(spark, sf_dir), _searches(spark, sf_dir), V.title_replies(spark, sf_dir), AS_OF)


def _two_sources(spark, sf_dir) -> list[DataFrame]:
    return [V.posting_view(V.table(spark, sf_dir, "documents")).select("seq", "title", "company", "job_url"),
            V.page_postings(spark, sf_dir).select("seq", "title", "company", "job_url")]


# --- A: sources, planning, search grid -----------------------------------------

def _store(spark, sf_dir) -> PostingStore:
    """A store of all postings, made by two extensions."""
    store = PostingStore(spark, f"{ensure_checkpoint_dir(spark)}/postings-{uuid.uuid4().hex}")
    postings = V.raw_postings(spark, sf_dir)
    for half in range(2):
        store.extend(postings.where(F.col("seq") % 2 == half))
    return store


def q_posting_scan(spark, sf_dir):
    """A1 on the stored index: no text is read."""
    scanned = S.posting_scan(_store(spark, sf_dir), _spec_grid(spark, (*SPECS, UNLIMITED)), AS_OF)
    return scanned.select("search_id", "term_no", "loc_no", "source_no", "seq")


def q_expanded_scan(spark, sf_dir):
    """A1 for every search form, expanded by the whole assistant turns: thousands of distinct terms."""
    grid = L.grid_of(_searches(spark, sf_dir), V.expansion_replies(spark, sf_dir))
    return S.posting_scan(V.raw_postings(spark, sf_dir), grid, AS_OF).select("search_id", "term_no", "loc_no", "source_no", "seq")


def q_day_limited_scan(spark, sf_dir):
    """A1/D12 on the stored postings: the rows of searches limited to days, from those days' folders only."""
    store = _store(spark, sf_dir)
    grid = _spec_grid(spark, (L.SearchSpec(TERM, "", "Brazil", 30, 72, 0), L.SearchSpec(TERM2, "", "uk", None, 48, 0)))
    scanned = E.cut_lineage(S.posting_scan(store, grid, AS_OF))
    rows = store.rows(scanned).select(*S.KEYS, "title", "country", "posted_at")
    return scanned.select("search_id", "term_no", "loc_no", *S.KEYS).join(rows, list(S.KEYS))


def q_union_sources(spark, sf_dir):
    return S.union_sources(_two_sources(spark, sf_dir))


def _broken_folder(spark, sf_dir) -> str:
    """Pages as a Parquet folder, with a file that is none beside them."""
    path = f"{ensure_checkpoint_dir(spark)}/broken-{uuid.uuid4().hex}"
    V.page_postings(spark, sf_dir).select("seq", "title", "company", "job_url").write.parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/part-99999-broken.snappy.parquet")
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(b"PAR1 this is no Parquet file"))
    out.close()
    return path


def q_source_isolation(spark, sf_dir):
    """A3: two good sources, one without a table, one that fails while tasks run, and one read without its broken file."""
    documents, pages = _two_sources(spark, sf_dir)
    broken = _broken_folder(spark, sf_dir)
    failing = documents.withColumn("seq", F.col("job_url").cast("long"))    # a cast that no link survives
    loaders = [lambda: documents, lambda: V.table(spark, sf_dir, "no_such_source").select("seq", "title"), lambda: failing,
               lambda: pages, lambda: S.read_parts(spark, broken, pages.schema)]
    found, errors = S.source_isolation(spark, loaders)
    return found.withColumn("skipped", F.lit(len(errors)))


def q_empty_result(spark, sf_dir):
    """A search whose term no posting has, beside one with results, each with its counts."""
    grid = _spec_grid(spark, (L.SearchSpec("zzzz qqqq", "", "Brazil", 30, 720, 0), SPECS[0]))
    return J.disposition_counts(L.intake(V.raw_postings(spark, sf_dir), grid, AS_OF).labelled, grid)


def q_expand_terms(spark, sf_dir):
    return A.term_rows(_planned(spark, sf_dir), "expanded")


def q_parse_term_list(spark, sf_dir):
    return A.parse_term_list(V.expansion_replies(spark, sf_dir))


def q_distinct_terms_ordered(spark, sf_dir):
    return A.term_rows(A.distinct_terms(_planned(spark, sf_dir), "expanded", "distinct"), "distinct")


def q_cap_terms(spark, sf_dir):
    return A.term_rows(_planned(spark, sf_dir), "terms")


def q_term_quota(spark, sf_dir):
    return _quotas(spark, sf_dir).select("search_id", "n_terms", "quota")


def q_expand_locations(spark, sf_dir):
    return A.expand_locations(_quotas(spark, sf_dir)).drop("n_terms")


def q_resolve_country(spark, sf_dir):
    return _locations(spark, sf_dir).select("search_id", "loc_no", "loc", "country")


def q_search_grid(spark, sf_dir):
    grid = A.plan_searches(_searches(spark, sf_dir), V.expansion_replies(spark, sf_dir))
    return grid.select("search_id", "term_no", "term", "loc_no", "loc", "country", "remote_search", "quota")


def q_default_phrase(spark, sf_dir):
    r = V.search_requests(spark, sf_dir)
    f = A.form_defaults(r).join(r.select("search_id", "google_term_raw"), "search_id")
    return f.select("search_id", A.default_phrase(F.col("term"), F.col("location"), F.col("google_term_raw")).alias("phrase"))


def q_form_defaults(spark, sf_dir):
    return _searches(spark, sf_dir)


# --- B: CV intake -----------------------------------------------------------------

def q_cv_concat(spark, sf_dir):
    return B.cv_concat(B.cv_file_filter(V.cv_pages(spark, sf_dir)))


def q_cv_file_filter(spark, sf_dir):
    return B.cv_file_filter(V.cv_pages(spark, sf_dir)).select("cv_id", "file_name", "page_no")


def q_cv_effective(spark, sf_dir):
    pages = V.cv_pages(spark, sf_dir)
    return B.cv_effective(B.cv_uploads(pages), B.cv_store_update(V.cv_upload_log(spark, sf_dir)))


def q_cv_required(spark, sf_dir):
    return _cvs(spark, sf_dir).select("user_id", "cv_text")


def q_cv_store_update(spark, sf_dir):
    return B.cv_store_update(V.cv_upload_log(spark, sf_dir))


def q_cv_store_batches(spark, sf_dir):
    """B5 with the log in three batches that interleave in time: the CVs stored after them."""
    log = V.cv_upload_log(spark, sf_dir)
    store = CvStore(spark, f"{ensure_checkpoint_dir(spark)}/cvs-{uuid.uuid4().hex}")
    for n in range(3):
        store.add(log.where(F.coalesce(F.col("event_id") % 3, F.lit(0)) == n))
    return store.compact(f"{store.path}-whole").stored()


# --- C: text scalars ----------------------------------------------------------------

def q_normalize_text(spark, sf_dir):
    p = V.raw_postings(spark, sf_dir)
    return p.select("seq", X.normalize_text("title").alias("title_norm"), X.normalize_text("company").alias("company_norm"),
                    X.normalize_text("description").alias("desc_norm"))


def q_normalize_text_legacy(spark, sf_dir):
    p = V.raw_postings(spark, sf_dir)
    return p.select("seq", X.normalize_text_legacy("title").alias("title_legacy"), X.normalize_text_legacy("description").alias("desc_legacy"))


def q_fingerprint(spark, sf_dir):
    p = V.raw_postings(spark, sf_dir)
    return p.select("seq", X.fingerprint(X.normalize_text("title"), X.normalize_text("company")).alias("fingerprint"))


def q_term_tokens(spark, sf_dir):
    p = V.raw_postings(spark, sf_dir)
    return p.select("seq", F.array_join(X.term_tokens(X.normalize_text("title")), " ").alias("tokens"))


def q_required_words(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("seq"), F.array_join(X.required_words("text"), "|").alias("words"))


def q_truncate_cv(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("cv_id"), X.truncate_cv("text").alias("cv_text"))


def q_source_lower(spark, sf_dir):
    return V.raw_postings(spark, sf_dir).select("seq", X.source_lower("site").alias("source"))


def q_scoring_text(spark, sf_dir):
    return V.raw_postings(spark, sf_dir).select("seq", X.scoring_text(F.col("description"), F.col("title")).alias("job_text"))


def q_request_text(spark, sf_dir):
    """The scoring request of every listed posting with its searcher's CV."""
    b = _batch(spark, sf_dir)
    pairs = b.listed.select("user_id", "search_id", "term_no", "loc_no", "source_no", "seq").join(b.jobs, list(S.KEYS)).join(b.cvs, "user_id")
    body = X.request_text(F.col("cv_text"), F.col("job_text"))
    return pairs.select("user_id", "search_id", "term_no", "loc_no", "seq", body.alias("body"))


# --- D: filters ---------------------------------------------------------------------

def q_valid_posting(spark, sf_dir):
    u = q_union_sources(spark, sf_dir)
    return u.select("source_no", "seq", D.valid_posting("title", "job_url").alias("valid"))


def q_required_keywords(spark, sf_dir):
    a = _single(spark, sf_dir)
    return a.select("seq", D.required_keywords(F.col("words"), F.col("title_norm"), F.col("desc_norm")).alias("kw_ok"))


def q_first_missing_keyword(spark, sf_dir):
    a = _single(spark, sf_dir, TERM, "thou, thre")
    return a.select("seq", "missing_word")


def q_title_any_token(spark, sf_dir):
    return _single(spark, sf_dir, TERM2, "").select("seq", "in_title")


def q_desc_whole_phrase(spark, sf_dir):
    return _single(spark, sf_dir, TERM3, "").select("seq", "in_desc")


def q_relevance(spark, sf_dir):
    return _single(spark, sf_dir, TERM, "").where("relevant").select("seq", "title")


def _legacy_flags(spark, sf_dir):
    p = V.raw_postings(spark, sf_dir)
    tn = X.normalize_text_legacy(F.lit(TERM))
    rows = p.select("seq", X.normalize_text_legacy("title").alias("tl"), X.normalize_text_legacy("description").alias("dl"))
    return rows.select(
        "seq", "tl",
        D.role_modifier_exclusion(F.col("tl"), tn, FIXTURE_WORDS).alias("excluded"),
        D.degree_proximity(F.col("dl"), tn, FIXTURE_WORDS).alias("degree"),
        D.benefit_proximity(F.col("dl"), tn, FIXTURE_WORDS).alias("benefit"),
    )


def q_role_modifier_exclusion(spark, sf_dir):
    return _legacy_flags(spark, sf_dir).select("seq", "excluded")


def q_degree_proximity(spark, sf_dir):
    return _legacy_flags(spark, sf_dir).select("seq", "degree")


def q_benefit_proximity(spark, sf_dir):
    return _legacy_flags(spark, sf_dir).select("seq", "benefit")


def q_legacy_approval(spark, sf_dir):
    f = _legacy_flags(spark, sf_dir)
    tn = X.normalize_text_legacy(F.lit(TERM))
    return f.select("seq", D.legacy_approval(F.col("tl"), tn, F.col("excluded"), F.col("degree"), F.col("benefit")).alias("approved"))


def q_score_threshold(spark, sf_dir):
    p = _parsed_replies(spark, sf_dir)
    return p.select("search_id", "seq", D.score_threshold(F.col("score"), F.lit(REPLY_MIN_SCORE)).alias("passed"))


def q_recency(spark, sf_dir):
    p = V.raw_postings(spark, sf_dir)
    return p.where(D.recency(F.col("posted_at"), F.lit(24), AS_OF)).select("seq", "posted_at")


# --- E: de-duplication ----------------------------------------------------------------

def q_dedup_link(spark, sf_dir):
    a = _single(spark, sf_dir).select("search_id", "term_no", "loc_no", "source_no", "seq", "link")
    return E.first_per_key(a, "link").select("seq", "link")


def q_dedup_fingerprint(spark, sf_dir):
    a = _single(spark, sf_dir).select("search_id", "term_no", "loc_no", "source_no", "seq", "fingerprint")
    return E.first_per_key(a, "fingerprint").select("seq", "fingerprint")


def q_dedup_two_key(spark, sf_dir):
    return _labelled(spark, sf_dir).where(F.col("disposition") == E.APPROVED).select("seq", "link", "fingerprint")


def _scope_grid(spark):
    replies = spark.createDataFrame([(1, TERM2)], "search_id long, reply string")
    return _spec_grid(spark, [L.SearchSpec(TERM, KEYWORDS, "remote", None, None, 0)], replies)


def q_dedup_scope(spark, sf_dir):
    labelled = L.intake(V.raw_postings(spark, sf_dir), _scope_grid(spark), AS_OF).labelled
    return labelled.where(F.col("disposition") == E.APPROVED).select("term_no", "loc_no", "seq")


def q_dedup_batches(spark, sf_dir):
    """E3/E4 with the intake in three batches, one a location: every row's label."""
    rows = L.intake(V.raw_postings(spark, sf_dir), _scope_grid(spark), AS_OF).labelled.select(*L.NARROW)
    seen = SeenKeys(spark, f"{ensure_checkpoint_dir(spark)}/seen-{uuid.uuid4().hex}")
    done = [dedup_batch(rows.where(F.col("loc_no") == n), seen, n) for n in range(3)]
    return done[0].unionByName(done[1]).unionByName(done[2]).select("term_no", "loc_no", "seq", "disposition")


def q_disposition(spark, sf_dir):
    return _labelled(spark, sf_dir).select("seq", "disposition")


# --- F: dates ---------------------------------------------------------------------------

def q_relative_date(spark, sf_dir):
    return V.raw_postings(spark, sf_dir).select("seq", DT.relative_date("date_posted", AS_OF).alias("rel_date"))


def q_format_date(spark, sf_dir):
    return V.raw_postings(spark, sf_dir).select("seq", DT.format_date("date_posted", AS_OF).alias("published_at"))


def q_format_date_legacy(spark, sf_dir):
    return V.raw_postings(spark, sf_dir).select("seq", DT.format_date_legacy("date_posted").alias("published_legacy"))


def q_created_stamp(spark, sf_dir):
    return V.raw_postings(spark, sf_dir).select("seq", DT.created_stamp(AS_OF).alias("created_at"))


# --- G: projections ---------------------------------------------------------------------

def q_posting_projection(spark, sf_dir):
    return L.intake_pipeline(V.raw_postings(spark, sf_dir), _single_grid(spark), AS_OF).drop("search_id", "term_no", "loc_no", "source_no")


def q_remote_location(spark, sf_dir):
    p = V.raw_postings(spark, sf_dir)
    return p.select("seq", G.remote_location(F.col("location"), F.lit(False), F.col("is_remote")).alias("location"))


def q_posting_projection_legacy(spark, sf_dir):
    return G.posting_projection_legacy(V.raw_postings(spark, sf_dir), AS_OF)


def q_source_class(spark, sf_dir):
    return V.raw_postings(spark, sf_dir).select("seq", G.source_class(X.source_lower("site")).alias("source_class"))


def q_source_label(spark, sf_dir):
    return V.raw_postings(spark, sf_dir).select("seq", G.source_label(X.source_lower("site")).alias("source_label"))


def q_card_labels(spark, sf_dir):
    p = _parsed_replies(spark, sf_dir).where(F.col("status") == "ok")
    pub = V.raw_postings(spark, sf_dir).select("seq", DT.format_date("date_posted", AS_OF).alias("published_at"))
    j = p.join(pub, "seq")
    s = F.col("score")
    shown = F.when(s == F.floor(s), s.cast("bigint").cast("string")).otherwise(s.cast("string"))
    pl, sl, rl = G.card_labels(F.col("published_at"), shown, F.col("rationale"))
    return j.select("search_id", "seq", pl.alias("published_label"), sl.alias("score_label"), rl.alias("rationale_label"))


# --- H: scoring --------------------------------------------------------------------------

def q_rubric_score(spark, sf_dir):
    scored = L.score_batch(_batch(spark, sf_dir))
    return scored.select("user_id", "search_id", "term_no", "loc_no", "seq", "hard", "level", "domain", "score", "rationale")


def q_rubric_dictionary(spark, sf_dir):
    """H1 with the skills as a table, of as many phrases as the conversations hold."""
    scored = L.score_batch(_batch(spark, sf_dir), V.skill_table(spark, sf_dir))
    return scored.select("user_id", "search_id", "term_no", "loc_no", "seq", "hard", "level", "domain", "score", "rationale")


def q_score_batch(spark, sf_dir):
    return L.score_batch(_batch(spark, sf_dir)).groupBy("user_id", "search_id").agg(
        F.count(F.lit(1)).alias("jobs"), F.min("score").alias("least"), F.max("score").alias("most"), F.sum("score").alias("total"))


def q_parse_reply(spark, sf_dir):
    return _parsed_replies(spark, sf_dir)


def q_reply_defaults(spark, sf_dir):
    return _parsed_replies(spark, sf_dir).where(F.col("status") == "ok").select("search_id", "seq", "score", "rationale")


def q_error_class(spark, sf_dir):
    r = V.replies(spark, sf_dir).where(F.col("error").isNotNull())
    return r.select("search_id", "seq", H.error_class(F.col("error")).alias("error_class"))


def q_batch_abort(spark, sf_dir):
    return H.batch_abort(_parsed_replies(spark, sf_dir)).select("search_id", "seq", "status", "score")


def q_attach_scores(spark, sf_dir):
    kept = H.batch_abort(_parsed_replies(spark, sf_dir)).select("search_id", "seq", "score", "rationale")
    p = V.raw_postings(spark, sf_dir).select(F.col("seq") % 3 + 1, "seq", "title").toDF("search_id", "seq", "title")
    return H.attach_scores(p, kept)


# --- I: sort, limit ------------------------------------------------------------------------

def q_prefix_limit(spark, sf_dir):
    return _batch(spark, sf_dir).listed.select("search_id", "term_no", "loc_no", "seq")


def q_rank_by_score(spark, sf_dir):
    ok = _parsed_replies(spark, sf_dir).where(F.col("status") == "ok")
    ranked = I.rank_by_score(ok)
    return ranked.select("search_id", "seq", "score", "rank")


def q_sample_per_disposition(spark, sf_dir):
    return I.sample_per_disposition(_labelled(spark, sf_dir)).select("disposition", "seq")


# --- J: reporting ---------------------------------------------------------------------------

def q_disposition_counts(spark, sf_dir):
    grid = _scope_grid(spark)
    return J.disposition_counts(L.intake(V.raw_postings(spark, sf_dir), grid, AS_OF).labelled, grid)


def q_log_line(spark, sf_dir):
    lab = _labelled(spark, sf_dir)
    line = J.log_line(F.col("company"), F.col("title"), F.col("disposition"), F.col("missing_word"), F.lit(TERM))
    return lab.select("seq", line.alias("log_line")).where(F.col("log_line").isNotNull())


def q_funnel(spark, sf_dir):
    scored = L.score_batch(_batch(spark, sf_dir))
    return J.funnel(scored.withColumn("passed", D.score_threshold(F.col("score"), F.col("min_score"))))


# --- K: sinks ---------------------------------------------------------------------------------

def _approved(spark, sf_dir) -> DataFrame:
    return G.posting_projection(L.intake(V.raw_postings(spark, sf_dir), _spec_grid(spark, (*SPECS, UNLIMITED)), AS_OF).approved, AS_OF)


def q_jobs_append_unique(spark, sf_dir):
    batch = E.cut_lineage(_approved(spark, sf_dir))
    stored = batch.where(F.col("search_id") == 1).select("link")
    return K.new_unique_rows(batch, stored, AS_OF).select(
        "link", "title", "company", "location", "source", "published_at", "applied", "created_at")


def q_jobs_reset(spark, sf_dir):
    """K2: a jobs table filled, emptied by a reset, and filled with the rows of one search."""
    path = f"{ensure_checkpoint_dir(spark)}/jobs-{uuid.uuid4().hex}"
    batch = E.cut_lineage(_approved(spark, sf_dir))
    K.append_unique(batch, path, AS_OF)
    K.jobs_init(spark, path, reset=True)
    K.append_unique(batch.where(F.col("search_id") == 2), path, AS_OF)
    return K.read_jobs(spark, path).select("link", "title", "applied")


def q_jobs_init(spark, sf_dir):
    """A jobs table made, filled by two appends that overlap, made again (kept) and read."""
    path = f"{ensure_checkpoint_dir(spark)}/jobs-{uuid.uuid4().hex}"
    batch = E.cut_lineage(_approved(spark, sf_dir))
    K.jobs_init(spark, path)
    K.append_unique(batch.where(F.col("search_id") <= 2), path, AS_OF)
    K.append_unique(batch, path, AS_OF)
    K.jobs_init(spark, path)
    jobs = K.read_jobs(spark, path)
    ids = jobs.select("id").distinct().withColumnRenamed("id", "_id")
    return jobs.join(ids, F.col("id") == F.col("_id")).select("link", "title", "description", "applied")


# --- L: pipelines -----------------------------------------------------------------------------

def q_search_pipeline(spark, sf_dir):
    return L.search_pipeline(V.raw_postings(spark, sf_dir), V.cv_pages(spark, sf_dir), V.cv_upload_log(spark, sf_dir),
                             _searches(spark, sf_dir), V.title_replies(spark, sf_dir), AS_OF)


def q_replied_pipeline(spark, sf_dir):
    batch = _batch(spark, sf_dir)
    return L.replied_pipeline(batch, V.answers(batch.listed)).drop("source_no")


def q_intake_pipeline(spark, sf_dir):
    return L.intake_pipeline(V.raw_postings(spark, sf_dir), _single_grid(spark), AS_OF).drop("search_id", "term_no", "loc_no", "source_no")


def q_legacy_pipeline(spark, sf_dir):
    return L.legacy_pipeline(V.raw_postings(spark, sf_dir), TERM, AS_OF, FIXTURE_WORDS, FIXTURE_WORDS, FIXTURE_WORDS,
                             results_wanted=LEGACY_RESULTS)


QUERIES: dict[str, Query] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}
