"""Adapter views: the driver's tables seen as postings, CV pages, upload logs and replies.

The same rules are written in DuckDB SQL in ``jobsift.plans.oracle`` so both engines
read identical inputs. Only the columns each view needs are selected, so the scans
prune the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.functions.text import normalize_text
from jobsift.session import spread
from jobsift.sources.scan import union_sources

AS_OF = "2024-02-01"

# --- fixed values of the fixture views (FIXTURES.md §3) ----------------------
SITES_BY_MOD4 = ("LinkedIn", "indeed", "Glassdoor", "other board")
LOCATIONS_BY_MOD8 = ("Brazil", "remote", " Remoto ", "Remote Ireland", " USA ", "uk", "United States", "irlanda")
COUNTRIES_BY_MOD6 = ("usa", "uk", "ireland", "brazil", "brazil", "brazil")
JOB_TITLES = ("ther", "Ther thou", "de la", "thre", "Engenheiro", "erin, thon", "Que la", "thou and the")
# ---------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` as it is now."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(values: tuple[str, ...], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def posting_view(docs: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """raw_postings from documents: one posting per document, seq = doc_id."""
    i = F.col("doc_id")
    n = (i % 20 + 1).cast("string")
    posted_at = F.timestamp_seconds(F.unix_seconds(F.to_timestamp(F.lit(as_of))) - (i % 720) * 3600)
    kind = i % 8
    date_posted = (
        F.when(kind == 0, F.concat(n, F.lit(" days ago")))
        .when(kind == 1, F.concat(n, F.lit(" semanas")))
        .when(kind == 2, F.concat(n, F.lit(" meses")))
        .when(kind == 3, F.concat(F.lit("há "), n, F.lit(" dias")))
        .when(kind == 4, F.date_format(posted_at, "yyyy-MM-dd"))
        .when(kind == 5, F.date_format(posted_at, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(kind == 6, F.date_format(posted_at, "dd/MM/yyyy"))
        .otherwise(F.lit("N/A"))
    )
    return docs.select(
        i.alias("seq"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("source").alias("company"),
        F.md5("text").alias("job_url"),
        F.col("text").alias("description"),
        F.when(i % 5 == 0, F.concat(F.lit("Remote "), F.upper("lang"))).otherwise(F.upper("lang")).alias("location"),
        _pick(COUNTRIES_BY_MOD6, i % 6).alias("country"),
        (i % 7 == 0).alias("is_remote"),
        _pick(SITES_BY_MOD4, i % 4).alias("site"),
        date_posted.alias("date_posted"),
        posted_at.alias("posted_at"),
    )


def raw_postings(spark: SparkSession, sf_dir: str, as_of: str = AS_OF) -> DataFrame:
    """The postings as the only source (number 0), dealt out where they are one split."""
    return union_sources([posting_view(spread(table(spark, sf_dir, "documents"), "doc_id"), as_of)])


def page_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second source: web pages. Title from <title>, company = host of the url."""
    p = table(spark, sf_dir, "pages")
    return p.select(
        F.col("page_id").alias("seq"),
        F.regexp_extract("html", r"<title>(.*?)</title>", 1).alias("title"),
        F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1).alias("company"),
        F.col("url").alias("job_url"),
        F.col("html").alias("description"),
    )


def cv_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CV pages from conversations: one CV per conversation, one page per turn."""
    c = table(spark, sf_dir, "conversations")
    cid = F.col("conv_id")
    ext = F.when(cid % 5 == 0, F.lit(".txt")).when(cid % 2 == 0, F.lit(".PDF")).otherwise(F.lit(".pdf"))
    return c.select(
        cid.alias("cv_id"),
        F.lit(0).alias("file_no"),
        F.concat(F.lit("cv"), cid.cast("string"), ext).alias("file_name"),
        F.col("turn").cast("int").alias("page_no"),
        F.col("text"),
    )


def cv_upload_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B5 log from events: error = clear, view = blank upload, else upload of props."""
    e = table(spark, sf_dir, "events")
    t = F.col("event_type")
    return e.select(
        F.col("user_id"),
        F.col("ts"),
        F.col("event_id"),
        F.when(t == "error", F.lit("clear")).otherwise(F.lit("upload")).alias("action"),
        F.when(t == "error", F.lit(None).cast("string")).when(t == "view", F.lit("")).otherwise(F.col("props")).alias("text"),
    )


def skill_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1 dictionary (skill, kind): every two words that follow each other in a conversation's
    normalised text; hard where their length is even, domain otherwise."""
    words = table(spark, sf_dir, "conversations").select(F.split(normalize_text("text"), " ").alias("_words"))
    runs = F.transform(F.slice("_words", 2, F.greatest(F.size("_words"), F.lit(1))), lambda w, i: F.concat_ws(" ", F.get("_words", i), w))
    return (words.select(F.explode(runs).alias("skill")).distinct()
            .withColumn("kind", F.when(F.length("skill") % 2 == 0, F.lit("hard")).otherwise(F.lit("domain"))))


# --- fixed values: reply cases of SURVEY §2.8.2 chosen by doc_id % 8 ----------
# search 1 holds the two aborting cases (a non-object reply, a rate-limit error);
# searches 2 and 3 get a benign reply in their place.
def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies per (search, posting) covering every case of the reply table."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    k = i % 8
    sid = i % 3 + 1
    score = (F.col("n_chars") % 101).cast("string")
    reply = (
        F.when(k == 0, F.concat(F.lit('{"score": '), score, F.lit(', "rationale": "ok '), F.col("source"), F.lit('"}')))
        .when(k == 1, F.concat(F.lit('{"score": '), score, F.lit(".5}")))
        .when(k == 2, F.lit("not json"))
        .when((k == 3) & (sid == 1), F.lit("[1, 2]"))
        .when(k == 3, F.concat(F.lit('{"score": '), score, F.lit("}")))
        .when(k == 4, F.lit('{"rationale": "sem nota"}'))
        .when(k == 5, F.lit('{"score": null, "rationale": "nula"}'))
        .when(k == 6, F.concat(F.lit('{"score": "'), score, F.lit('"}')))
        .otherwise(F.lit(None).cast("string"))
    )
    error = F.when((k == 7) & (sid == 1), F.lit("Error code: 429 - Too Many Requests")).when(k == 7, F.lit("connection reset"))
    return d.select(sid.cast("long").alias("search_id"), i.alias("seq"), reply.alias("reply"), error.alias("error"))


def search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw search forms, one for each user turn of a conversation (strings, some missing or bad).

    search_id = conv_id * 1000 + turn, user_id = conv_id. Terms come from a list of job
    titles, as many users search for the same ones; the other fields follow fixed rules
    on the ids and the text, some counts negative.
    """
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    cid, turn = F.col("conv_id"), F.col("turn")
    count = (10 + F.length("text") % 50).cast("string")
    return c.select(
        (cid * 1000 + turn).alias("search_id"),
        cid.alias("user_id"),
        F.when(turn % 7 == 3, F.lit(None).cast("string")).otherwise(_pick(JOB_TITLES, (cid * 3 + turn) % 8)).alias("term_raw"),
        F.when(cid % 4 == 0, F.lit(None).cast("string")).when(cid % 4 == 3, F.lit("alto"))
        .otherwise((F.length("text") % 101).cast("string")).alias("min_score_raw"),
        F.when(cid % 3 == 0, F.lit(None).cast("string")).when(cid % 3 == 1, F.lit("")).otherwise(F.lit("the, and")).alias("filter_words_raw"),
        F.when((cid + turn) % 9 == 8, F.lit(None).cast("string")).otherwise(_pick(LOCATIONS_BY_MOD8, (cid + turn) % 8)).alias("location_raw"),
        F.when(turn % 5 == 0, F.lit(None).cast("string")).when((turn % 5 == 4) & (cid % 2 == 0), F.lit("12x"))
        .when(turn % 5 == 4, F.concat(F.lit("-"), count)).otherwise(count).alias("results_wanted_raw"),
        F.when(cid % 6 == 0, F.lit(None).cast("string")).otherwise((24 * (1 + cid % 14)).cast("string")).alias("hours_old_raw"),
        F.when(cid % 4 == 1, F.lit("")).when(cid % 4 == 3, F.substring_index("text", "\n", 1))
        .otherwise(F.lit(None).cast("string")).alias("google_term_raw"),
    )


def expansion_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term-expansion reply for each search: the whole text of the assistant's next turn."""
    c = table(spark, sf_dir, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn")
    a = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return u.join(a, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("search_id"), "reply")


def title_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reply that the search pipelines use: two related job titles, for two searches in three."""
    c = table(spark, sf_dir, "conversations").where((F.col("role") == "user") & ((F.col("conv_id") + F.col("turn")) % 3 != 0))
    k = F.col("conv_id") * 3 + F.col("turn")
    reply = F.concat(_pick(JOB_TITLES, (k + 1) % 8), F.lit(", "), F.upper(_pick(JOB_TITLES, (k + 3) % 8)))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("search_id"), reply.alias("reply"))


def answers(listed: DataFrame) -> DataFrame:
    """Model answers for listed postings: every case of the reply table, aborts for one search in seven."""
    n = F.col("search_id") + F.col("seq")
    aborted = F.col("search_id") % 7 == 0
    score = (n % 101).cast("string")
    reply = (
        F.when(aborted & (n % 5 == 0), F.lit("[1, 2]"))
        .when(n % 6 == 0, F.concat(F.lit('{"score": '), score, F.lit(', "rationale": "ok"}')))
        .when(n % 6 == 1, F.concat(F.lit('{"score": '), score, F.lit(".5}")))
        .when(n % 6 == 2, F.lit("not json"))
        .when(n % 6 == 3, F.lit('{"score": true, "rationale": "sim"}'))
        .when(n % 6 == 4, F.lit('{"score": null}'))
    )
    error = F.when(aborted & (n % 5 == 1), F.lit("Rate limit reached")).when(n % 6 == 5, F.lit("timeout"))
    return listed.select("search_id", "source_no", "seq", reply.alias("reply"), error.alias("error")).distinct()
