"""D1-D12 on the fixture view: measured counts, legacy rules, threshold properties."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from jobsift.functions import text as X
from jobsift.operators import relevance as D
from jobsift.plans import catalog as C
from jobsift.sources import fixtures as V


def test_fixture_counts(spark):
    a = C._single(spark, SF_SMALL)
    r = a.agg(
        F.count("*").alias("n"),
        F.count_if("in_title").alias("t"),
        F.count_if("in_desc").alias("d"),
        F.count_if("relevant").alias("rel"),
        F.count_if(F.col("relevant") & F.col("missing_word").isNull()).alias("kw"),
        F.countDistinct("link").alias("links"),
        F.countDistinct("fingerprint").alias("fps"),
    ).first()
    # FIXTURES.md §5, sf0.001 column.
    assert (r.n, r.t, r.d, r.rel, r.kw, r.links, r.fps) == (200, 24, 48, 62, 55, 189, 192)


def test_keywords_and_first_missing(spark):
    df = spark.createDataFrame([("python dev", "we use sql")], "t string, d string")
    words = X.required_words(F.lit("Python, SQL, Java, Go"))
    r = df.select(D.required_keywords(words, F.col("t"), F.col("d")).alias("ok"),
                  D.first_missing_keyword(words, F.col("t"), F.col("d")).alias("miss")).first()
    assert r.ok is False and r.miss == "java"
    r2 = df.select(D.first_missing_keyword(X.required_words(F.lit(" , ")), F.col("t"), F.col("d")).alias("m")).first()
    assert r2.m is None


def test_benefit_rule_has_no_effect(spark):
    p = V.raw_postings(spark, SF_SMALL)
    tn = X.normalize_text_legacy(F.lit("ther"))
    rows = p.select(X.normalize_text_legacy("title").alias("tl"), X.normalize_text_legacy("description").alias("dl"))
    words = ("the", "of", "and")
    mod = D.role_modifier_exclusion(F.col("tl"), tn, words)
    deg = D.degree_proximity(F.col("dl"), tn, words)
    ben = D.benefit_proximity(F.col("dl"), tn, words)
    in_title = F.col("tl").contains(tn) & ~mod
    # The reference's three statements, literally.
    literal = ~mod & (in_title | deg)
    literal = F.when(ben & ~in_title & ~deg, F.lit(False)).otherwise(literal)
    diff = rows.where(D.legacy_approval(F.col("tl"), tn, mod, deg, ben) != literal).count()
    assert diff == 0
    assert rows.where(ben).count() > 0


def test_threshold_monotone_and_falsy(spark):
    df = spark.createDataFrame([(0.0,), (None,), (85.5,), (40.0,), (80.0,)], "s double")
    for lo, hi in [(0, 50), (50, 80), (80, 90)]:
        a = df.where(D.score_threshold(F.col("s"), F.lit(lo))).count()
        b = df.where(D.score_threshold(F.col("s"), F.lit(hi))).count()
        assert b <= a
    assert df.where(D.score_threshold(F.col("s"), F.lit(0))).count() == 3  # 0 and null never pass


def test_recency_and_valid(spark):
    df = spark.createDataFrame([("2024-01-31 01:00:00", "t", "l"), ("2024-01-30 23:00:00", "", "l"), ("2024-01-31 00:00:00", None, None)],
                               "ts string, title string, link string").withColumn("ts", F.to_timestamp("ts"))
    got = [r.ok for r in df.select(D.recency(F.col("ts"), F.lit(24), "2024-02-01").alias("ok")).collect()]
    assert got == [True, False, True]
    assert [r.v for r in df.select(D.valid_posting("title", "link").alias("v")).collect()] == [True, False, False]


def _brute_scan(postings, cells):
    """Every cell on its own, posting by posting."""
    import datetime as dt
    as_of, want = dt.datetime(2024, 2, 1), []
    for c in cells:
        fits = []
        for r in sorted(postings, key=lambda r: (r.source_no, r.seq)):
            relevant = any(t in r.title_norm for t in c.tokens) or (f" {c.term_norm} " in f" {r.desc_norm} " if c.term_norm else r.desc_norm != "")
            if (relevant and r.site.lower() in ("linkedin", "indeed", "glassdoor") and r.country == c.country
                    and (c.hours_old is None or r.posted_at >= as_of - dt.timedelta(hours=c.hours_old)) and (not c.remote_search or r.is_remote)):
                fits.append((c.search_id, c.term_no, c.loc_no, r.source_no, r.seq))
        want += fits if c.quota is None else fits[: c.quota]
    return sorted(want)


def test_posting_scan_matches_per_cell_brute_force(spark):
    """A mixed batch: limited and unlimited searches of one class, long, empty and remote terms."""
    from jobsift.plans import pipelines as L
    from jobsift.sources import scan as S
    specs = [L.SearchSpec("ther", "", "Brazil", 12, 720, 0), L.SearchSpec("ther", "", "Brazil", None, 720, 0), L.SearchSpec("the thou", "", "remote", 30, 720, 0),
             L.SearchSpec("!!", "", "Brazil", 45, 720, 0), L.SearchSpec("de la", "", "uk", 11, 168, 0), L.SearchSpec("and the", "", "Brazil", 5000, None, 0),
             L.SearchSpec("is the thou and of", "", "Ireland", None, None, 0), L.SearchSpec("on", "", "usa", 20, None, 0)]
    grid = L.grid_of(L.spec_frame(spark, specs))
    postings = V.raw_postings(spark, SF_SMALL)
    got = sorted(tuple(r) for r in S.posting_scan(postings, grid, "2024-02-01").select("search_id", "term_no", "loc_no", "source_no", "seq").collect())
    cells = D.with_search_terms(grid, F.col("term"), F.col("filter_words")).collect()
    assert got == _brute_scan(D.with_norms(postings).collect(), cells)
    per = {i: sum(g[0] == i for g in got) for i in range(1, 9)}
    assert per[1] == 12 < per[2] and per[6] > 30


def test_quota_is_filled_by_matches(spark):
    from conftest import SF_MID
    from jobsift.plans import pipelines as L
    from jobsift.sources import scan as S
    postings = V.raw_postings(spark, SF_MID)
    spec = C.SPECS[0]
    scanned = S.posting_scan(postings, L.grid_of(L.spec_frame(spark, [spec])), "2024-02-01")
    assert scanned.count() == spec.results_wanted
    every = S.posting_scan(postings, L.grid_of(L.spec_frame(spark, [L.SearchSpec(spec.term, "", spec.location, None, spec.hours_old, 0)])), "2024-02-01")
    assert every.count() > spec.results_wanted


def test_legacy_rules_see_every_white_space(spark):
    df = spark.createDataFrame([("assistente de\u00a0ther", "superior\rx\u0085y\u2028 ther"), ("assistente dether", "superior\n ther")], "t string, d string")
    term = F.lit("ther")
    got = df.select(D.role_modifier_exclusion(F.col("t"), term).alias("m"), D.degree_proximity(F.col("d"), term).alias("g")).collect()
    assert [(r.m, r.g) for r in got] == [(True, True), (False, False)]
