"""H3-H6 reply cases, rubric bounds, search planning and CV rules on literal tables."""

from pyspark.sql import functions as F

from jobsift.operators import cv as B
from jobsift.operators import plan as A
from jobsift.operators import scoring as H
from jobsift.plans import pipelines as L

REPLIES = [
    (1, 1, '{"score": 85, "rationale": "bom"}', None),       # int score
    (1, 2, '{"score": 85.5}', None),                         # float, rationale absent
    (1, 3, "not json", None),                                # not JSON -> 0 + error text
    (1, 4, None, "connection reset"),                        # no reply, other error
    (1, 5, '{"rationale": "x"}', None),                      # key absent -> 0
    (1, 6, '{"score": null, "rationale": "n"}', None),       # explicit null stays null
    (1, 7, '{"score": "90"}', None),                         # text score
    (2, 1, "[1, 2]", None),                                  # not an object -> abort
    (3, 1, None, "Error code: 429"),                         # rate limit -> abort
    (4, 1, '{"score": 70}', None),
    (4, 2, '{"score": true}', None),                         # a boolean compares as 1 or 0
    (4, 3, '{"score": false}', None),
]


def test_reply_cases(spark):
    df = spark.createDataFrame(REPLIES, "search_id long, seq long, reply string, error string")
    got = {(r.search_id, r.seq): (r.status, r.score, r.rationale) for r in H.parse_reply(df).collect()}
    assert got[(1, 1)] == ("ok", 85.0, "bom")
    assert got[(1, 2)] == ("ok", 85.5, H.NO_RATIONALE)
    assert got[(1, 3)] == ("error", 0.0, H.ERROR_RATIONALE)
    assert got[(1, 4)] == ("error", 0.0, H.ERROR_RATIONALE)
    assert got[(1, 5)] == ("ok", 0.0, "x")
    assert got[(1, 6)] == ("ok", None, "n")
    assert got[(1, 7)][0] == "non_numeric"
    assert got[(4, 2)][:2] == ("ok", 1.0) and got[(4, 3)][:2] == ("ok", 0.0)
    assert got[(2, 1)][0] == "abort" and got[(3, 1)][0] == "abort"
    kept = {r.search_id for r in H.batch_abort(H.parse_reply(df)).collect()}
    assert kept == {1, 4}
    ec = [r.c for r in df.select(H.error_class(F.col("error")).alias("c")).orderBy("search_id", "seq").collect()]
    assert ec.count("abort") == 1 and ec.count("error") == 1


def test_replies_that_are_almost_json(spark):
    rows = ['{"score": 1, "rationale": "a", "score": 85.5, "rationale": "b"}', '{"score": 7} x', '{"score": 7}, null', '{"score": 7}] x', '{"score": 7}} x',
            ' \n{"score": 7} ', "{'score': 7}", '{"score": 7}, "y": 2', ""]
    df = spark.createDataFrame([(1, i, r, None) for i, r in enumerate(rows)], "search_id long, seq long, reply string, error string")
    got = {r.seq: (r.status, r.score, r.rationale) for r in H.parse_reply(df).collect()}
    assert got[0] == ("ok", 85.5, "b")      # of a key given twice the last counts
    assert got[5][:2] == ("ok", 7.0)
    assert {got[i][0] for i in (1, 2, 3, 4, 6, 7, 8)} == {"error"}


def test_distinct_and_capped_terms(spark):
    import random
    rnd = random.Random(1)
    lists = [[], ["A", "a", "b"], ["x"] * 50, [f"T{i % 7}" if i % 2 else f"t{i % 7}" for i in range(40)]]
    lists += [[rnd.choice("aAbBcC") + str(rnd.randrange(9)) for _ in range(rnd.randrange(60))] for _ in range(30)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "search_id long, expanded array<string>")
    got = A.distinct_terms(df, "expanded", "distinct").withColumn("terms", A.capped_terms(F.col("expanded"))).collect()
    for r in got:
        want = list({x.lower(): x for x in reversed(r.expanded)}.items())
        first = {x.lower(): i for i, x in reversed(list(enumerate(r.expanded)))}
        want = [x for low, x in sorted(want, key=lambda p: first[p[0]])]
        assert r.distinct == want and r.terms == want[:5]


def test_rubric_bounds_and_penalty(spark):
    cvs = spark.createDataFrame([(1, "that ther tion erin"), (2, "than that ther thou thre thor thon erin eron then thea")],
                                "cv_id long, cv_text string")
    jobs = spark.createDataFrame([(10, "that ther than erin"), (11, "nothing relevant here")], "job_id long, job_text string")
    pairs = spark.createDataFrame([(1, 10), (2, 10), (1, 11), (2, 11)], "cv_id long, job_id long")
    got = {(r.cv_id, r.job_id): r for r in H.rubric_score(pairs, cvs, jobs).collect()}
    junior_vs_senior = got[(1, 10)]
    assert (junior_vs_senior.hard, junior_vs_senior.level, junior_vs_senior.domain) == (40, 0, 20)
    assert got[(2, 10)].score == 100
    assert got[(1, 11)].score == 100  # nothing required, no level asked
    assert all(0 <= r.score <= 100 for r in got.values())
    assert junior_vs_senior.rationale == H.RATIONALE_LEVEL


def test_locations_and_countries(spark):
    rows = [(1, "remote", 30), (2, " Remoto ", 9), (3, "Remote Ireland", 30), (4, " USA ", 30), (5, "usa", 30), (6, "irlanda", 30), (7, "remote\u00a0", 30)]
    df = spark.createDataFrame(rows, "search_id long, location string, quota int")
    locs = A.resolve_country(A.expand_locations(df))
    got = {}
    for r in locs.collect():
        got.setdefault(r.search_id, []).append((r.loc_no, r.loc, r.remote_search, r.loc_quota, r.country))
    assert sorted(got[1]) == [(0, "USA", True, 10, "usa"), (1, "UK", True, 10, "uk"), (2, "Ireland", True, 10, "ireland")]
    assert sorted(got[2])[0][3] == 10  # max(10, 9 // 3)
    assert got[3] == [(0, "Remote Ireland", True, 30, "brazil")]
    assert got[4] == [(0, " USA ", False, 30, "brazil")]  # no trim here
    assert len(got[7]) == 3
    assert got[5][0][4] == "usa" and got[6][0][4] == "ireland"


def test_term_list_and_grid(spark):
    searches = spark.createDataFrame(
        [(1, "Dev", "", "remote", 30, 24, 80, True), (2, "QA", "", "Brazil", 35, 24, 80, True)], L.SPEC_SCHEMA)
    replies = spark.createDataFrame([(1, " dev , Backend,,backend, Front , a, b, c, d, e")], "search_id long, reply string")
    grid = A.plan_searches(searches, replies)
    terms = sorted({(r.search_id, r.term_no, r.term) for r in grid.collect()})
    assert [t for s, _, t in terms if s == 1] == ["Dev", "Backend", "Front", "a", "b"]
    assert [t for s, _, t in terms if s == 2] == ["QA"]
    q = {(r.search_id, r.loc_no): r.quota for r in grid.collect()}
    assert q[(1, 0)] == 10 and q[(2, 0)] == 35  # max(10, (30 // 5) // 3); max(10, 35 // 1)


def test_form_defaults(spark):
    raw = spark.createDataFrame([(1, None, None, None, None, None, None), (2, "x", "12x", "a", "Rio", "5", "1"),
                                 (3, "x", "1", "a", "Rio", "-5", "1"), (4, "x", "1", "a", "Rio", "5", "-1"), (5, "x", "-1", "a", "Rio", "0", "0")],
                                "search_id long, term_raw string, min_score_raw string, filter_words_raw string, "
                                "location_raw string, results_wanted_raw string, hours_old_raw string")
    got = {r.search_id: r for r in A.form_defaults(raw).collect()}
    d = got[1]
    assert (d.term, d.min_score, d.filter_words, d.location, d.results_wanted, d.hours_old, d.form_ok) == (
        "Engenheiro", 80, "", "Brazil", 30, 24, True)
    assert [got[i].form_ok for i in (2, 3, 4, 5)] == [False, False, False, True]  # bad and negative counts are rejected


def test_cv_rules(spark):
    pages = spark.createDataFrame(
        [(1, 0, "a.pdf", 1, "p2"), (1, 0, "a.pdf", 0, "p1"), (1, 1, "b.PDF", 0, "q"), (2, 0, "c.txt", 0, "ignored"),
         (3, 0, "d.pdf", 0, " \u00a0 ")],
        "cv_id long, file_no int, file_name string, page_no int, text string")
    log = spark.createDataFrame(
        [(2, "2024-01-01 00:00:00", 1, "upload", "old"), (4, "2024-01-01 00:00:00", 2, "upload", "kept"),
         (4, "2024-01-02 00:00:00", 3, "upload", "  "), (5, "2024-01-01 00:00:00", 4, "upload", "x"),
         (5, "2024-01-02 00:00:00", 5, "clear", None)],
        "user_id long, ts string, event_id long, action string, text string").withColumn("ts", F.to_timestamp("ts"))
    stored = {r.user_id: r.cv_text for r in B.cv_store_update(log).collect()}
    assert stored == {2: "old", 4: "kept"}
    eff = {r.user_id: (r.cv_text, r.cv_origin) for r in B.cv_effective(B.cv_uploads(pages), B.cv_store_update(log)).collect()}
    assert eff[1] == ("p1\n\np2\n\nq\n\n", "upload")
    assert eff[2] == ("", "upload")  # an upload without PDF text does not fall back
    assert eff[4] == ("kept", "stored")
    req = {r.user_id for r in B.cv_required(B.cv_effective(B.cv_uploads(pages), B.cv_store_update(log))).collect()}
    assert req == {1, 4}


def test_distributed_rank_matches_window(spark):
    from pyspark.sql import Window
    from jobsift.operators import rank as I
    import random
    rnd = random.Random(3)
    rows = [(rnd.randint(1, 3), s, float(rnd.randint(0, 20)) if rnd.random() > 0.1 else None) for s in range(3000)]
    df = spark.createDataFrame(rows, "search_id long, seq long, score double").repartition(7)
    df = df.withColumn("term_no", F.lit(0)).withColumn("loc_no", F.lit(0))
    got = {(r.search_id, r.seq): r.rank for r in I.rank_by_score(df).collect()}
    w = Window.partitionBy("search_id").orderBy(F.col("score").desc_nulls_last(), "seq")
    want = {(r.search_id, r.seq): r.rank for r in df.withColumn("rank", F.row_number().over(w)).collect()}
    assert got == want


def test_prefix_limit_any_size(spark):
    import pytest
    from jobsift.operators import rank as I
    rows = [(1, 0, 0, s, 5000) for s in range(6000)] + [(2, 0, 0, s, 3) for s in range(10)] + [(3, 0, 0, s, None) for s in range(7)]
    df = spark.createDataFrame(rows, "search_id long, term_no int, loc_no int, seq long, results_wanted int").repartition(9)
    got = {r.search_id: (r.n, r.m) for r in I.prefix_limit(df).groupBy("search_id").agg(F.count("*").alias("n"), F.max("seq").alias("m")).collect()}
    assert got == {1: (5000, 4999), 2: (3, 2), 3: (7, 6)}
    with pytest.raises(Exception, match="negative"):
        I.prefix_limit(df.withColumn("results_wanted", F.lit(-5))).collect()


def test_abort_voids_its_search_only(spark):
    listed = spark.createDataFrame([(s, 0, 0, 0, q, s, 0, f"t{q}", "c", "L", f"l{q}", "x", "d") for s in (1, 2) for q in (1, 2, 3)],
                                   "search_id long, term_no int, loc_no int, source_no int, seq long, user_id long, min_score int, title string, "
                                   "company string, location string, link string, source string, published_at string")
    answers = spark.createDataFrame([(1, 0, 1, '{"score": 50}', None), (1, 0, 2, None, "429"), (2, 0, 1, '{"score": 50}', None), (2, 0, 2, '{"score": 70}', None)],
                                    "search_id long, source_no int, seq long, reply string, error string")
    got = [(r.search_id, r.rank, r.seq, r.score) for r in L.replied_pipeline(L.Batch(listed, None, None), answers).orderBy("search_id", "rank").collect()]
    assert got == [(2, 1, 2, 70.0), (2, 2, 1, 50.0)]  # no answer for (2, 3): failed, score 0


def test_dictionary_table_path_equals_literal_path(spark):
    from jobsift.operators import scoring as H2
    cvs = spark.createDataFrame([(1, "That ther, tion erin!"), (2, "than that ther thou thre thor thon erin eron then thea"),
                                 (3, ""), (4, "de la casa")], "cv_id long, cv_text string")
    jobs = spark.createDataFrame([(10, "that ther than erin"), (11, "nothing relevant here"), (12, "de la ther")],
                                 "job_id long, job_text string")
    pairs = spark.createDataFrame([(c, j) for c in (1, 2, 3, 4) for j in (10, 11, 12)], "cv_id long, job_id long")
    skills = list(H2.FIXTURE_SKILLS) + [("De La", "domain")]
    lit_path = {(r.cv_id, r.job_id): tuple(r) for r in H2.rubric_score(pairs, cvs, jobs, tuple(skills)).collect()}
    table = spark.createDataFrame(skills, "skill string, kind string")
    join_path = {(r.cv_id, r.job_id): tuple(r) for r in H2.rubric_score(pairs, cvs, jobs, table).collect()}
    assert lit_path == join_path
    levels = spark.createDataFrame(list(H2.FIXTURE_LEVELS), "skill string, level int")
    both = {(r.cv_id, r.job_id): tuple(r) for r in H2.rubric_score(pairs, cvs, jobs, table, levels).collect()}
    assert lit_path == both


def test_dictionary_phrases_with_repeated_and_frequent_words(spark):
    from jobsift.operators import scoring as H2
    texts = ["a a b a b", "b a", "a", "", "a b c d", "c d a", "x a a a y", "d d"]
    skills = [("a a", "hard"), ("a b a b", "hard"), ("a", "domain"), ("A  B", "hard"), ("a b", "hard"), ("c d", "domain"), ("d c", "hard"),
              ("a a a", "domain"), ("q a", "hard"), ("", "hard"), ("d d d", "hard"), ("c d", "hard")]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, _norm string")
    got = {tuple(r) for r in H2.phrases_by_join(rows, ["id"], spark.createDataFrame(skills, "skill string, kind string"), "kind").select("id", "skill", "kind").collect()}
    clean = {(" ".join(s.lower().split()), k) for s, k in skills} - {("", "hard")}
    assert got == {(i, s, k) for i, t in enumerate(texts) for s, k in clean if f" {s} " in f" {t} "}
    assert not H2.phrases_by_join(rows, ["id"], spark.createDataFrame([], "skill string, kind string"), "kind").count()


def test_cv_store_takes_batches_in_any_order_and_twice(spark, tmp_path):
    from jobsift.streaming.cvs import CvStore
    log = spark.createDataFrame(
        [(1, 10, 1, "upload", "old"), (1, 30, 3, "upload", "new"), (1, 20, 2, "clear", None), (2, 5, 1, "upload", "x"), (2, 9, 2, "clear", None),
         (3, 1, 1, "upload", "kept"), (3, 2, 2, "upload", "  "), (4, 1, 1, "upload", None), (5, 1, 1, "upload", "a"), (5, 1, 2, "upload", "b")],
        "user_id long, ts long, event_id long, action string, text string")
    want = {tuple(r) for r in B.cv_store_update(log).collect()}
    assert want == {(1, "new"), (3, "kept"), (5, "b")}
    for n, order in enumerate(([0, 1, 2], [2, 0, 1], [1, 1, 2, 0, 2])):
        store = CvStore(spark, str(tmp_path / f"cvs{n}"))
        for k in order:
            store.add(log.where(f"(user_id * 7 + event_id) % 3 = {k}"))
        whole = store.compact(str(tmp_path / f"whole{n}"))
        assert {tuple(r) for r in store.stored().collect()} == want == {tuple(r) for r in whole.stored().collect()}
        assert whole.events().count() == 4
    # a late upload older than a stored clear restores nothing; one that is newer does
    whole.add(spark.createDataFrame([(2, 8, 9, "upload", "late"), (3, 3, 1, "clear", None)], log.schema))
    assert {tuple(r) for r in whole.stored().collect()} == {(1, "new"), (5, "b")}
    plan = whole.events()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
