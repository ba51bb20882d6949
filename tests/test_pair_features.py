"""A pair of CV and job carries no skills through a shuffle; de-duplication moves no texts."""

import random

import pytest

from jobsift.operators import dedup as E
from jobsift.operators import scoring as H
from jobsift.plans import pipelines as L
from tests.test_scan_store import AS_OF, SPECS, _postings


def _texts(n, seed):
    rnd = random.Random(seed)
    words = "that ther thou data de la casa erin tion than thon".split()
    return [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 40)))) for i in range(n)]


@pytest.mark.parametrize("held, most", [(2_000_000, 64), (5, 64), (5, 0)])
def test_pairs_of_a_table_equal_the_literal_path(spark, monkeypatch, held, most):
    monkeypatch.setattr(H, "HELD", held)
    monkeypatch.setattr(H, "MOST_GROUPS", most)
    skills = [*H.FIXTURE_SKILLS, ("De La", "domain"), ("de la", "hard"), ("casa ther thou", "hard"), ("ther data de la", "domain")]
    cvs = E.cut_lineage(spark.createDataFrame([*_texts(8, 1), (3, "that ther")], "cv_id long, cv_text string"))
    jobs = E.cut_lineage(spark.createDataFrame([*_texts(6, 2), (50, None)], "job_id long, job_text string"))
    rnd = random.Random(3)
    pairs = E.cut_lineage(spark.createDataFrame([(rnd.randrange(9), rnd.choice([0, 1, 2, 3, 4, 5, 50, 51])) for _ in range(60)] + [(None, 1)], "cv_id long, job_id long"))
    key = lambda r: tuple(r)
    cvs_own = cvs.where("cv_id <> 3")
    want = sorted(map(key, H.rubric_score(pairs, cvs_own, jobs, tuple(skills)).collect()))
    table = spark.createDataFrame([*skills, ("casa", "other"), ("", "hard"), (None, "hard")], "skill string, kind string")
    got = sorted(map(key, H.rubric_score(pairs, cvs_own, jobs, table).collect()))
    assert got == want and len(want) > 30
    assert H.rubric_score(pairs, cvs, jobs, table).where("cv_id = 3").count() == 2 * pairs.where("cv_id = 3 and job_id <> 51").count()


def test_pairs_shuffle_no_skills(spark):
    """With many pairs of few jobs an exchange that holds pairs has no arrays."""
    cvs = E.cut_lineage(spark.createDataFrame([(i, "a b c") for i in range(20)], "cv_id long, cv_text string"))
    jobs = E.cut_lineage(spark.createDataFrame([(i, "a b c d") for i in range(5)], "job_id long, job_text string"))
    pairs = E.cut_lineage(spark.createDataFrame([(c, j) for c in range(20) for j in range(5)], "cv_id long, job_id long"))
    skills = spark.createDataFrame([("a b", "hard"), ("b c", "domain")], "skill string, kind string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = H.rubric_score(pairs, cvs, jobs, skills)
        plan = done._jdf.queryExecution().executedPlan().toString()
        exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning(cv_id" in x]
        assert sum("Exchange hashpartitioning" in x for x in plan.splitlines()) == 2 and len(exchanges) == 2
        assert done.count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_dedup_of_cells_moves_no_texts(spark, monkeypatch):
    plans, orig = [], E.cut_lineage

    def spy(frame, metrics=None):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return orig(frame, metrics)

    postings = E.cut_lineage(_postings(spark, 120, 9))
    grid = L.grid_of(L.spec_frame(spark, SPECS))
    greedy, seen = E.greedy_two_key, []

    def watched(cands, *a, **k):
        seen.append(cands.dtypes)
        return greedy(cands, *a, **k)

    monkeypatch.setattr(E, "cut_lineage", spy)
    monkeypatch.setattr(E, "greedy_two_key", watched)
    labelled = L.intake(postings, grid, AS_OF).labelled
    assert not [c for c, kind in seen[0] if kind == "string"]
    want = {tuple(r) for r in E.dedup_two_key(orig(labelled.drop("disposition"))).select(*L.ROW, "disposition").collect()}
    got = {tuple(r) for r in labelled.select(*L.ROW, "disposition").collect()}
    assert got == want and {g[-1] for g in got} >= {E.APPROVED, E.DUP_LINK}
