"""The scan's phrases as runs of words: rows that grow with the matches, not with the texts."""

import random

from pyspark.sql import functions as F

from jobsift.operators import dedup as E
from jobsift.plans import pipelines as L
from jobsift.sources import matching as M
from jobsift.sources import scan as S
from tests.test_scan_store import AS_OF, POSTING, _picked, _want


def _frame(spark, rows):
    """(seq, title, description) as postings of one country."""
    made = [(0, i, t, "c", f"u{i}", d, "X", "brazil", False, "indeed", "N/A", "2024-01-20 12:00:00") for i, t, d in rows]
    return E.cut_lineage(spark.createDataFrame(made, POSTING.replace("timestamp", "string")).withColumn("posted_at", F.to_timestamp("posted_at")))


def _grid(spark, terms):
    return L.grid_of(L.spec_frame(spark, [L.SearchSpec(t, "", "Brazil", None, None, 0) for t in terms]))


def test_phrases_of_common_words_keep_few_rows(spark, monkeypatch):
    rnd = random.Random(5)
    common = [f"x{i}" for i in range(30)]
    texts = [" ".join(rnd.choice(common) for _ in range(300)) for _ in range(40)]
    here = [" ".join(texts[i].split()[40 + i:40 + i + n]) for i, n in ((0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (7, 11))]
    absent = [" ".join(rnd.choice(common) for _ in range(9)) for _ in range(40)]
    postings = _frame(spark, [(i, "title", t) for i, t in enumerate(texts)])
    grid = _grid(spark, here + absent)
    written = []
    orig = E.cut_lineage

    def spy(frame, metrics=None):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        out = orig(frame, metrics)
        written.append(((out[0] if metrics else out).count(), frame.columns, plan))
        return out

    monkeypatch.setattr(M, "cut_lineage", spy)
    scanned = S.posting_scan(postings, grid, AS_OF)
    want = _want(spark, postings, grid)
    assert _picked(scanned) == want and {w[0] for w in want} >= set(range(1, 9))
    kept = max(n for n, columns, _ in written if "pos" in columns)
    assert kept < 40 * 300 / 4      # of 12,000 places; all words are asked for


def test_hits_carry_no_term(spark):
    postings = _frame(spark, [(i, f"title {i}", "one two three four five") for i in range(20)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = M.term_matches
        plans = []
        try:
            M.term_matches = lambda *a: plans.append(found(*a)) or plans[-1]
            assert len(_picked(S.posting_scan(postings, _grid(spark, ["two three four five", "one"]), AS_OF))) == 40
        finally:
            M.term_matches = found
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "term_norm" not in plans[0].columns


def test_copies_of_a_key_count_together(spark):
    """As before: equal copies of a posting hold single words only; a copy beside another text holds its phrases."""
    one = [(i, "t", "alpha beta gamma delta epsilon") for i in (1, 2, 2)]
    postings = _frame(spark, [*one, (3, "t", "alpha beta gamma delta epsilon"), (3, "t", "nothing"), (4, "alpha", "x"), (4, "alpha", "x")])
    got = _picked(S.posting_scan(postings, _grid(spark, ["alpha", "alpha beta", "beta gamma delta epsilon"]), AS_OF))
    by_search = {n: sorted({g[4] for g in got if g[0] == n}) for n in (1, 2, 3)}
    assert by_search == {1: [1, 2, 3, 4], 2: [1, 3, 4], 3: [1, 3]}
