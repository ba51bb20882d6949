"""Work that grows with the input only: titles of many terms, dictionary runs, the store's parts."""

import os
import random
import tempfile

from pyspark.sql import functions as F

from jobsift.functions import text as X
from jobsift.operators import dedup as E
from jobsift.operators import scoring as H
from jobsift.plans import pipelines as L
from jobsift.sources import matching as M
from jobsift.sources import scan as S
from jobsift.sources.store import PostingStore
from tests.test_scan_store import AS_OF, _picked, _postings, _want


def test_many_terms_find_the_first_postings_of_a_loop(spark, monkeypatch):
    monkeypatch.setattr(M, "MANY", 1)
    monkeypatch.setattr(M, "FIRST_ROWS", 30)
    monkeypatch.setattr(M, "FEW_HITS", 2)
    monkeypatch.setattr(M, "LONG_WORD", 5)
    postings = E.cut_lineage(_postings(spark, 400, 7))
    rnd = random.Random(1)
    words = "data engenheiro dados senior casa ther thou java remoto gen log absent".split()
    specs = [L.SearchSpec(" ".join(rnd.sample(words, rnd.randrange(1, 4))), "", rnd.choice(["Brazil", "usa", "uk", "remote"]),
                          rnd.choice([None, 10, 12]), rnd.choice([None, 24 * 10, 720]), 0) for _ in range(12)]
    grid = L.grid_of(L.spec_frame(spark, specs))
    want = _want(spark, postings, grid)
    calls = []
    first = M._first_titles
    monkeypatch.setattr(M, "_first_titles", lambda *a: calls.append(1) or first(*a))
    assert len(want) > 100 and _picked(S.posting_scan(postings, grid, AS_OF)) == want and calls == [1]


def test_dictionary_runs_are_one_row_a_place(spark, monkeypatch):
    """Phrases that share a frequent word don't multiply its places."""
    texts = spark.createDataFrame([(i, "the " * 200 + f"w{i} of x y z") for i in range(20)], "id long, _norm string")
    skills = spark.createDataFrame([(f"the a{i}", "hard") for i in range(500)] + [("the w3", "hard"), ("of x y z", "domain"), ("of x y q", "domain"), ("Z", "hard")], "skill string, kind string")
    written = []
    cut = E.cut_lineage
    monkeypatch.setattr(E, "cut_lineage", lambda df, *a: written.append(cut(df, *a)) or written[-1])
    found = H.phrases_by_join(texts, ["id"], skills, "kind").collect()
    assert sorted({(r.skill, r.kind) for r in found}) == [("of x y z", "domain"), ("the w3", "hard"), ("z", "hard")] and len(found) == 41
    assert max((w[0] if isinstance(w, tuple) else w).count() for w in written) < 600


def test_normalised_texts_of_odd_characters(spark):
    odd = ["  A\tb\u000bC\r\nd ", "ação.São-Paulo", "日本 x 語", "a b", "a\u0000b\u007fc", "x  ,  y", "...", "", None, "a\u001cb"]
    src, dst = X._strict_tables()
    rows = spark.createDataFrame([(x,) for x in odd], "t string")
    folded = F.lower(F.translate(F.coalesce("t", F.lit("")), src, dst))
    old = F.trim(F.regexp_replace(F.regexp_replace(folded, r"[^a-z0-9\s]", ""), r"\s+", " "))
    assert all(r[0] == r[1] for r in rows.select(X.normalize_text("t"), old).collect())


def test_an_extension_normalises_its_texts_once(spark, monkeypatch):
    store = PostingStore(spark, os.path.join(tempfile.mkdtemp(prefix="jobsift-"), "store"))
    seen = spark.sparkContext.accumulator(0)

    def tick(x):
        seen.add(1)
        return x

    counted = F.udf(tick, "string").asNondeterministic()
    one, two = (E.cut_lineage(_postings(spark, 90, n, first=1000 * n)) for n in (3, 4))
    store.extend(one.limit(0))
    for rows in (one, two):
        store.extend(rows.withColumn("description", counted("description")))
    listed = one.unionByName(two).where(S.site_filter())
    assert seen.value <= 2 * 180      # the stored rows and the index
    want = M.description_words(listed).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    got = store._read("counts").groupBy("word").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, want.collect())) == sorted(map(tuple, got.collect()))
    vocabulary = [r[0] for r in store._read("vocabulary").collect()]
    assert sorted(vocabulary) == sorted(r[0] for r in M.title_words(listed).select("word").distinct().collect())
