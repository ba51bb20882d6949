"""The scan's matching, the posting store, the selection of first rows, run-time isolation
of sources, the bucketed jobs table and de-duplication across batches."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from jobsift.functions import text as X
from jobsift.operators import dedup as E
from jobsift.operators import rank as I
from jobsift.plans import pipelines as L
from jobsift.sources import matching as M
from jobsift.sources import scan as S
from jobsift.sources.store import PostingStore
from jobsift.streaming import sinks as K
from jobsift.streaming.seen import SeenKeys, dedup_batch, stream_dedup

AS_OF = "2024-02-01"
POSTING = ("source_no int, seq long, title string, company string, job_url string, description string, location string, country string, "
           "is_remote boolean, site string, date_posted string, posted_at timestamp")


def _folder(name):
    return os.path.join(tempfile.mkdtemp(prefix="jobsift-"), name)


def _postings(spark, n, seed=0, first=0):
    rnd = random.Random(seed)
    words = "data engenheiro de dados senior la casa ther thou and java remoto de de la".split()
    rows = []
    for i in range(n):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 14)))
        title = rnd.choice([None, "", "Datalog", "Engenheiro de Dados", "java " + rnd.choice(words), text])
        rows.append((i % 2, first + i, title, "c", f"u{i % 50}", rnd.choice([text, text.title() + "!", None]), "X", rnd.choice(["usa", "brazil", "uk"]),
                     rnd.choice([True, False, None]), rnd.choice(["LinkedIn", "indeed", "other"]), "N/A", None if i % 17 == 0 else f"2024-01-{1 + i % 31:02d} 12:00:00"))
    return spark.createDataFrame([(*r[:-1], None) for r in rows], POSTING).drop("posted_at").join(
        spark.createDataFrame([(r[1], r[-1]) for r in rows], "seq long, at string").select("seq", F.to_timestamp("at").alias("posted_at")), "seq").select(*[c.split()[0] for c in POSTING.split(", ")])


SPECS = [L.SearchSpec("de la", "", "Brazil", None, None, 0), L.SearchSpec("Data", "", "usa", 10, 24 * 10, 0), L.SearchSpec("de dados senior", "", "uk", None, 720, 0),
         L.SearchSpec("de de la", "", "remote", None, None, 0), L.SearchSpec("!!", "", "Brazil", None, None, 0), L.SearchSpec("absentword qqqq", "", "Brazil", None, None, 0),
         L.SearchSpec("geral java", "", "Brazil", 12, None, 0)]


def _want(spark, postings, grid):
    """The scan as a loop over cells and rows."""
    rows = [r.asDict() for r in postings.select("*", X.normalize_text("title").alias("tn"), X.normalize_text("description").alias("dn")).orderBy(*M.KEYS).collect()]
    cells = grid.select("*", X.normalize_text("term").alias("term_norm")).select("*", X.term_tokens("term_norm").alias("tokens")).collect()
    import datetime as dt
    now, out = dt.datetime(2024, 2, 1), []
    for c in cells:
        taken = 0
        for r in rows:
            relevant = any(t in r["tn"] for t in c.tokens) or (f" {c.term_norm} " in f" {r['dn']} " if c.term_norm else r["dn"] != "")
            fresh = c.hours_old is None or (r["posted_at"] is not None and r["posted_at"] >= now - dt.timedelta(hours=c.hours_old))
            if relevant and fresh and r["country"] == c.country and (not c.remote_search or r["is_remote"]) and r["site"].lower() in S.SCRAPE_SITES:
                taken += 1
                if c.quota is None or taken <= c.quota:
                    out.append((c.search_id, c.term_no, c.loc_no, r["source_no"], r["seq"]))
    return sorted(out)


def _picked(scanned):
    return sorted(tuple(r) for r in scanned.select("search_id", "term_no", "loc_no", "source_no", "seq").collect())


def test_scan_of_a_frame_and_of_a_store_equal_a_loop(spark):
    old, new = _postings(spark, 200, 1), _postings(spark, 200, 2, first=1000)
    both = E.cut_lineage(old.unionByName(new))
    grid = L.grid_of(L.spec_frame(spark, SPECS))
    want = _want(spark, both, grid)
    assert {w[0] for w in want} >= {1, 2, 3, 4, 5, 7} and 6 not in {w[0] for w in want}
    assert _picked(S.posting_scan(both, grid, AS_OF)) == want
    store = PostingStore(spark, _folder("store"))
    store.extend(old)
    store.extend(new)
    scanned = E.cut_lineage(S.posting_scan(store, grid, AS_OF))
    assert _picked(scanned) == want
    keys = {(w[3], w[4]) for w in want}
    assert {(r.source_no, r.seq) for r in store.rows(scanned.where("posted_at is not null")).collect()} == {
        (r.source_no, r.seq) for r in both.where("posted_at is not null").collect() if (r.source_no, r.seq) in keys}
    done = L.intake(store, L.grid_of(L.spec_frame(spark, SPECS[1:3])), AS_OF)
    frame = L.intake(both, L.grid_of(L.spec_frame(spark, SPECS[1:3])), AS_OF)
    pick = lambda x: sorted(tuple(r) for r in x.labelled.select("search_id", "seq", "disposition").collect())
    assert pick(done) == pick(frame) != []


def _plans_written(monkeypatch, modules):
    plans, orig = [], E.cut_lineage

    def spy(frame, metrics=None):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return orig(frame, metrics)

    for module in modules:
        monkeypatch.setattr(module, "cut_lineage", spy)
    return plans


def test_scan_moves_no_text(spark, monkeypatch):
    """Without broadcasts no exchange and no row made by an explode has a text column, and the store's scan reads none."""
    postings = E.cut_lineage(_postings(spark, 60, 3))
    store = PostingStore(spark, _folder("store"))
    store.extend(postings)
    grid = L.grid_of(L.spec_frame(spark, SPECS[:4]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = _plans_written(monkeypatch, [M, S, E])
        plans.append(S.posting_scan(postings, grid, AS_OF)._jdf.queryExecution().executedPlan().toString())
        import re
        for plan in plans:
            for line in plan.splitlines():
                if "Exchange" in line or "Generate" in line:
                    assert not re.search(r"\b(title|description|title_norm|desc_norm)#", line.split("], [")[0]), line
        assert any("Exchange" in p for p in plans)
        plans.clear()
        S.posting_scan(store, grid, AS_OF).count()
        assert not any("description:string" in p or "title:string" in p for p in plans)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_day_limited_scan_lists_its_folders_only(spark):
    store = PostingStore(spark, _folder("store"))
    store.extend(_postings(spark, 300, 5).where("posted_at is not null"))
    every = store._read("postings")
    kept = store.kept(72, S.SCRAPE_SITES, AS_OF)
    days = {r[0] for r in kept.select(F.col("posted_day").cast("string")).distinct().collect()}
    assert days and min(days) >= "2024-01-29"
    assert "PartitionFilters: [isnotnull(posted_day" in kept._jdf.queryExecution().executedPlan().toString()
    assert 0 < len(kept.select(F.col("_metadata.file_path").alias("f")).distinct().collect()) < len(every.inputFiles()) / 3
    picked = every.where("seq in (0, 1, 2, 3)").select(*M.KEYS, "country", "posted_at")
    rows = store.rows(picked)
    assert rows.count() == picked.count() and "posted_day" in rows._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]


@pytest.mark.parametrize("quota", [10, 5_000])
def test_first_rows_sort_little(spark, quota):
    rows = spark.range(200_000).select(F.when(F.col("id") % 10 < 6, 1).otherwise(F.col("id") % 7 + 2).cast("long").alias("k"), (F.col("id") % 3).cast("int").alias("h"),
                                       (F.xxhash64("id") % 1_000_000_007 * F.when(F.col("id") % 5 == 0, 1).otherwise(1_000_003)).alias("v"), F.lit(quota).cast("long").alias("n"))
    few = E.cut_lineage(I.first_rows(rows, "k", ["h", "v"], "n", few=0))
    per_key = {r.k: r["count"] for r in few.groupBy("k").count().collect()}
    sizes = {r.k: r["count"] for r in rows.groupBy("k").count().collect()}
    assert len(per_key) == 8 and all(min(quota, sizes[k]) <= c <= I.SLACK * quota for k, c in per_key.items())
    got = I.positions(few, "k", ["h", "v"], "at", cheap=True).where(F.col("at") <= quota)
    from pyspark.sql import Window
    want = rows.withColumn("at", F.row_number().over(Window.partitionBy("k").orderBy("h", "v"))).where(F.col("at") <= quota)
    assert got.select("k", "h", "v").exceptAll(want.select("k", "h", "v")).count() == 0 and got.count() == want.count()


def test_first_rows_without_and_with_odd_limits(spark):
    rows = spark.createDataFrame([(k, i, None if k == 1 else k - 2) for k in (1, 2, 3, 50) for i in (-2 ** 63, -5, 0, 7, 7, 2 ** 63 - 1)], "k long, v long, n long")
    got = {}
    for r in I.first_rows(rows, "k", ["v"], "n", slack=1, few=0).collect():
        got.setdefault(r.k, []).append(r.v)
    assert len(got[1]) == 6 and 2 not in got and min(got[3]) == -2 ** 63 and len(got[50]) == 6


def test_a_source_that_fails_while_tasks_run_is_left_out(spark):
    good = spark.createDataFrame([(1, "a")], "seq long, title string")
    failing = good.withColumn("seq", F.col("title").cast("long"))
    path = _folder("parts")
    spark.range(100).select(F.col("id").alias("seq"), F.lit("t").alias("title")).repartition(4).write.parquet(path)
    spark.createDataFrame([], "seq long, title string").coalesce(1).write.mode("append").parquet(path)
    part = sorted(f for f in os.listdir(path) if f.endswith(".parquet"))
    largest = max(part, key=lambda f: os.path.getsize(os.path.join(path, f)))
    lost = spark.read.parquet(os.path.join(path, largest)).count()
    with open(os.path.join(path, largest), "wb") as out:
        out.write(b"PAR1 broken")
    found, errors = S.source_isolation(spark, [lambda: good, lambda: failing, lambda: spark.read.parquet(path + "-none"), lambda: S.read_parts(spark, path, good.schema)])
    assert found.where("source_no = 0").count() == 1 and found.where("source_no = 1").count() == 100 - lost
    assert len(errors) == 3 and errors[0].startswith("source 1:") and errors[1].startswith("source 2:") and largest in errors[2]
    nothing, errors = S.source_isolation(spark, [lambda: failing])
    assert nothing.count() == 0 and len(errors) == 1


JOB = ("search_id long, term_no int, loc_no int, source_no int, seq long, title string, company string, location string, link string, "
       "description string, source string, published_at string")


def _jobs(spark, rows):
    return spark.createDataFrame([(1, 0, 0, 0, seq, f"t{seq}", "c", "L", link, "d", "s", "p") for seq, link in rows], JOB)


def test_stored_links_are_not_shuffled_and_a_hot_link_is_one_row_a_task(spark):
    path = _folder("jobs")
    assert K.append_unique(_jobs(spark, [(i, f"l{i}") for i in range(300)]), path, AS_OF) == 300
    hot = _jobs(spark, [(i, "hot" if i % 2 else f"l{i}") for i in range(1000, 3000)]).repartition(5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = K.new_unique_rows(hot, K.read_jobs(spark, path).select("link"), AS_OF)
        plan = new._jdf.queryExecution().executedPlan().toString()
        lines = plan.splitlines()
        scan = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
        stored = lines[scan - 2 : scan]      # what stands between the join and the stored links
        assert "Filter" in stored[1] and "Sort" in stored[0] and lines[scan - 2].index("Sort") == lines[2].index("SortMergeJoin") + 3, plan
        assert "Exchange hashpartitioning(link" in plan and "partial_min_by" in plan
        assert new.count() == 1 + 1000 and new.where("link = 'hot'").first().title == "t1001"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert K.append_unique(hot, path, AS_OF) == 1001 and K.append_unique(hot, path, AS_OF) == 0
    jobs = K.read_jobs(spark, path)
    assert jobs.count() == 1301 == jobs.select("link").distinct().count()
    K.jobs_init(spark, path)
    assert jobs.count() == 1301
    K.jobs_init(spark, path, reset=True)
    assert K.read_jobs(spark, path).count() == 0


def _annotated(spark, n, seed=0):
    rnd = random.Random(seed)
    rows = [(1, i % 2, i * 3 // n, 0, i, f"t{i}", "c", rnd.choice([None] + [f"l{x}" for x in range(40)]), f"f{rnd.randrange(40)}", True, rnd.choice([None, None, "w"]), rnd.random() < 0.8)
            for i in range(n)]
    df = spark.createDataFrame(rows, "search_id long, term_no int, loc_no int, source_no int, seq long, title string, company string, link string, fingerprint string, "
                                     "valid boolean, missing_word string, relevant boolean")
    df = df.withColumn("valid", F.col("link").isNotNull())
    return E.cut_lineage(df.withColumn("candidate", F.col("valid") & F.col("missing_word").isNull() & F.col("relevant")))


def test_batches_give_the_labels_of_one_run(spark):
    rows = _annotated(spark, 400)
    want = sorted(tuple(r) for r in E.dedup_two_key(rows).select("term_no", "seq", "disposition").collect())
    seen = SeenKeys(spark, _folder("seen"))
    got = []
    for n in range(3):
        part = rows.where(F.col("loc_no") == n)
        once = dedup_batch(part, seen, n).select("term_no", "seq", "disposition").collect()
        if n == 1:   # a batch that is run again finds the state it found before
            assert sorted(once) == sorted(dedup_batch(part, seen, n).select("term_no", "seq", "disposition").collect())
        got += [tuple(r) for r in once]
    assert sorted(got) == want and len({w[2] for w in want}) == 6


def test_stream_of_batches_gives_the_labels_of_one_run(spark):
    rows = _annotated(spark, 120, 4)
    base = tempfile.mkdtemp(prefix="jobsift-stream-")
    for n in range(3):
        rows.where(F.col("loc_no") == n).coalesce(1).write.mode("append").parquet(f"{base}/in")
        query = stream_dedup(spark.readStream.schema(rows.schema).parquet(f"{base}/in"), SeenKeys(spark, f"{base}/seen"), f"{base}/out", f"{base}/ckpt").trigger(availableNow=True).start()
        query.awaitTermination(200)
        assert query.exception() is None
    got = spark.read.parquet(f"{base}/out")
    want = E.dedup_two_key(rows)
    assert sorted(tuple(r) for r in got.select("term_no", "seq", "disposition").collect()) == sorted(tuple(r) for r in want.select("term_no", "seq", "disposition").collect())
