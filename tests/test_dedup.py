"""The parallel two-key de-duplication equals the sequential loop."""

import random


from jobsift.operators import dedup as E

SCHEMA = "search_id long, term_no int, loc_no int, seq long, link string, fingerprint string, valid boolean, missing_word string, relevant boolean, candidate boolean"


def sequential(rows):
    """The reference's loop: rows in (scope, loc_no, seq) order, two seen-sets per scope."""
    out = {}
    seen = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3])):
        scope = (r[0], r[1])
        links, fps = seen.setdefault(scope, (set(), set()))
        _, _, loc, seq, link, fp, valid, missing, relevant = r
        if not valid:
            d = E.INVALID
        elif link in links:
            d = E.DUP_LINK
        elif fp in fps:
            d = E.DUP_FINGERPRINT
        elif missing is not None:
            d = E.MISSING_KEYWORD
        elif not relevant:
            d = E.IRRELEVANT
        else:
            d = E.APPROVED
            links.add(link)
            fps.add(fp)
        out[(r[0], r[1], loc, seq)] = d
    return out


def frame(spark, rows):
    data = [(*r, bool(r[6] and r[7] is None and r[8])) for r in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(5)


def run(spark, rows):
    df = frame(spark, rows)
    lab = E.dedup_two_key(df)
    return {(r.search_id, r.term_no, r.loc_no, r.seq): r.disposition for r in lab.collect()}


def test_three_row_chain(spark):
    rows = [(1, 0, 0, 1, "l1", "f1", True, None, True),
            (1, 0, 0, 2, "l2", "f1", True, None, True),
            (1, 0, 0, 3, "l2", "f2", True, None, True)]
    got = run(spark, rows)
    assert got == sequential(rows)
    assert sorted(k[3] for k, v in got.items() if v == E.APPROVED) == [1, 3]


def test_random_bipartite(spark):
    for seed in range(4):
        rnd = random.Random(seed)
        rows = []
        seqs = rnd.sample(range(10_000), 400)
        for s in seqs:
            rows.append((rnd.randint(1, 2), rnd.randint(0, 1), rnd.randint(0, 2), s,
                         f"l{rnd.randint(0, 60)}", f"f{rnd.randint(0, 60)}",
                         rnd.random() > 0.05, None if rnd.random() > 0.2 else "kw", rnd.random() > 0.2))
        got = run(spark, rows)
        assert got == sequential(rows), seed


def test_hot_key(spark):
    # One link shared by a third of the rows, interleaved with fingerprint chains.
    rows = []
    for s in range(300):
        link = "hot" if s % 3 == 0 else f"l{s // 2}"
        rows.append((1, 0, 0, s, link, f"f{s // 4}", True, None, True))
    assert run(spark, rows) == sequential(rows)


def test_labels_partition_rows(spark):
    rnd = random.Random(7)
    rows = [(1, 0, 0, s, f"l{rnd.randint(0, 20)}", f"f{rnd.randint(0, 20)}", rnd.random() > 0.1,
             None if rnd.random() > 0.3 else "x", rnd.random() > 0.3) for s in range(200)]
    got = run(spark, rows)
    assert len(got) == len(rows)
    assert set(got.values()) <= {E.APPROVED, E.DUP_LINK, E.DUP_FINGERPRINT, E.MISSING_KEYWORD, E.IRRELEVANT, E.INVALID}


def test_first_per_key(spark):
    rows = [(1, 0, 0, 5, "a", "x", True, None, True), (1, 0, 0, 2, "a", "y", True, None, True),
            (1, 0, 1, 1, "a", "z", True, None, True), (1, 0, 0, 9, "b", "x", True, None, True)]
    df = frame(spark, rows)
    got = sorted((r.seq, r.link) for r in E.first_per_key(df, "link").collect())
    assert got == [(2, "a"), (9, "b")]
    got_fp = sorted(r.seq for r in E.first_per_key(df, "fingerprint").collect())
    assert got_fp == [1, 2, 5]


def test_null_and_empty_links_are_invalid(spark):
    rows = [(1, 0, 0, s, None if s % 2 else "", f"f{s}", False, None, True) for s in range(20)] + [(1, 0, 0, 99, "l", "f", True, None, True)]
    got = run(spark, rows)
    assert len(got) == 21 and got[(1, 0, 0, 99)] == E.APPROVED
    assert {v for k, v in got.items() if k[3] != 99} == {E.INVALID}


def test_clashing_seq_of_two_sources(spark):
    """The source's number is part of a row's place and key."""
    rows = [(1, 0, 0, 1, 5, "a", "x"), (1, 0, 0, 0, 5, "b", "x"), (1, 0, 0, 1, 6, "a", "y")]
    df = spark.createDataFrame(rows, "search_id long, term_no int, loc_no int, source_no int, seq long, link string, fingerprint string")
    approved, _ = E.greedy_two_key(df)
    assert sorted((r.source_no, r.seq) for r in approved.collect()) == [(0, 5), (1, 6)]


def test_hot_key_is_split_over_tasks(spark):
    """A link with half of all rows: no task of a round's anti-join gets more than a fifth."""
    from pyspark.sql import functions as F

    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
             "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(40_000).select(F.lit(1).cast("long").alias("search_id"), F.lit(0).alias("term_no"), F.lit(0).alias("loc_no"), F.col("id").alias("seq"),
                                          F.when(F.col("id") % 2 == 0, "hot").otherwise(F.md5(F.col("id").cast("string"))).alias("link"),
                                          F.md5((F.col("id") + 1).cast("string")).alias("fingerprint"))
        rest = E.cut_lineage(rows.repartition(8))
        won = E.cut_lineage(rows.where("seq % 100 = 1"))
        left = E._unmatched(rest, won, ["search_id", "term_no", "link"])
        read = F.bit_xor(F.xxhash64("seq", "fingerprint"))  # the whole rows, as a round writes them
        tasks = [r.n for r in left.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), read).collect()]
        assert sum(tasks) == 39_600 and max(tasks) < 8_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
