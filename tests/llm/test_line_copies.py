"""The pipeline's line stage: copies of a document are one page."""

import corpus_pipeline as c


def test_copies_keep_their_text_beside_real_boilerplate(spark):
    rows = [(i, f"menu\nthe copied article\nits second line {i // 20}", "en", "h", 0) for i in range(20)]
    rows += [(100 + i, f"menu\nstory {i}", "en", "h", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    got = {r.doc_id: r.text for r in c.drop_boilerplate(spark, docs, "").collect()}
    assert all(got[i] == "the copied article\nits second line 0" for i in range(20))
    assert all(got[100 + i] == f"story {i}" for i in range(40))


def test_columns_of_the_callers_with_inner_names_come_back(spark):
    from jobsift.llm.line_dedup import line_dedup
    rows = [(i, f"menu\nown {i}", "site", "a", "b", "c", 7) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _kept string, _drop string, _HOST string, N_LINES int")
    got = line_dedup(docs)
    assert got.columns == ["doc_id", "text", "source", "_kept", "_drop", "_HOST", "n_lines", "n_dropped"]
    assert {(r.text, r._kept, r._drop, r._HOST, r.n_lines, r.n_dropped) for r in got.collect()} == {(f"own {i}", "a", "b", "c", 2, 1) for i in range(30)}


def test_copies_are_one_page_in_the_query_and_its_sql(spark, tmp_path):
    import duckdb
    from jobsift.llm.queries import ORACLE, op6_line_dedup
    rows = [(i, "menu\nthe copied article", "h") for i in range(30)] + [(100 + i, f"menu\nstory {i}", "h") for i in range(40)]
    rows += [(200 + i, x, "h") for i, x in enumerate([None, None, "", "", "menu"])] + [(300, "menu\nx", None), (300, "menu\nx", None), (None, "menu\ny", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op6_line_dedup(spark, str(tmp_path)).collect()), key=str)
    base = duckdb.connect()
    base.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(base.sql(ORACLE["op6_line_dedup"]).fetchall(), key=str)
    assert (0, "the copied article", 2, 1) in got and (204, "", 1, 1) in got and (300, "menu\nx", 2, 0) in got
