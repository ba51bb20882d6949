"""The date surprises, expected values written by hand (as_of 2024-02-01)."""

from pyspark.sql import functions as F

from jobsift.functions import dates as D

RELATIVE = [
    ("há 3 semanas", "01/02/2024"),      # 'h' is an "immediate" word
    ("1 month ago", "01/02/2024"),       # 'month' holds an 'h'
    ("3 meses", "03/11/2023"),           # 90 days
    ("5 de março", "27/01/2024"),        # '5 d' reads as days
    ("10 may 2024", "07/04/2023"),       # '10 m' reads as 300 days
    ("segunda-feira", "01/02/2024"),     # 'seg'
    ("yesterday", None),
    ("ontem", None),
    ("30+ days ago", None),
    ("3 anos", None),
    ("2 days ago", "30/01/2024"),
    ("1 week ago", "25/01/2024"),
    ("3 semanas", "11/01/2024"),
    ("just now", "01/02/2024"),
    ("5 hours ago", "01/02/2024"),
    ("N/A", None),
    ("", None),
    (None, None),
    ("2 dias", "30/01/2024"),
    ("4w", "04/01/2024"),
    ("999999999 days", None),
]

FORMAT = [
    ("2024-01-15", "15/01/2024"),
    ("2024-01-15T10:00:00", "15/01/2024"),
    ("2024-13-40", "N/A"),
    ("15/01/2024", "15/01/2024"),
    ("15/01/2024 extra", "15/01/2024 extra"),
    ("foo bar baz qux", "foo bar ba"),
    ("none", "N/A"), ("NaN", "N/A"), ("n/a", "N/A"), ("", "N/A"), (None, "N/A"),
    ("999999999 days", "N/A"),
    ("  3 days ago  ", "29/01/2024"),
    ("há 2 dias", "01/02/2024"),
]

LEGACY = [
    ("2024-01-15T10:00:00", "15/01/2024"),
    ("2024-1-5", "05/01/2024"),
    ("15/01/2024", "15/01/2024"),
    ("3 days ago", "3 days ago"),
    ("abc-def", "abc-def"),
    (None, "N/A"), ("None", "N/A"), ("", "N/A"),
    ("   ", "   "),
    ("2024-02-30", "2024-02-30"),
]


def _run(spark, cases, fn):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, s string")
    got = dict(df.select("i", fn(F.col("s")).alias("o")).collect())
    return [(cases[i][0], got[i], cases[i][1]) for i in range(len(cases)) if got[i] != cases[i][1]]


def test_relative_date(spark):
    assert _run(spark, RELATIVE, lambda c: D.relative_date(c, "2024-02-01")) == []


def test_format_date(spark):
    assert _run(spark, FORMAT, lambda c: D.format_date(c, "2024-02-01")) == []


def test_format_date_legacy(spark):
    assert _run(spark, LEGACY, D.format_date_legacy) == []


def test_created_stamp_and_dates(spark):
    r = spark.range(1).select(D.created_stamp("2024-02-01").alias("c"),
                              D.format_date_value(F.to_date(F.lit("2023-12-31"))).alias("d")).first()
    assert r.c == "01/02/2024" and r.d == "31/12/2023"


def test_every_white_space_counts(spark):
    rows = [("3\u00a0dias",), ("\u00a02024-01-05",), ("\u20283 dias\u0085",)]
    df = spark.createDataFrame(rows, "t string")
    got = [(r.a, r.b) for r in df.select(D.relative_date("t").alias("a"), D.format_date("t").alias("b")).collect()]
    assert got == [("29/01/2024", "29/01/2024"), (None, "05/01/2024"), ("29/01/2024", "29/01/2024")]


def test_typed_dates_are_formatted(spark):
    import datetime as dt
    from jobsift.operators import project as G
    df = spark.createDataFrame([(1, "t", "c", "L", False, "l", "d", "x", dt.date(2024, 1, 5)), (2, "t", "c", "L", False, "l", "d", "x", None)],
                               "seq long, title string, company string, location string, is_remote boolean, job_url string, description string, site string, date_posted date")
    got = [r.published_at for r in G.posting_projection(df, "2024-02-01", F.lit(False)).orderBy("seq").collect()]
    assert got == ["05/01/2024", "N/A"]


def test_digits_of_other_scripts(spark):
    """Counts are read in any script; the ISO parser takes such digits in some places only."""
    rows = ["٣ dias", "３ semanas", "há ३ dias", "２０２４-01-1５", "2024-０1-15", "１２/０３/2024 x", "٣ anos e mais"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, d string")
    got = [r.o for r in df.select("i", D.format_date("d", "2024-02-01").alias("o")).orderBy("i").collect()]
    assert got == ["29/01/2024", "11/01/2024", "01/02/2024", "15/01/2024", "N/A", "１２/０３/2024 x", "٣ anos e m"]
    legacy = [r.o for r in df.select("i", D.format_date_legacy("d").alias("o")).orderBy("i").collect()]
    assert legacy[3:5] == ["15/01/2024", "2024-０1-15"]
