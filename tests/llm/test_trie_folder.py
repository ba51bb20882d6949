"""Operator 8 maps its files only where the shared folder is a file system of the machines."""

from jobsift.llm.ngram_lm import mapped_path


def test_the_file_system_decides_and_not_the_spelling(spark):
    assert mapped_path(spark, "/ck/a") == mapped_path(spark, "file:/ck/a") == mapped_path(spark, "file:///ck/a") == "/ck/a"
    assert mapped_path(spark, "hdfs://127.0.0.1:1/ck/a") is None
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "hdfs://127.0.0.1:1")
    try:
        assert mapped_path(spark, "/ck/a") is None
        assert mapped_path(spark, "file:/ck/a") == "/ck/a"
    finally:
        conf.set("fs.defaultFS", before)
