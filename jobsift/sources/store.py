"""A stored postings table with a word index, for scans that read little of it.

- ``postings``: the rows, in folders by country and day of posting. A scan limited by age
  lists only the folders it needs, and rows are fetched from the folders of picked keys.
- ``description``: a row a word of a description (keys, facts, position), in a part an
  extension and buckets of the word's hash, sorted by the posting's time, so a look-up reads
  of its words' buckets the row groups of its age.
- ``title``: the same for the distinct words of titles; ``vocabulary``: these words.
- ``counts``: how many positions each description word has, one part an extension.

``extend`` appends new postings to all of them and counts the part it wrote; nothing stored
before is read or rewritten but the vocabulary's words. Matching (``jobsift.sources.matching``) runs on the index alone: a phrase is
met through its rarest word by the stored counts, and no text is read to test it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.operators import relevance as D
from jobsift.operators.dedup import cut_lineage
from jobsift.sources import matching as M
from jobsift.sources.scan import SCRAPE_SITES, site_filter

BUCKETS = 16


def word_bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


class PostingStore:
    """The store at ``path``; a source for ``scan.posting_scan`` and ``pipelines.intake``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _part(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._part(name))

    def extend(self, postings: DataFrame) -> None:
        """Append ``postings``; each key must be new. One writer at a time."""
        # adaptive execution splits the work of a hot day or word: no pass over the texts to find ranges
        rows = postings.withColumn("posted_day", F.to_date("posted_at")).hint("rebalance", "country", "posted_day")
        rows.write.mode("append").partitionBy("country", "posted_day").parquet(self._part("postings"))
        listed = postings.where(site_filter(sites=SCRAPE_SITES)).select(*M.KEYS, *M.FACTS, "title", "description")
        part = f"p{uuid.uuid4().hex}"
        for name, words in (("description", M.description_words(listed)), ("title", M.title_words(listed))):
            rows = words.withColumn("part", F.lit(part)).withColumn("bucket", word_bucket(F.col("word")))
            dealt = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "posted_at")
            dealt.write.mode("append").partitionBy("part", "bucket").parquet(self._part(name))
            made = self.spark.read.schema(rows.schema).parquet(self._part(name)).where(F.col("part") == part)
            if name == "description":
                total = made.groupBy("bucket", "word").agg(F.count(F.lit(1)).alias("n"))
                total.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self._part("counts"))
            else:
                every = made.select("word").distinct()
                fresh = every.join(self._read("vocabulary"), "word", "left_anti") if self._exists("vocabulary") else every
                cut_lineage(fresh).write.mode("append").parquet(self._part("vocabulary"))

    def _exists(self, name: str) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._part(name))
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def kept(self, oldest_hours: int | None, sites, as_of: str) -> DataFrame:
        """The postings of the sites, read from the days that the age allows."""
        rows = self._read("postings").where(site_filter(sites=sites))
        if oldest_hours is None:
            return rows
        first = F.to_date(F.timestamp_seconds(F.unix_seconds(F.to_timestamp(F.lit(as_of))) - oldest_hours * 3600))
        return rows.where((F.col("posted_day") >= first) & D.recency(F.col("posted_at"), F.lit(oldest_hours), as_of))

    def rows(self, picked: DataFrame) -> DataFrame:
        """The postings picked, from their days' and countries' folders only.

        The folders are those that the picks name: at most countries times days.
        """
        keys = cut_lineage(picked.select(*M.KEYS, "country", F.to_date("posted_at").alias("posted_day")).distinct())
        folders = keys.groupBy("country").agg(F.collect_set("posted_day").alias("days")).collect()
        wanted = F.lit(False)
        for country, days in folders:
            wanted = wanted | ((F.col("country") == country) & F.col("posted_day").isin(days))
        return self._read("postings").where(wanted).join(keys, [*M.KEYS, "country", "posted_day"], "left_semi").drop("posted_day")

    def words(self, oldest_hours: int | None, sites, as_of: str) -> M.Words:
        if set(sites) != set(SCRAPE_SITES):
            raise ValueError("the index holds the postings of the scraped sites")
        return StoredWords(self, oldest_hours, as_of)


class StoredWords:
    """The index as word rows: buckets of the words asked for, row groups of the age."""

    longest = 1

    def __init__(self, store: PostingStore, oldest_hours: int | None, as_of: str):
        self.store, self.oldest, self.as_of = store, oldest_hours, as_of

    def apart(self) -> list[M.Words]:
        return [self]

    def _of(self, name: str, words: DataFrame) -> DataFrame:
        words = cut_lineage(words)
        touched = [r[0] for r in words.select(word_bucket(F.col("word"))).distinct().collect()]
        rows = self.store._read(name).where(F.col("bucket").isin(touched))
        if self.oldest is not None and name != "counts":
            rows = rows.where(D.recency(F.col("posted_at"), F.lit(self.oldest), self.as_of))
        return rows.join(words, "word", "left_semi").drop("bucket", "part")

    def counts(self, words: DataFrame) -> DataFrame:
        return self._of("counts", words).groupBy("word").agg(F.sum("n").alias("n"))

    def positions(self, words: DataFrame) -> DataFrame:
        return self._of("description", words)

    def title_vocabulary(self) -> DataFrame:
        return self.store._read("vocabulary")

    def titles(self, words: DataFrame) -> DataFrame:
        return self._of("title", words)
