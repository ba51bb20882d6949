"""Term matching (D4-D6) as joins of word positions: no text is joined, exploded or shuffled.

A term is relevant to a posting when one of its words is part of a word of the title (D4),
or when its words stand one after the other in the description (D5).

- **Descriptions** are rows (posting, word, position). A phrase starts from its *rarest*
  word in the postings at hand: the positions of that word fix where the phrase would begin,
  and the other words are looked up at the positions this asks for.
- **Titles** are rows (posting, word). Parts of words are sought in the *vocabulary* of
  title words, once a distinct word, by an equi-join of the word's parts; the words found
  then lead to the postings.

Both meet the searches' countries, ages and remote flags in their first join, before
anything is verified. ``Words`` is where the rows come from: ``FrameWords`` makes them from
postings, ``jobsift.sources.store`` reads them from a stored index.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobsift.functions import text as X
from jobsift.operators import relevance as D
from jobsift.operators.dedup import cut_lineage
from jobsift.operators.rank import first_rows

KEYS = ("source_no", "seq")
FACTS = ("country", "is_remote", "posted_at")
LONG_WORD = 64          # letters of a title word whose parts are all made
MANY = 1_000            # tokens of terms beyond which a token's postings are found once for all terms
FIRST_ROWS = 20_000     # title words in the first slice of arrival order
GROWTH = 8
FEW_HITS = 64           # of a token, sorted rather than looked through once more
RUN = 3                 # words of a description that are looked up as one
BITS = 1 << 26          # of the array that tells which words are asked for


def description_words(postings: DataFrame) -> DataFrame:
    """(keys, facts, pos, word) of every word of the normalised descriptions."""
    split = postings.select(*KEYS, *FACTS, F.split(X.normalize_text("description"), " ").alias("_words"))
    # the outer form: for the other one Spark adds a filter that normalises the text again
    return split.select(*KEYS, *FACTS, F.posexplode_outer("_words").alias("pos", "word")).where("word <> ''")


def title_words(postings: DataFrame) -> DataFrame:
    """(keys, facts, word) of the distinct words of the normalised titles."""
    split = postings.select(*KEYS, *FACTS, F.array_distinct(F.split(X.normalize_text("title"), " ")).alias("_words"))
    return split.select(*KEYS, *FACTS, F.explode_outer("_words").alias("word")).where("word <> ''")


class Words(Protocol):
    """The word rows of some postings. A "word" of a description is up to ``longest`` words that follow each other."""

    longest: int

    def apart(self) -> list[Words]:
        """The rows in shares that are matched one by one: each posting in one of them."""

    def counts(self, words: DataFrame) -> DataFrame:
        """(word, n): how many positions of descriptions hold each of ``words(word)``."""

    def positions(self, words: DataFrame) -> DataFrame:
        """``description_words`` rows, those of ``words(word)`` at least, of the words that ``counts`` was asked for."""

    def title_vocabulary(self) -> DataFrame:
        """(word) of the titles, distinct."""

    def titles(self, words: DataFrame) -> DataFrame:
        """``title_words`` rows, those of ``words(word)`` at least."""


def among(words: DataFrame) -> Callable[[Column], Column]:
    """A test whether a text can be one of ``words(word)``: never false for one that is.

    The hashes of the words set bits of an array of at most ``BITS`` bits, which tasks look
    into; no row is shuffled for the test.
    """
    hashes, told = cut_lineage(words.select(F.xxhash64("word").alias("_h")), {"n": F.count(F.lit(1))})
    bits = min(BITS, max(1 << 12, 1 << (16 * told["n"]).bit_length()))
    at = F.col("_h").bitwiseAND(F.lit(bits - 1))
    filled = hashes.select(F.shiftright(at, 6).alias("i"), F.expr(f"shiftleft(1L, cast(_h & 63 as int))").alias("v")).groupBy("i").agg(F.bit_or("v").alias("v"))
    every = words.sparkSession.range(bits // 64).select(F.col("id").alias("i"))
    placed = F.array_sort(F.collect_list(F.struct("i", F.coalesce("v", F.lit(0).cast("long")).alias("v"))))
    array = cut_lineage(every.join(filled, "i", "left").agg(placed.alias("_p")).select(F.transform("_p", lambda x: x["v"]).alias("bits"))).scalar()

    def asked(text: Column) -> Column:
        h = F.xxhash64(text)
        return F.getbit(F.get(array, F.shiftright(h.bitwiseAND(F.lit(bits - 1)), 6).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1

    return asked


class FrameWords:
    """Word rows of a frame of postings, written once: one pass over the texts.

    Of the descriptions the rows of the words asked for are kept (``pos`` from 0 on), of the
    titles all (``pos`` -1). Words asked for are runs of up to ``RUN`` words. Postings that
    share a key, or have none, are matched by single words, whose places count together.
    """

    def __init__(self, postings: DataFrame, longest: int = RUN, without: DataFrame | None = None):
        self.postings, self.longest, self.without, self.rows = postings, longest, without, None

    def apart(self) -> list[Words]:
        none = F.col(KEYS[0]).isNull() | F.col(KEYS[1]).isNull()
        shared, told = cut_lineage(self.postings.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) | none).drop("_n"), {"n": F.count(F.lit(1))})
        if not told["n"]:
            return [self]
        others = self.postings.where(none).unionByName(self.postings.join(shared, list(KEYS), "left_semi"))
        return [FrameWords(self.postings.where(~none), self.longest, shared), FrameWords(others, 1)]

    def counts(self, words: DataFrame) -> DataFrame:
        asked = among(words)
        split = self.postings.select(*KEYS, *FACTS, F.split(X.normalize_text("description"), " ").alias("_0"),
                                     F.array_distinct(F.split(X.normalize_text("title"), " ")).alias("_t"))
        later = [F.slice("_0", F.lit(k + 1), F.size("_0")).alias(f"_{k}") for k in range(1, self.longest)]
        names = [f"_{k}" for k in range(self.longest)]
        # the word of every place and those after it; beside them a word of the title
        zipped = split.select("*", *later).select(*KEYS, *FACTS, F.posexplode_outer(F.arrays_zip(*names, "_t")).alias("pos", "_w")).select(*KEYS, *FACTS, "pos", "_w.*")
        runs = [F.concat_ws(" ", *names[:k + 1]) for k in range(self.longest)]
        met = [F.col(x).isNotNull() & (F.col("_0") != "") & asked(run) for x, run in zip(names, runs)]
        titled = F.col("_t") != ""
        kept = zipped.where(reduce(Column.__or__, [F.coalesce(x, F.lit(False)) for x in [*met, titled]]))
        found = [F.struct("pos", F.when(m, run).alias("word")) for m, run in zip(met, runs)] + [F.struct(F.lit(-1).alias("pos"), F.when(titled, F.col("_t")).alias("word"))]
        rows = kept.select(*KEYS, *FACTS, F.explode(F.array(*found)).alias("_r")).select(*KEYS, *FACTS, "_r.pos", "_r.word").where(F.col("word").isNotNull())
        self.rows = cut_lineage(rows if self.without is None else rows.join(self.without, list(KEYS), "left_anti"))
        return self.rows.where("pos >= 0").groupBy("word").agg(F.count(F.lit(1)).alias("n"))

    def positions(self, words: DataFrame) -> DataFrame:
        return self.rows.where("pos >= 0")

    def title_vocabulary(self) -> DataFrame:
        return self.titles(None).select("word").distinct()

    def titles(self, words: DataFrame) -> DataFrame:
        return self.rows.where("pos < 0").drop("pos")


def _fits(as_of: str) -> Column:
    """Whether a posting can be of use to some search for the term in its country."""
    return D.recency(F.col("posted_at"), F.col("most_hours"), as_of) & (F.col("any_place") | F.coalesce("is_remote", F.lit(False)))


def asked_by(classes: DataFrame) -> DataFrame:
    """Per term and country the widest that any search asks for: the greatest age (null: all), any place."""
    most = F.when(F.bool_or(F.col("hours_old").isNull()), F.lit(None)).otherwise(F.max("hours_old")).cast("int")
    return classes.groupBy("_term", "country").agg(most.alias("most_hours"), F.bool_or(~F.col("remote_search")).alias("any_place"))


def phrase_matches(words: Words, classes: DataFrame, as_of: str) -> DataFrame:
    """(keys, facts, _term) of the postings whose description holds the whole term.

    A term of more than ``longest`` words is cut into runs of as many, the last one ending with it.
    """
    most = words.longest
    split = classes.where("term_norm <> ''").select("_term", "term_norm").distinct().select("_term", F.split("term_norm", " ").alias("_words"))
    size = F.size("_words")
    places = F.transform(F.sequence(F.lit(0), F.ceil(size / most).cast("int") - 1), lambda i: F.greatest(F.lit(0), F.least(i * most, size - most)))
    parts = cut_lineage(split.select("_term", "_words", F.size(places).alias("length"), F.explode(places).alias("at"))
                        .select("_term", "length", "at", F.array_join(F.slice("_words", F.col("at") + 1, F.lit(most)), " ").alias("word")))
    counted = parts.join(words.counts(parts.select("word").distinct()), "word")
    # a phrase with a run that no description has falls out: fewer parts than its length
    rarest = (counted.groupBy("_term", "length").agg(F.count(F.lit(1)).alias("found"), F.min_by(F.struct("at", "word"), F.struct("n", "at")).alias("_r"))
              .where(F.col("found") == F.col("length")).select("_term", "length", "_r.at", "_r.word"))
    lead = cut_lineage(rarest.join(asked_by(classes), "_term"))

    def starts(of: DataFrame) -> DataFrame:
        held = words.positions(of.select("word").distinct())
        return (held.join(of, ["word", "country"]).where(_fits(as_of) & (F.col("pos") >= F.col("at")))
                .select(*KEYS, *FACTS, "_term", "length", (F.col("pos") - F.col("at")).alias("start")))

    single = starts(lead.where("length = 1")).select(*KEYS, *FACTS, "_term")
    wanted = starts(lead.where("length > 1")).join(parts.drop("length"), "_term").withColumn("pos", F.col("start") + F.col("at")).drop("at")
    # the runs of a cut phrase all have as many words
    rest = words.positions(parts.where("length > 1").select("word").distinct()).where(F.size(F.split("word", " ")) == most).select(*KEYS, "word", "pos")
    whole = (wanted.join(rest, [*KEYS, "word", "pos"]).groupBy(*KEYS, *FACTS, "_term", "start", "length").agg(F.count(F.lit(1)).alias("found"))
             .where(F.col("found") == F.col("length")).select(*KEYS, *FACTS, "_term"))
    return single.union(whole)


def _held(vocabulary: DataFrame, tokens: DataFrame) -> DataFrame:
    """(word, _token): the words of ``vocabulary(word)`` with the ``tokens(_token)`` that are part of them.

    A word's parts, as long as some token, meet the tokens in an equi-join. Words above
    ``LONG_WORD`` letters have too many parts: they are sought by their tokens' first three
    letters and looked through.
    """
    lengths = sorted(r[0] for r in tokens.select(F.length("_token").alias("n")).where(F.col("n") <= LONG_WORD).distinct().collect())
    word = F.col("word")
    dealt = vocabulary.where(F.length("word") > 2).repartition("word")

    def parts(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(word) - (n - 1)), lambda i: F.substring(word, i, F.lit(n)))
        return F.when(F.length(word) >= n, every).otherwise(F.array().cast("array<string>"))

    cut = [parts(n) for n in lengths]
    short = dealt.where(F.length("word") <= LONG_WORD).select("word", F.explode(F.array_distinct(F.flatten(F.array(*cut)))).alias("_token")) if cut else None
    starts = F.sequence(F.lit(1), F.length(word) - 2)
    anchored = dealt.where(F.length("word") > LONG_WORD).select("word", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(word, i, F.lit(3))))).alias("_anchor"))
    long_ = anchored.join(tokens.withColumn("_anchor", F.substring("_token", 1, 3)), "_anchor").where(F.contains("word", "_token")).select("word", "_token").distinct()
    return long_ if short is None else short.join(tokens, "_token").select("word", "_token").union(long_)


def _place() -> Column:
    """A posting's place in arrival order as one number (postings far apart in time may share it, none change places)."""
    return F.col("source_no") * F.lit(2.0 ** 64) + F.col("seq").cast("double")


def _first_titles(titles: DataFrame, held: DataFrame, classes: DataFrame, tokens: DataFrame, as_of: str) -> DataFrame:
    """``title_matches`` for many terms: of each class all postings that can be among its first ``limit``.

    The first postings of a term are among the first of its tokens, so these are found once
    a token and search shape (country, place, age), whatever number of terms share it. The
    titles are taken in slices of arrival order, each ``GROWTH`` times the last; a token that has
    its limit asks for nothing more. No limit: all slices.
    """
    shape = ["country", "remote_search", "hours_old"]
    limit = F.when(F.bool_or(F.col("limit").isNull()), F.lit(None)).otherwise(F.max("limit")).cast("long")
    asked = tokens.join(classes.drop("tokens"), "_term")
    wanted = cut_lineage(asked.groupBy("_token", *shape).agg(limit.alias("limit")).withColumn("_no", F.monotonically_increasing_id()))
    w = wanted.select(F.col("_token").alias("_t"), *[F.col(c).alias(f"_{c}") for c in shape], "_no")
    same = (F.col("_token") == F.col("_t")) & F.col("country").eqNullSafe(F.col("_country")) & F.col("remote_search").eqNullSafe(F.col("_remote_search")) & F.col("hours_old").eqNullSafe(F.col("_hours_old"))
    terms = cut_lineage(asked.join(w, same).select("_term", "_no").distinct())
    rows = titles.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    shares, share = [], FIRST_ROWS / max(rows, 1)
    while share < 1:
        shares.append(share)
        share *= GROWTH
    edges = titles.agg(F.percentile_approx(_place(), shares, 10_000).alias("e")).first()["e"] or [] if shares else []
    edges = [None, *sorted(set(edges)), None]
    open_, found = wanted, []
    fits = D.recency(F.col("posted_at"), F.col("hours_old"), as_of) & (~F.col("remote_search") | F.coalesce("is_remote", F.lit(False)))
    for low, high in zip(edges, edges[1:]):
        here = titles
        if low is not None:
            here = here.where(_place() > low)
        if high is not None:
            here = here.where(_place() <= high)
        met = here.join(held, "word").select(*KEYS, *FACTS, "_token").distinct().join(open_, ["_token", "country"]).where(fits)
        found.append(cut_lineage(met.select(*KEYS, *FACTS, "_no", "limit")))
        if high is not None:
            counted = reduce(DataFrame.union, found).groupBy("_no").agg(F.count(F.lit(1)).alias("_n"))
            open_ = cut_lineage(wanted.join(counted, "_no", "left").where("limit is null or coalesce(_n, 0) < limit").drop("_n"))
    every = reduce(DataFrame.union, found)
    few = first_rows(every.where("limit is not null"), "_no", list(KEYS), "limit", few=FEW_HITS)
    first = few.withColumn("_rn", F.row_number().over(Window.partitionBy("_no").orderBy(*KEYS))).where("_rn <= limit").drop("_rn")
    return first.union(every.where("limit is null")).join(terms, "_no").select(*KEYS, *FACTS, "_term")


def title_matches(words: list[Words], classes: DataFrame, as_of: str) -> DataFrame:
    """(keys, facts, _term) of the postings with a title word that holds a word of the term.

    Of many terms with a ``limit`` those postings that can be among the class's first ones.
    """
    tokens, told = cut_lineage(classes.select("_term", F.explode("tokens").alias("_token")).distinct(), {"n": F.count(F.lit(1))})
    vocabulary = words[0].title_vocabulary() if len(words) == 1 else reduce(DataFrame.union, [w.title_vocabulary() for w in words]).distinct()
    held = cut_lineage(_held(vocabulary, tokens.select("_token").distinct()))

    def titles(of: DataFrame) -> DataFrame:
        return reduce(DataFrame.unionByName, [w.titles(of) for w in words])

    if told["n"] > MANY and "limit" in classes.columns:
        return _first_titles(titles(held.select("word").distinct()), held, classes, tokens, as_of)
    lead = held.join(tokens, "_token").select("word", "_term").distinct().join(asked_by(classes), "_term")
    return titles(lead.select("word").distinct()).join(lead, ["word", "country"]).where(_fits(as_of)).select(*KEYS, *FACTS, "_term")


def term_matches(words: Words, classes: DataFrame, as_of: str) -> DataFrame:
    """(keys, facts, _term) of the postings relevant to the terms of ``classes``, some rows more than once.

    ``classes`` has distinct ``term_norm, tokens, country, remote_search, hours_old``, the number
    ``_term`` of the term, and may have a ``limit``: postings that can't be among a class's first
    so many may be left out. A posting is left out where no class asks for its country, age or
    place. Empty terms, which match every description, are none of this function's business.
    """
    shares = words.apart()
    phrases = reduce(DataFrame.union, [phrase_matches(w, classes, as_of) for w in shares])
    return phrases.union(title_matches(shares, classes, as_of))
