"""Operator 9: benchmark passages in documents, found by SimHash of item-sized windows.

Built-in functions only. The steps:

1. Documents and items become words (letters and digits, lower case) and hashes of their
   five-word shingles. An item with fewer words is one shingle of all of them.
2. A window of a document is as long as the item it is held against. A window that shares
   no shingle with an item has similarity 0, so windows are laid only where a document
   shingle equals an item shingle, aligned to it.
3. Each window's shingles, with multiplicity, vote on a 64-bit SimHash. Per-bit counts
   are sums of bit-sliced integers (two 32-bit counters in a long), wide enough for the
   longest array, taken over each row's array in place.
4. Multi-index Hamming: the fingerprint is split into ``RADIUS + 1`` blocks. Two
   fingerprints within ``RADIUS`` agree on at least one block, so the equi-join on
   (item, block number, block value) misses none of them.
5. Pairs within the radius are confirmed by the exact weighted similarity: shingles
   weigh as often as they occur, sum of minima over sum of maxima.

Random shingle sets of similarity 0.8 lie within Hamming distance 23 but for about 1 in
100,000 (5 to 200 shingles, simulated), and nearer ones more surely.

Arrays are exploded by the outer generators: the others would let the optimizer infer a
filter on the array's size, push it below and compute the words anew for every shingle.

The item side is broadcast while its shingles number at most ``BROADCAST_SHINGLES`` (about
40 bytes each). A larger benchmark is joined by a shuffle of single shingles; a text's
shingle array is fetched by a second join, for texts with a hit alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsift.llm.store import keep

WIDTH = 5
PERCENT = 80
RADIUS = 23
BROADCAST_SHINGLES = 1_000_000
_LANES = 32
_SPREAD = 0x0000000100000001


def _words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _grams(words: Column, width: Column | int) -> Column:
    """Hashes of all ``width``-word shingles, in order; empty for shorter texts."""
    last = F.size(words) - F.lit(width) + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
                                        lambda i: F.xxhash64(F.slice(words, i, F.lit(width)))))


def _tagged(shingles: Column) -> Column:
    """The multiset as a set: the k-th occurrence of a shingle becomes an element of its own."""
    numbered = F.transform(shingles, lambda x, i: F.xxhash64(x, F.size(F.filter(F.slice(shingles, F.lit(1), i + 1), lambda y: y == x))))
    return F.when(F.size(F.array_distinct(shingles)) == F.size(shingles), F.transform(shingles, lambda x: F.xxhash64(x, F.lit(1)))).otherwise(numbered)


def simhash(rows: DataFrame, keys: list[str], shingles: str) -> DataFrame:
    """``keys, <shingles>, fingerprint``: the sign of every bit's vote over the shingles.

    A tie of votes sets the bit, and so do no shingles; a null array gives null.
    """
    def add(k: int):
        return lambda total, h: total + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_SPREAD))

    votes = rows.select(*keys, shingles, F.size(shingles).alias("_n"),
                        *[F.aggregate(shingles, F.lit(0).cast("long"), add(k)).alias(f"_v{k}") for k in range(_LANES)])
    bits = []
    for k in range(_LANES):
        for part in range(64 // _LANES):
            ones = F.shiftrightunsigned(f"_v{k}", _LANES * part).bitwiseAND(F.lit((1 << _LANES) - 1))
            bits.append(F.shiftleft((2 * ones >= F.col("_n")).cast("long"), k + _LANES * part))
    return votes.select(*keys, shingles, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fingerprint"))


def _blocks(fingerprint: str, radius: int) -> Column:
    """``radius + 1`` disjoint bit ranges of the fingerprint, numbered."""
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value"))
                     for i, (a, b) in enumerate(zip(cuts, cuts[1:]))])


def _items(benchmark: DataFrame) -> DataFrame:
    """Items with words: their shingles in order, as a tagged set, and its fingerprint."""
    keys = ["item_id", "item_key", "n_words", "width"]
    worded = (benchmark.select("item_id", _words(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
              .select("item_id", F.xxhash64("words").alias("item_key"), F.size("words").alias("n_words"), F.least(F.size("words"), F.lit(WIDTH)).alias("width"), "words")
              .select(*keys, _grams(F.col("words"), F.col("width")).alias("shingles")))
    marked = worded.withColumn("both", F.struct("shingles", _tagged(F.col("shingles")).alias("tagged")))
    prints = simhash(marked.select(*keys, F.col("both.tagged").alias("tagged")), keys, "tagged")
    rows = marked.select(F.xxhash64(*keys).alias("_row"), "shingles")
    return prints.withColumn("_row", F.xxhash64(*keys)).join(rows, "_row").drop("_row")


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """Benchmark items that occur in documents, exactly or nearly.

    Reads ``docs(doc_id, text, ...)`` and ``benchmark(item_id, text, ...)``; other columns
    are not read. Returns ``doc_id, item_id, start, n_words, similarity``, one row for each
    document text and item with a window of weighted shingle similarity of ``percent``
    or more: the best window, the first of equals (``start`` counts words from 0).

    Null and empty texts match nothing; neither do items without words. Null ids are kept
    as they are. Rows of one ``doc_id`` with different texts are held apart, equal ones
    count once. A text shorter than an item is one window. Whole texts are read.
    """
    items = keep(_items(benchmark), "items")
    anchors = items.df.select("item_id", "item_key", "n_words", "width", F.posexplode_outer("shingles").alias("at", "shingle"))
    widths = [r[0] for r in items.df.select("width").distinct().collect()]
    small = items.df.agg(F.sum(F.size("shingles")).alias("n")).first()["n"] or 0
    texts = docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_key"), _words(F.col("text")).alias("words"))
    keys, found = ["doc_id", "text_key", "item_id", "item_key", "n_words", "start"], []
    for width in widths or [WIDTH]:
        grams = texts.select("doc_id", "text_key", F.size("words").alias("size"), _grams(F.col("words"), width).alias("grams"))
        mine = anchors.where(F.col("width") == width).drop("width")
        start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("at"), F.col("size") - F.col("n_words"))).alias("start")
        if small <= BROADCAST_SHINGLES:
            hits = grams.select("*", F.posexplode_outer("grams").alias("pos", "shingle"))
            starts = hits.join(F.broadcast(mine), "shingle").select(*keys[:-1], start, "grams")
        else:
            hits = grams.select("doc_id", "text_key", "size", F.posexplode_outer("grams").alias("pos", "shingle"))
            starts = hits.join(mine, "shingle").select(*keys[:-1], start).distinct()
            whole = grams.select(F.col("doc_id").alias("_doc_id"), F.col("text_key").alias("_text_key"), "grams")
            starts = (starts.join(whole, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_text_key")))
                      .select(*keys, "grams"))
        found.append(starts.select(*keys, F.slice("grams", F.col("start") + 1, F.col("n_words") - width + 1).alias("shingles")))
    laid = reduce(lambda a, b: a.unionByName(b), found).groupBy(*keys).agg(F.first("shingles").alias("shingles"))
    windows = simhash(laid.withColumn("shingles", _tagged(F.col("shingles"))), keys, "shingles")
    windows = windows.select("*", F.explode(_blocks("fingerprint", radius)).alias("b")).select("*", "b.block", "b.value").drop("b")
    index = (items.df.select("item_id", "item_key", F.col("fingerprint").alias("item_print"), F.col("tagged").alias("item_shingles"))
             .select("*", F.explode(_blocks("item_print", radius)).alias("b")).select("*", "b.block", "b.value").drop("b"))
    near = (windows.join(index, ["item_id", "item_key", "block", "value"])
            .where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print"))) <= radius)
            .groupBy(*keys).agg(F.first("shingles").alias("shingles"), F.first("item_shingles").alias("item_shingles")))
    both = F.size(F.array_intersect("shingles", "item_shingles"))
    union = F.size("shingles") + F.size("item_shingles") - both
    return (near.select(*keys, both.alias("both"), union.alias("union")).where(F.col("both") * 100 >= F.col("union") * percent)
            .withColumn("similarity", F.col("both") / F.col("union"))
            .groupBy("doc_id", "text_key", "item_id")
            .agg(F.max_by(F.struct("start", "n_words", "similarity"), F.struct(F.col("similarity"), -F.col("start"), F.col("n_words"))).alias("best"))
            .select("doc_id", "item_id", F.col("best.start").cast("long").alias("start"), F.col("best.n_words").cast("long").alias("n_words"), F.col("best.similarity").alias("similarity"))
            .distinct())
