"""Operator 1: near-duplicate documents by min-max hashing.

Every permutation of the shingle hashes keeps its minimum **and** its maximum, so
``PERMUTATIONS`` hash evaluations give twice as many signature values, each an unbiased
vote on the Jaccard similarity. Bands mix minima and maxima of different permutations.

How the work is spread:

* Documents with equal shingle sets are one class (grouped by a 128-bit set print);
  only the class representative, its smallest ``doc_id``, goes on.
* A bucket (band, key) first compares each member with the bucket's smallest member
  only. Each representative is checked against the one of these that it met in most
  buckets, then components are formed.
* Members of a bucket that are still in different components are then paired, except
  those of the bucket's most frequent component among themselves: they are already
  connected, so their links can't change a component. No other pair is left out.
* Set sizes (exactly) and a sketch of two mixed bits a signature value (four standard
  deviations beyond the threshold) set far pairs aside inside that join; every other
  pair is confirmed on the full shingle sets, and so is every pair with a set of fewer
  than ``SMALL`` shingles, whatever its sketch.

Bands are as long as lets a pair at the threshold share none with a probability of at most
``MISS``: at 0.85 it is 1.5e-4 (40 bands of 10), and 3e-8 for pairs of 0.9.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsift.llm.components import components
from jobsift.llm.shingles import WIDTH, mix, overlap, shingle_set
from jobsift.llm.store import keep, ship

PERMUTATIONS = 200
MISS = 3e-4                         # a pair at the threshold shares no band at most so often
SKETCH = 384                        # signature values, two bits each
PERCENT = 85

_RNG = np.random.default_rng(1414213562)
_A = (_RNG.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)
_ROW = _RNG.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_PICK = _RNG.permutation(2 * PERMUTATIONS)[:SKETCH]
DEVIATIONS = 4.0
SMALL = 64                          # shingles; pairs with a smaller set skip the sketch
LONGS = SKETCH // 32


def signature(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of every permutation of a non-empty shingle set."""
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, dtype=np.uint32)
    high = np.zeros(PERMUTATIONS, dtype=np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 1024):
        values = _A[:, None] * short[None, at : at + 1024] + _B[:, None]
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    return low, high


def band_half(percent: int) -> int:
    """Minima, and as many maxima, in a band: the most that keep misses within ``MISS``."""
    j = percent / 100
    return max([1, *(h for h in range(1, 21) if (1 - j ** (2 * h)) ** (PERMUTATIONS // h) <= MISS)])


def band_keys(low: np.ndarray, high: np.ndarray, half: int) -> np.ndarray:
    """One 64-bit key a band; the maxima come from permutations half a turn away."""
    bands = PERMUTATIONS // half
    turned = np.roll(high, PERMUTATIONS // 2)
    rows = np.concatenate([x[: bands * half].reshape(bands, half) for x in (low, turned)], axis=1).astype(np.uint64)
    return mix((rows * _ROW[: 2 * half]).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))


ROWS = 256      # texts that are Python objects at a time


_SIGNED = "doc_id long, n_shingles long, print binary, bands array<long>, sketch array<long>"


def _sign(half: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(batch.schema.get_field_index("text"))
            for at in range(0, batch.num_rows, ROWS):
                count, prints, bands, sketches = [], [], [], []
                for text in texts.slice(at, ROWS).to_pylist():
                    found = shingle_set(text)
                    count.append(len(found))
                    if len(found) == 0:
                        prints.append(None), bands.append(None), sketches.append(None)
                        continue
                    total = np.array([found.sum(dtype=np.uint64), mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)])
                    prints.append(total.tobytes())
                    low, high = signature(found)
                    bands.append(band_keys(low, high, half).view(np.int64))
                    sketches.append(sketch(low, high))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, ROWS), pa.array(count, pa.int64()), pa.array(prints, pa.binary()),
                     pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "print", "bands", "sketch"])
        pa.default_memory_pool().release_unused()

    return run


def sketch(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Two bits of every mixed signature value, in ``LONGS`` longs.

    A value's own low bits won't do: they follow from the shingle's, alike in all permutations.
    """
    value = mix(np.concatenate((low, high))[_PICK].astype(np.uint64))
    bits = np.concatenate((value & np.uint64(1), value >> np.uint64(1) & np.uint64(1)))
    return np.packbits(bits.astype(bool)).view(np.int64)


def _near(percent: int) -> Column:
    """Whether sketches ``sa*`` and ``sb*`` differ in no more bits than those of linked texts.

    Equal signature values agree; each bit of others differs in half of the cases.
    """
    apart = 1 - percent / 100
    spread = SKETCH * (apart / 2 + apart * (1 - apart))
    differing = [F.bit_count(F.col(f"sa{i}").bitwiseXOR(F.col(f"sb{i}"))) for i in range(LONGS)]
    return sum(differing[1:], differing[0]) <= int(SKETCH * apart + DEVIATIONS * spread ** 0.5)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, None
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, ROWS):
                for x, y, s, t in zip(*(batch.column(i).slice(at, ROWS).to_pylist() for i in range(4))):
                    if x != last:
                        last, mine = x, shingle_set(s)
                    other = shingle_set(t)
                    both = overlap(mine, other)
                    if 100 * both >= percent * (len(mine) + len(other) - both):
                        out.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])
        pa.default_memory_pool().release_unused()

    return run


def _linked(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose full shingle sets are similar enough."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return (pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
            .mapInArrow(_confirm(percent), "a long, b long"))


def minhash_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Group near-duplicate documents: ``100 * |A and B| >= percent * |A or B|``.

    Returns per row of ``docs(doc_id, text, ...)``: ``doc_id, n_shingles, component_id,
    kept``. ``component_id`` is the smallest ``doc_id`` reachable over links, ``kept`` is
    ``doc_id = component_id``.

    Null, empty and blank texts have ``n_shingles`` 0 and stay alone. Rows with a null
    ``doc_id`` come back with null ``component_id`` and ``kept`` true. Rows of one
    ``doc_id`` are one node, with the links of all its texts; each row keeps its own
    ``n_shingles``. Other columns of ``docs`` are not read, so clashing names do no harm.
    An empty table gives no rows.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    signed = keep(texts.mapInArrow(_sign(band_half(percent)), _SIGNED), "signed")
    s = signed.df.where("print is not null and doc_id is not null")

    classes = keep(s.groupBy("print").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("bands", "sketch", "n_shingles"), "doc_id").alias("of")), "classes")
    reps = classes.df.select("rep", F.explode("of.bands").alias("key"))
    sketches = classes.df.select("rep", "of.n_shingles", "of.bands", *[F.get("of.sketch", F.lit(i)).alias(f"s{i}") for i in range(LONGS)])
    hubs = reps.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = keep(reps.join(hubs, "key").select("key", "rep", "hub"), "members")
    met = members.df.where("rep <> hub").groupBy("rep", "hub").agg(F.count(F.lit(1)).alias("n"))
    first = met.groupBy("rep").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("hub")).select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    star = keep(_linked(first, texts, percent), "star")
    near = components(star.df)

    placed = keep(members.df.join(near, members.df["rep"] == near["node"], "left")
                  .select("key", "rep", F.coalesce("component", "rep").alias("component")), "placed")
    members.drop()
    sizes = placed.df.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    most = (sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("kinds"))
            .where("kinds > 1"))
    open_ = keep(placed.df.join(most, "key").join(sketches, "rep").select("key", "rep", "component", "top", "n_shingles", "bands", *[f"s{i}" for i in range(LONGS)]), "open")
    minor = open_.df.where("component <> top").select("key", F.col("rep").alias("a"), F.col("component").alias("ca"), F.col("n_shingles").alias("na"), F.col("bands").alias("ba"), *[F.col(f"s{i}").alias(f"sa{i}") for i in range(LONGS)])
    every = open_.df.select("key", F.col("rep").alias("b"), F.col("component").alias("cb"), (F.col("component") == F.col("top")).alias("main"), F.col("n_shingles").alias("nb"), F.col("bands").alias("bb"), *[F.col(f"s{i}").alias(f"sb{i}") for i in range(LONGS)])
    # a pair is emitted in the first of the buckets that it shares
    apart = F.expr(f"ca <> cb and (main or a < b) and 100 * least(na, nb) >= {percent} * greatest(na, nb)") & ((F.least("na", "nb") < SMALL) | _near(percent))
    first_met = F.array_min(F.array_intersect("ba", "bb")) == minor["key"]
    crossing = minor.join(every, (minor["key"] == every["key"]) & F.when(apart, first_met).otherwise(False))
    close = keep(crossing.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "close")
    rest = keep(_linked(close.df, texts, percent), "rest")

    same = s.join(classes.df.select("print", "rep"), "print").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    label = components(star.df.union(rest.df).union(same))
    for done in (placed, open_, close, star, rest, classes):
        done.drop()
    out = signed.df.select("doc_id", "n_shingles").join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    found = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", found.alias("component_id"), F.coalesce(found == F.col("doc_id"), F.lit(True)).alias("kept"))


__all__ = ["PERMUTATIONS", "WIDTH", "minhash_dedup"]
