"""Operator 12: periodic runs of words, by seeds and extension along diagonals.

A run is a stretch of words with smallest period ``q`` and at least ``max(6, 4 q)`` words
that can't be made longer with this period. Words ``q`` apart are a *diagonal* of lag
``q``; a run is a stretch of equal words on it, ``max(6, 4 q) - q`` long or longer.

Seeds. Lags are handled in bands, 1 to 5, 6 to 10, 11 to 20, 21 to 40 and so on; the band
that ends at ``k`` has k-grams as seeds (5 is what a run of period 1 guarantees, and
above it ``3 q > k``). Within a run of period ``q <= k`` the next occurrence of its k-gram
is exactly ``q`` words on: a nearer one would give a stretch of ``d + k >= d + q`` words with
periods ``d`` and ``q``, hence with their greatest common divisor, and ``q`` would not be
the smallest. So consecutive occurrences are all the pairs a band needs, and their number
is below that of the words. K-grams are known by exact ranks, each length made from pairs
of ranks of half of it, so no hash can collide; where no k-gram occurs twice, no longer one
does, and the bands end.

Extension. A seed pair is extended both ways along its diagonal. A table of the furthest
covered word of each lag leaves out the pairs that an extension has passed already.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsift.llm.store import ship

LEAST = 6       # words of a run
TIMES = 4       # periods of a run
SEED = 5        # LEAST - 1: the words that a run of period 1 is sure to have on its diagonal
BATCH = 512
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
SCHEMA = ("doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, "
          "best struct<start:long,length:long,period:long>, collapsed binary")

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def word_ids(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers from 0 on."""
    number = {word: i for i, word in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def seed_keys(ids: np.ndarray) -> np.ndarray:
    """A number for each stretch of ``SEED`` words, equal for equal stretches only."""
    n, kinds = len(ids) - SEED + 1, int(ids.max()) + 1
    if kinds ** SEED < 1 << 62:
        keys = ids[:n].copy()
        for i in range(1, SEED):
            keys = keys * kinds + ids[i : n + i]
        return keys
    two = _dense(ids[:-1] * kinds + ids[1:])
    four = _dense(two[:-2] * len(two) + two[2:])
    return four[:n] * kinds + ids[SEED - 1 :]


def extend(ids: np.ndarray, at: int, lag: int, k: int) -> tuple[int, int]:
    """Start and end of the longest stretch of period ``lag`` around two equal k-grams."""
    n, end, step = len(ids), at + lag + k, 64
    while end < n:
        upto = min(n, end + step)
        other = np.flatnonzero(ids[end:upto] != ids[end - lag : upto - lag])
        if len(other):
            end += int(other[0])
            break
        end, step = upto, 2 * step
    start, step = at, 64
    while start > 0:
        down = max(0, start - step)
        other = np.flatnonzero(ids[down:start] != ids[down + lag : start + lag])
        if len(other):
            start = down + int(other[-1]) + 1
            break
        start, step = down, 2 * step
    return start, end


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` by start, then period."""
    n, found = len(ids), []
    if n < LEAST:
        return found
    furthest: dict[int, int] = {}
    keys, k, least = seed_keys(ids), SEED, 1
    while True:
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        again = ranked[1:] == ranked[:-1]
        if not again.any():
            break
        left, lag = order[:-1][again], np.diff(order)[again]
        fits = (lag >= least) & (lag <= k)
        left, lag = left[fits], lag[fits]
        by_place = np.argsort(left, kind="stable")
        for at, q in zip(left[by_place].tolist(), lag[by_place].tolist()):
            if at < furthest.get(q, 0):
                continue
            start, end = extend(ids, at, q, k)
            furthest[q] = end - q
            if end - start >= max(LEAST, TIMES * q):
                found.append((start, end - start, q))
        if TIMES * (k + 1) > n:
            break
        rank = np.empty(len(keys), dtype=np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(~again)))
        more = n - 2 * k + 1
        keys = rank[:more] * len(keys) + rank[k : k + more]
        least, k = k + 1, 2 * k
    return sorted(found, key=lambda run: (run[0], run[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period, compared exactly; the first of equals."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that some run holds after its first period, joined by one space."""
    if runs:
        step = np.zeros(len(words) + 1, dtype=np.int64)
        for start, length, period in runs:
            step[start + period] += 1
            step[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(step)[:-1] == 0)]
    return b" ".join(words)


def plant_run(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """For one document in ten, by its id, the words from a drawn place on repeat with a drawn period."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _finder(rewrite: Rewrite | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                counts, every, best, texts = [], [], [], []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words = (text or b"").split()
                    if rewrite is not None:
                        words = rewrite(doc_id, words)
                    runs = find_runs(word_ids(words))
                    counts.append(len(words))
                    every.append(runs)
                    best.append(strongest(runs))
                    texts.append(collapse(words, runs))
                ends = np.cumsum([0] + [len(runs) for runs in every])
                flat = np.array([run for runs in every for run in runs], dtype=np.int64).reshape(-1, 3)
                columns = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(RUN))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), columns),
                     pa.array([b and dict(zip(("start", "length", "period"), b)) for b in best], RUN), pa.array(texts, pa.binary())],
                    names=["doc_id", "n_words", "runs", "best", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """All periodic runs of every whole text of ``docs(doc_id, text, ...)``.

    Words are the runs ``[^\\x20\\x09-\\x0D]+``, numbered from 0, compared as they are.
    ``rewrite(doc_id, words)`` may change the words first (``plant_run`` makes known runs).

    Returns ``doc_id, n_words, runs, best, collapsed``: every run (``start, length, period``)
    by start, then period; the one of most periods, exactly compared (ties: the smallest
    start, then period; null without a run); and the text without the words that a run
    holds after its first period, joined by one space.

    Null and empty texts, and those of white space only, have no words, no runs and an empty
    collapsed text. Every row comes back once, repeated ones and null ids too. An empty
    table gives no rows. Other columns are not read. No shuffle; a text is held by one task
    and takes O(n log n) a band, O(log n) bands.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(_finder(rewrite), SCHEMA).withColumn("collapsed", F.col("collapsed").cast("string"))
