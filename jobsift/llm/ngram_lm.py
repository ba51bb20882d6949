"""Operator 8: language-model scores from an Elias-Fano n-gram trie.

Training counts word pairs, as hashes, over blocks of texts in the tasks; one shuffle brings
the counts of a context, block by block, to its shard, which adds them up. A word's count is
the sum of its pairs, since every token is the context of one: the end token's next one is a
start mark. All words have a place, and pairs seen at least ``LEAST_PAIR`` times form the
trie's second level under their first word. Words are dealt to shards by ranges of their
hashes, so many that each has about ``SHARD_PAIRS`` pairs. A shard holds its words' hashes
and counts, and the successors of these words: pointers to each context's successors
(monotone), the
successors' places in the shard's own list relative to the context's first value
(monotone), the discounted pair probability and the context's back-off weight as 16-bit
codes. A query takes its context's range by two pointers and searches the successor there.

    P(w | h) = max(c(hw) - D, 0) / c(h) + (1 - sum of these over h) * P1(w)
    P1(w)    = (c(w) + 0.1) / (N + 0.1 (V + 1))

Codes round down, so each context's probabilities sum to 1 at most. There is no table of
all words: each shard is a file of the shared folder, which tasks map into memory
(``np.memmap``) and score in one pass. Where the shared folder is no mounted one, a join gives
each shard its successors' own counts; shards reach
the driver in groups of at most ``MODEL_BYTES`` and are broadcast one group after the other,
each scoring the words and the pairs of its own range; the sums of a text's parts are added
up. So neither the driver nor a task holds the whole model.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.llm.elias_fano import EliasFano
from jobsift.llm.shingles import word_hashes
from jobsift.llm.store import keep, shared_folder, ship

LEAST_PAIR = 1              # all pairs; more would cut the rare ones
DISCOUNT = 0.75
MODEL_BYTES = 64 << 20
SHARD_PAIRS = 500_000       # pairs of a trie shard, about; a context is never split
PAIR_BYTES = 8              # bytes of text for a distinct pair, about
BUCKETS = 16                # bits of a word's hash that deal it to a shard
BUFFER = 1 << 21             # tokens that a counting task holds
GROUP = 1 << 22              # partial counts that a building task holds, or twice its shard's pairs
SLICE = 4 << 20              # bytes of the texts that are scored together (one text at least)
SMALL = 0.1
_END = np.array([0x9E3779B97F4A7C15], dtype=np.uint64)     # the end token
_BEGIN = np.array([0xC2B2AE3D27D4EB4F], dtype=np.uint64)   # the start mark, a context only
_LEAST_LOG = -12.0
_STEP = -_LEAST_LOG / 65535


def tokens(text: bytes | None) -> np.ndarray:
    """Hashes of the words of a text, then the end token's."""
    return np.concatenate((word_hashes(text or b""), _END))


def code(p: np.ndarray) -> np.ndarray:
    """Probabilities as 16-bit codes of their logarithm, rounded down; 0 means zero."""
    logs = np.log10(np.maximum(p, 1e-300))
    return np.where(p <= 0, 0, np.clip(np.floor((logs - _LEAST_LOG) / _STEP), 0, 65535)).astype("<u2")


_DECODED = np.concatenate(([0.0], 10.0 ** (_LEAST_LOG + _STEP * np.arange(1, 65536))))


class Level:
    """Successors of the contexts ``[first, last)``."""

    _HEAD = struct.Struct("<QQQQ")

    def __init__(self, buffer):
        self.first, self.last, size, _ = self._HEAD.unpack_from(buffer)
        self.pointers = EliasFano(buffer, self._HEAD.size)
        self.successors = EliasFano(buffer, self.pointers.end)
        self.pairs = np.frombuffer(buffer, "<u2", size, self.successors.end)
        self.backoff = np.frombuffer(buffer, "<u2", self.last - self.first, self.successors.end + 2 * size)

    @classmethod
    def build(cls, first: int, last: int, context: np.ndarray, word: np.ndarray, p: np.ndarray) -> bytes:
        """From pairs sorted by context and word, with their discounted probabilities."""
        contexts = last - first
        counts = np.bincount(context - first, minlength=contexts)
        pointers = np.concatenate(([0], np.cumsum(counts)))
        used = np.flatnonzero(counts)
        width = np.zeros(contexts, dtype=np.int64)
        width[used] = word[pointers[used + 1] - 1] + 1
        base = np.concatenate(([0], np.cumsum(width)))[:-1]
        held = code(p)
        mass = np.bincount(context - first, weights=p, minlength=contexts)
        return (cls._HEAD.pack(first, last, len(word), 0) + EliasFano.build(pointers) + EliasFano.build(base[context - first] + word)
                + held.tobytes() + code(np.maximum(0.0, 1 - mass)).tobytes())

    def query(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Discounted pair probability (0 where absent) and back-off weight."""
        edges = np.flatnonzero(np.diff(context, prepend=-1))        # equal contexts side by side are looked up once
        at, runs = context[edges] - self.first, np.diff(np.append(edges, len(context)))
        low, high = self.pointers.get(at).astype(np.int64), self.pointers.get(at + 1).astype(np.int64)
        base = np.zeros(len(at), dtype=np.uint64)
        later = np.flatnonzero((low > 0) & (high > low))
        base[later] = self.successors.get(low[later] - 1) + np.uint64(1)
        p = np.zeros(len(context))
        some = np.flatnonzero(np.repeat(high > low, runs))
        if len(some):
            place = self.successors.index(np.repeat(base, runs)[some] + word[some].astype(np.uint64))
            same = (place >= 0) & (place < np.repeat(high, runs)[some])
            p[some[same]] = _DECODED[self.pairs[place[same]]]
        return p, np.repeat(_DECODED[self.backoff[at]], runs)


class Shard:
    """The words of one range of hashes, with their counts and their successors."""

    _HEAD = struct.Struct("<QQQQQ")

    def __init__(self, buffer):
        self.first, self.last, n, m, counted = self._HEAD.unpack_from(buffer)
        at = self._HEAD.size
        self.words, self.counts = np.frombuffer(buffer, "<u8", n, at), np.frombuffer(buffer, "<i8", n, at + 8 * n)
        at += 16 * n
        self.next, self.next_counts = np.frombuffer(buffer, "<u8", m, at), np.frombuffer(buffer, "<i8", counted, at + 8 * m)
        self.level = Level(memoryview(buffer)[at + 8 * (m + counted) :])

    @classmethod
    def build(cls, first: int, last: int, words: np.ndarray, counts: np.ndarray, following: np.ndarray,
              above: np.ndarray, place: np.ndarray, n: np.ndarray, discount: float) -> bytes:
        """From sorted words with their counts, sorted successors, and pairs as places in both, in order."""
        return (cls._HEAD.pack(first, last, len(words), len(following), 0) + words.astype("<u8").tobytes() + counts.astype("<i8").tobytes()
                + following.astype("<u8").tobytes() + Level.build(0, len(words), above, place, (n - discount) / counts[above]))

    @classmethod
    def counted(cls, buffer, hashes: np.ndarray, counts: np.ndarray) -> bytes:
        """The shard with its successors' own counts, given in any order."""
        first, last, n, m, _ = cls._HEAD.unpack_from(buffer)
        at = cls._HEAD.size + 16 * n + 8 * m
        return (cls._HEAD.pack(first, last, n, m, m) + bytes(buffer[cls._HEAD.size : at])
                + counts[np.argsort(hashes)].astype("<i8").tobytes() + bytes(buffer[at:]))

    @staticmethod
    def _places(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.full(len(hashes), -1, dtype=np.int64)
        at = np.searchsorted(table, hashes)
        at[at == len(table)] = 0
        return np.where(table[at] == hashes, at, -1)

    def count(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and places of words of this range, 0 and -1 for words never counted."""
        at = self._places(self.words, hashes)
        return np.where(at >= 0, self.counts[at], 0) if len(self.words) else np.zeros(len(at), dtype=np.int64), at

    def gain(self, above: np.ndarray, word: np.ndarray, counts: np.ndarray, scale: float) -> np.ndarray:
        """log10 P(word | context) - log10 P1(word), 0 under contexts never counted.

        Contexts are places, words hashes with their counts, which are not read where the
        shard has its successors' own.
        """
        out = np.zeros(len(above))
        some = np.flatnonzero(above >= 0)
        if not len(some):
            return out
        place = self._places(self.next, word[some])
        if len(self.next_counts):
            counts = np.where(place >= 0, self.next_counts[place], 0)
        else:
            counts = counts[some]
        # a word that follows none of the shard's is asked at the place behind them all
        p, left = self.level.query(above[some], np.where(place >= 0, place, len(self.next)))
        p[place < 0] = 0
        out[some] = np.log10(np.maximum(p * scale / (counts + SMALL) + left, 1e-300))
        return out


def _stream(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of texts one after the other, a start mark before each, and the numbers of tokens."""
    each = [tokens(x) for x in texts]
    return np.concatenate([y for x in each for y in (_BEGIN, x)]), np.array([len(x) for x in each])


_COUNTED = pa.schema([("shard", pa.int32()), ("contexts", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary()), ("n", pa.binary())])


def _counted(stream: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    """Counts of a stream's pairs, the last token's with the first one too, a row a shard.

    A row has its contexts, the number of each one's successors, and these with their counts.
    """
    single, place = np.unique(stream, return_inverse=True)
    pairs, n = np.unique(place * len(single) + np.roll(place, -1), return_counts=True)
    above = pairs // len(single)
    sizes = np.bincount(above, minlength=len(single))      # each word is a context
    ends = np.cumsum(sizes)
    shard = np.searchsorted(starts, (single >> np.uint64(64 - BUCKETS)).astype(np.int64), side="right") - 1
    first = np.flatnonzero(np.diff(shard, prepend=-1))
    of_words = np.append(first, len(single))
    of_pairs = np.append((ends - sizes)[first], len(pairs))
    columns = [(single.astype("<u8"), of_words), (sizes.astype("<u4"), of_words), (single[pairs - above * len(single)].astype("<u8"), of_pairs), (n.astype("<u4"), of_pairs)]
    packed = [pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((x.itemsize * edges).astype("<i4")), pa.py_buffer(x)]) for x, edges in columns]
    return pa.RecordBatch.from_arrays([pa.array(shard[first].astype(np.int32)), *packed], schema=_COUNTED)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes | None]:
    """The texts one by one, as few as possible of them as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from batch.column(0).slice(at, 256).to_pylist()


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``SLICE`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
    edges = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE, prepend=-1))
    for start, end in zip(edges, [*edges[1:], batch.num_rows]):
        yield batch.slice(start, end - start)


def _count(starts: np.ndarray):
    """Texts -> counts of their word pairs by shards, added up over ``BUFFER`` tokens at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for text in _texts(batches):
            parts += [_BEGIN, tokens(text)]
            held += len(parts[-1])
            if held >= BUFFER:
                yield _counted(np.concatenate(parts), starts)
                parts, held = [], 0
        if parts:
            yield _counted(np.concatenate(parts), starts)
        pa.default_memory_pool().release_unused()

    return run


def shard_starts(counts: np.ndarray, size: int) -> np.ndarray:
    """First contexts (or buckets of them) of shards that hold about ``size`` pairs each, and the end."""
    before = np.cumsum(counts) - counts
    return np.append(np.flatnonzero(np.diff(before // size, prepend=-1)), len(counts))


_LEVELS = "shard int, first int, last int, size long, words long, tokens long, level binary"


def _added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Rows' contexts and successors, sorted, and the pairs as places in both, in order, with the sums of their counts."""
    contexts, sizes, words, n = (np.concatenate(x) for x in zip(*parts))
    own, above = np.unique(contexts, return_inverse=True)
    following, place = np.unique(words, return_inverse=True)
    key = np.repeat(above, sizes) * len(following) + place
    order = np.argsort(key)
    key = key[order]
    edges = np.flatnonzero(np.diff(key, prepend=-1))
    n, key = np.add.reduceat(n[order].astype(np.int64), edges), key[edges]
    above = key // len(following)
    return own, following, above, key - above * len(following), n


def _build(starts: np.ndarray, discount: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, limit = [], 0, GROUP
        for batch in batches:
            shard = batch.column("shard")[0].as_py()
            for row in zip(*(batch.column(name) for name in ("contexts", "sizes", "words", "n"))):
                parts.append(tuple(np.frombuffer(x.as_buffer(), kind) for x, kind in zip(row, ("<u8", "<u4", "<u8", "<u4"))))
                held += len(parts[-1][3])
                if held >= limit:
                    own, following, above, place, n = _added(parts)
                    parts = [(own, np.bincount(above, minlength=len(own)), following[place], n)]
                    held = len(n)
                    limit = max(GROUP, 2 * held)
        own, following, above, place, n = _added(parts)
        counts = np.bincount(above, weights=n, minlength=len(own)).astype(np.int64)
        kept = np.flatnonzero(n >= LEAST_PAIR)
        built = Shard.build(int(starts[shard]), int(starts[shard + 1]), own, counts, following, above[kept], place[kept], n[kept], discount)
        real = own != _BEGIN[0]
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "first": pa.array([starts[shard]], pa.int32()), "last": pa.array([starts[shard + 1]], pa.int32()),
                                          "size": [len(built)], "words": [int(real.sum())], "tokens": [int(counts[real].sum())], "level": pa.array([built], pa.binary())})

    return run


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for level in batch.column("level"):
            held = Shard(level.as_buffer())
            yield pa.RecordBatch.from_pydict({"word": held.words.view(np.int64), "count": held.counts})


def _next_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, level in zip(batch.column("shard").to_pylist(), batch.column("level")):
            held = Shard(level.as_buffer()).next.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), shard, dtype=np.int32)), pa.array(held)], names=["shard", "word"])


def _filled(levels: pa.Table, counts: pa.Table) -> pa.Table:
    """A shard's row with its successors' counts in place."""
    word, n = (counts.column(c).to_numpy() for c in ("word", "count"))
    built = Shard.counted(levels.column("level")[0].as_buffer(), word.view(np.uint64), n)
    return levels.set_column(levels.schema.get_field_index("size"), "size", [[len(built)]]).set_column(levels.schema.get_field_index("level"), "level", [[built]])


class Shards:
    """Shards as bytes or as paths of files, which are mapped when first asked."""

    def __init__(self, held: list[tuple[int, int, bytes | str]]):
        self.held = sorted(held, key=lambda x: x[0])
        self.first, self.last = (np.array([x[i] for x in self.held], dtype=np.int64) for i in (0, 1))
        self.open: dict[int, Shard] = {}

    def shard(self, i: int) -> Shard:
        if i not in self.open:
            of = self.held[i][2]
            self.open[i] = Shard(np.memmap(of, dtype=np.uint8, mode="r") if isinstance(of, str) else of)
        return self.open[i]

    def parts(self, hashes: np.ndarray) -> Iterator[tuple[Shard, np.ndarray]]:
        """Each shard with the positions of the hashes of its range."""
        if not self.held:
            return
        bucket = (hashes >> np.uint64(64 - BUCKETS)).astype(np.int64)
        of = np.searchsorted(self.first, bucket, side="right") - 1
        of[bucket >= self.last[of]] = -1
        order = np.argsort(of.astype(np.int32), kind="stable")
        edges = np.flatnonzero(np.diff(of[order], prepend=-2))
        for start, mine in zip(edges, np.split(order, edges[1:])):
            if of[order[start]] >= 0:
                yield self.shard(int(of[order[start]])), mine


def _score(shards, scale: float, lead: bool):
    """One group's part of every text's sums; the leading part also has the rows' ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Shards(shards.value)
        for batch in batches:
            for piece in _slices(batch, 1):
                stream, sizes = _stream(piece.column(1).to_pylist())
                # each word and each pair is looked up once, in the order of the shards
                single, place = np.unique(stream, return_inverse=True)
                known, at = np.zeros(len(single), dtype=np.int64), np.full(len(single), -1)
                for shard, mine in held.parts(single):
                    known[mine], at[mine] = shard.count(single[mine])
                row = np.repeat(np.arange(len(sizes)), sizes)
                token = np.arange(len(row)) + row + 1       # where the tokens stand, without the start marks
                place, before = place[token], place[token - 1]
                pairs, of = np.unique(before * len(single) + place, return_inverse=True)
                above = pairs // len(single)
                word, gains = pairs - above * len(single), np.zeros(len(pairs))
                for shard, mine in held.parts(single[above]):
                    gains[mine] = shard.gain(at[above[mine]], single[word[mine]], known[word[mine]], scale)
                sums = lambda x: np.bincount(row, weights=x, minlength=len(sizes))
                out = {"key": piece.column(2), "n_tokens": sizes, "n_known": sums((known > 0)[place]).astype(np.int64),
                       "base": sums(np.log10((known + SMALL) / SMALL)[place]), "gain": sums(gains[of])}
                if lead:
                    out["doc_id"] = piece.column(0)
                yield pa.RecordBatch.from_pydict(out)

    return run


class Model:
    """Totals of the training texts and the trie's shards, a table in the shared folder."""

    def __init__(self, total: int, distinct: int, levels: DataFrame):
        self.total, self.distinct, self.levels = total, distinct, levels

    def groups(self, limit: int = MODEL_BYTES) -> Iterator[list[tuple[int, int, bytes]]]:
        """Trie shards, with their successors' counts, in groups of at most ``limit`` bytes (one shard at least)."""
        words = self.levels.select("level").mapInArrow(_words_of, "word long, count long")
        counts = self.levels.select("shard", "level").mapInArrow(_next_of, "shard int, word long").join(words, "word")
        filled = keep(self.levels.groupBy("shard").cogroup(counts.groupBy("shard")).applyInArrow(_filled, _LEVELS), "counted")
        sizes = filled.df.select("shard", "size").orderBy("shard").collect()
        group, held = [], 0
        for shard, size in sizes:
            if group and held + size > limit:
                yield self._load(filled.df, group)
                group, held = [], 0
            group.append(shard)
            held += size
        if group or not sizes:
            yield self._load(filled.df, group)
        filled.drop()

    @staticmethod
    def _load(levels: DataFrame, shards: list[int]) -> list[tuple[int, int, bytes]]:
        return [(r["first"], r["last"], bytes(r["level"])) for r in levels.where(F.col("shard").isin(shards)).collect()]

    def files(self) -> list[tuple[int, int, str]] | None:
        """The shards as files of the shared folder; None where tasks can't map its files."""
        folder = mapped_path(self.levels.sparkSession, shared_folder(self.levels.sparkSession))
        if folder is None:
            return None
        folder = f"{folder}/trie-{uuid.uuid4().hex[:12]}"
        return [tuple(r) for r in self.levels.select("first", "last", "level").mapInArrow(_written(folder), "first int, last int, path string").collect()]


def mapped_path(spark: SparkSession, folder: str) -> str | None:
    """The path by which tasks open a folder's files; None where Hadoop keeps it in no file system of the machines."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return at.toUri().getPath() if system.getUri().getScheme() == "file" else None


def _written(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            paths = []
            for first, level in zip(batch.column(0).to_pylist(), batch.column(2)):
                paths.append(f"{folder}/{first}")
                own = f"{paths[-1]}-{uuid.uuid4().hex}"     # a repeated task replaces the file by an equal one
                with open(own, "wb") as out:
                    out.write(level.as_buffer())
                os.replace(own, paths[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(paths, pa.string())], names=["first", "last", "path"])

    return run


def train(texts: DataFrame, discount: float = DISCOUNT) -> Model:
    """Count ``texts(text)`` and build the trie. An empty table gives an empty model."""
    ship(texts.sparkSession)
    bytes_ = texts.select(F.col("text").cast("string").cast("binary").alias("text"))
    size = bytes_.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    starts = shard_starts(np.full(1 << BUCKETS, size / PAIR_BYTES / (1 << BUCKETS)), SHARD_PAIRS)
    counted = bytes_.mapInArrow(_count(starts), "shard int, contexts binary, sizes binary, words binary, n binary")
    levels = keep(counted.groupBy("shard").applyInArrow(_build(starts, discount), _LEVELS), "levels")
    totals = levels.df.agg(F.sum("tokens").alias("total"), F.sum("words").alias("distinct")).first()
    return Model(totals["total"] or 0, totals["distinct"] or 0, levels.df)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Score every whole text of ``docs(doc_id, text, ...)``.

    Returns ``doc_id, n_tokens, n_known, train_tokens, base_score, score``, one row an
    input row. Null and empty texts are the end token alone. Repeated rows and null ids
    are scored like any other; other columns are not read. Words never counted have the
    probability left for them. Scores are log10 of the text's probability.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), F.xxhash64("text").alias("key"))
    scale = model.total + SMALL * (model.distinct + 1)
    lead, more = None, []
    files = model.files()
    for group in [files] if files is not None else model.groups():
        shared = spark.sparkContext.broadcast(group)
        part = _part(texts, shared, scale, lead is None)
        if lead is None:
            lead = keep(part, "scored").df
        else:
            more.append(keep(part.groupBy("key", "n_tokens").agg(*[F.max(c).alias(c) for c in _SUMS]), "sums").df)
        shared.destroy()
    out = lead
    if more:
        # equal texts have equal sums, so the further groups' are joined by the text's print
        further = (reduce(lambda a, b: a.unionByName(b), more).groupBy(F.col("key").alias("at"), F.col("n_tokens").alias("long"))
                   .agg(*[F.sum(c).alias(f"more_{c}") for c in _SUMS]))
        out = (out.join(further, F.col("key").eqNullSafe(F.col("at")) & (F.col("n_tokens") == F.col("long")), "left")
               .withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in _SUMS}))
    base = F.col("base") + F.col("n_tokens") * F.lit(float(np.log10(SMALL / scale)))
    return out.select("doc_id", "n_tokens", F.col("n_known").cast("long").alias("n_known"),
                      F.lit(model.total).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("gain")).alias("score"))


_SUMS = ("n_known", "base", "gain")


def _part(texts: DataFrame, shards, scale: float, lead: bool) -> DataFrame:
    schema = "key long, n_tokens long, n_known long, base double, gain double" + ", doc_id long" * lead
    return texts.mapInArrow(_score(shards, scale, lead), schema)


def training_row(doc_id: Column, folds: int = 10, held_out: int = 0) -> Column:
    """True for rows whose crc32 of the id as text does not leave ``held_out``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds != held_out
