"""Operator 2: exact token counts from a compiled finite-state transducer.

BPE keeps prefixes: the encoding of a word's prefix is followed by one more token to give
the encoding of a longer one, or it is replaced from some earlier prefix on. Which token
ends each prefix depends on a bounded window, so the count is a finite-state function.
A state holds, for every start from which the symbols read so far may still grow into a
token, that prefix's last token and its count relative to here. A transition reads one
symbol and is annotated with the change of the token count. States are determinised when
first reached and kept in bounded tables, as lazy automata do.

A text is read in chunks. A chunk's state map says what it does to any incoming state:
the symbols before its first white space (where every state meets the start state), the
tokens between, and the open end after its last white space. Maps compose associatively,
and a prefix scan by halves composes those of a long text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsift.llm.store import ship
from jobsift.llm.word_bpe import Remembered, WordBpe, load, simpler

CHUNK = 1 << 16
MAX_STATES = 200_000
MAX_UNITS = 500_000
LIMIT = 2048
_WHITE = b" \t\n\x0b\x0c\r"


class Transducer:
    """Symbols of a word -> number of tokens, compiled on demand."""

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        self.grows = {token[:i] for token in bpe.ids for i in range(1, len(token))}
        self.whole: dict[str, bool] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        """Forget all states but the first."""
        start = (("", None, 0),)
        self.start: dict = {None: start}
        self.number = {start: self.start}

    def _ends(self, before: str | None, token: str) -> bool:
        """Whether ``token`` is the token after ``before`` in an encoding."""
        if token not in self.bpe.ids:
            return False
        whole = self.whole.get(token)
        if whole is None:
            whole = self.whole[token] = self.bpe.merge(token) == [token]
        if before is None or not whole:
            return whole
        fits = self.fits.get((before, token))
        if fits is None:
            fits = self.fits[before, token] = self.bpe.merge(before + token) == [before, token]
        return fits

    def _compile(self, state: dict, symbol: str) -> tuple[dict, int]:
        if len(self.fits) > 8 * MAX_STATES:
            self.fits.clear()
        last, change = None, 0
        for text, before, count in state[None]:
            if self._ends(before, text + symbol):
                last, change = text + symbol, count + 1
        if last is None:
            raise ValueError(f"no token of the vocabulary ends with {symbol!r} here")
        following = tuple((text + symbol, before, count - change) for text, before, count in state[None]
                          if text + symbol in self.grows) + (("", last, 0),)
        to = self.number.get(following)
        if to is None:
            to = self.number[following] = {None: following}
        move = state[symbol] = (to, change)
        return move

    def count(self, word: str) -> int:
        """Run the word: a state is the table of its moves, each with its change of the count."""
        if len(self.number) > MAX_STATES:
            self.reset()
        state, total = self.start, 0
        for symbol in word:
            move = state.get(symbol) or self._compile(state, symbol)
            state = move[0]
            total += move[1]
        return total


class UnitCounts(Remembered):
    """Tokens of a white-space free unit."""

    def __init__(self, path: str):
        super().__init__(MAX_UNITS)
        self.bpe = load(path)
        self.transducer = Transducer(self.bpe)

    def compute(self, unit: bytes) -> int:
        units = simpler(unit)
        if units != (unit,):
            return sum(map(self.__getitem__, units))
        text = unit.decode("utf-8", "replace")
        word = self.bpe.latin(text)
        if word is not None:
            return self.transducer.count(word)
        return sum(1 if added else sum(map(self.transducer.count, self.bpe.words(part))) for part, added in self.bpe.parts(text))


class StateMap(NamedTuple):
    """What a chunk does to an incoming state; ``tail`` is None without white space."""

    head: bytes
    count: int
    tail: bytes | None


def chunk_map(chunk: bytes, counts: UnitCounts) -> StateMap:
    units = chunk.split()
    if len(units) == 1 and len(units[0]) == len(chunk):
        return StateMap(chunk, 0, None)
    head = units.pop(0) if units and chunk[0] not in _WHITE else b""
    tail = units.pop() if units and chunk[-1] not in _WHITE else b""
    return StateMap(head, sum(map(counts.__getitem__, units)), tail)


def compose(a: StateMap, b: StateMap, counts: UnitCounts) -> StateMap:
    if a.tail is None:
        return StateMap(a.head + b.head, b.count, b.tail)
    if b.tail is None:
        return StateMap(a.head, a.count, a.tail + b.head)
    joined = a.tail + b.head
    return StateMap(a.head, a.count + b.count + (counts[joined] if joined else 0), b.tail)


def scan(maps: list[StateMap], counts: UnitCounts) -> list[StateMap]:
    """Inclusive prefix composition: pairs first, then the scan of the pairs."""
    if len(maps) == 1:
        return maps
    pairs = scan([compose(a, b, counts) for a, b in zip(maps[::2], maps[1::2])], counts)
    out = [maps[0]]
    for i in range(1, len(maps)):
        out.append(pairs[i // 2] if i % 2 else compose(pairs[i // 2 - 1], maps[i], counts))
    return out


def count_tokens(text: bytes | None, counts: UnitCounts) -> int:
    """Tokens of one whole text."""
    if not text:
        return 0
    maps = [chunk_map(text[at : at + CHUNK], counts) for at in range(0, len(text), CHUNK)]
    done = scan(maps, counts)[-1]
    return done.count + sum(counts[x] for x in (done.head, done.tail) if x)


_kept: dict[str, UnitCounts] = {}


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _kept:
            _kept[path] = UnitCounts(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x or b"") for x in texts], pa.int64()),
                 pa.array([count_tokens(x, _kept[path]) for x in texts], pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """Tokens of every whole text of ``docs(doc_id, text, ...)`` under a word-end BPE file.

    Returns ``doc_id, n_bytes, n_tokens, over_limit`` (``n_tokens > limit``), one row an
    input row, repeated rows and null ids included. Null and empty texts count 0. Other
    columns are not read. ``vocabulary`` is the file's path on every machine. No shuffle.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    out = texts.mapInArrow(_counter(vocabulary), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
