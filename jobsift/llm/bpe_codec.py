"""Operator 4: BPE encoding and decoding with forced-boundary splitting.

Two symbols that stand next to each other inside no vocabulary token can't be joined by
any merge, so a cut between them is certain. The table of pairs that do occur is built
from the vocabulary; words are cut at every other pair, the fragments are encoded on
their own, and the ids are put together again. Fragments repeat far more than words do,
so most are answered by a bounded cache.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsift.llm.store import ship
from jobsift.llm.word_bpe import FINAL, Remembered, load, simpler

MAX_FRAGMENTS = 200_000
MAX_UNITS = 350_000


class Codec(Remembered):
    """Unit (no ASCII white space) -> its ids as little-endian 32-bit integers."""

    def __init__(self, path: str):
        super().__init__(MAX_UNITS)
        self.bpe = load(path)
        self.pairs = {token[i : i + 2] for token in self.bpe.ids for i in range(len(token) - 1)}
        self.model = self.bpe.library.model
        self.fragments: dict[str, list[int]] = {}

    def cut(self, word: str) -> list[str]:
        """The word's fragments between certain boundaries."""
        at = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.pairs]
        return [word[a:b] for a, b in zip([0, *at], [*at, len(word)])]

    def encode_fragment(self, fragment: str) -> list[int]:
        """By the library's model where the fragment ends a word, as it takes every input to do."""
        last = ord(fragment[-1]) - FINAL
        if last >= 0:
            return [x.id for x in self.model.tokenize(fragment[:-1] + chr(last))]
        return [self.bpe.ids[x] for x in self.bpe.merge(fragment)]

    def encode_word(self, word: str) -> list[int]:
        out: list[int] = []
        for fragment in self.cut(word):
            ids = self.fragments.get(fragment)
            if ids is None:
                ids = self.encode_fragment(fragment)
                if len(self.fragments) >= MAX_FRAGMENTS:
                    self.fragments.clear()
                self.fragments[fragment] = ids
            out += ids
        return out

    def compute(self, unit: bytes) -> bytes:
        units = simpler(unit)
        if units != (unit,):
            return b"".join(map(self.__getitem__, units))
        text, out = unit.decode("utf-8", "replace"), []
        single = self.bpe.latin(text)
        if single is not None:
            out = self.encode_word(single)
        for part, added in self.bpe.parts(text) if single is None else ():
            if added:
                out.append(self.bpe.added[part])
            else:
                for word in self.bpe.words(part):
                    out += self.encode_word(word)
        return np.array(out, dtype="<i4").tobytes()

    def encode(self, text: bytes | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or b"").split()))

    def decode(self, ids: np.ndarray) -> str:
        """The vocabulary file names no decoder: its tokens, joined by one space."""
        return " ".join(map(self.bpe.names.__getitem__, ids.tolist()))


_kept: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _kept:
        _kept[path] = Codec(path)
    return _kept[path]


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                encoded = [np.frombuffer(coder.encode(x), "<i4") for x in part.column(1).to_pylist()]
                ends = np.cumsum([0] + [len(x) for x in encoded])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(encoded), pa.int32())),
                     pa.array([coder.decode(x) for x in encoded], pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def bpe_encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encode every whole text of ``docs(doc_id, text, ...)`` and decode the ids again.

    Returns ``doc_id, ids array<int>, decoded string``, one row an input row, repeated
    rows and null ids included. Null and empty texts give no ids and an empty decoded
    text. Other columns are not read. No shuffle; a text is held by one task.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(_encoder(vocabulary), "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of ``bpe_encode`` rows, and ``more``."""
    return encoded.select(
        "doc_id", *more, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
