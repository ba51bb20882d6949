"""Operator 5: token-id files, entropy coded block by block.

``write_tokens`` range-partitions the documents by ``doc_id``; each task tokenises its
sorted share into blocks of whole documents and counts ids. The counts of all tasks are
summed into one static frequency table (bounded by the vocabulary); then every block is
coded on its own. ``read_tokens`` decodes blocks in parallel, checks every checksum and
gives the documents back. Only one row a task (its first id and token total) and the
frequency table reach the driver.

A file set is a folder with two Parquet tables: ``table`` (symbol, frequency) and
``blocks`` (shard, block, start, doc_ids, lengths, payload), where ``payload`` is one
rANS block and ``start`` the ids before it in the whole set.
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from jobsift.llm import rans
from jobsift.llm.store import keep, shared_folder, ship
from jobsift.llm.word_bpe import Remembered, byte_alphabet, spelled

BLOCK = 1 << 19
END = 0
MAX_UNITS = 600_000
# A run of these after a letter or digit, at a unit's end, is a token piece of its own ("<",
# "|" and ">" are left: added tokens are written with them).
_TAIL = "!\"#$%&'()*+,-./:;=?@[\\]^_`{}~"
_MORE_SPACE = re.compile(r" (?:\s|\Z)")
# White space other than a space and a newline, as Python counts it.
_RARE_SPACE = [x for x in map(chr, range(0x3001)) if x.isspace() and x not in " \n"]
_RAW = "shard int, block long, start long, doc_ids array<long>, lengths array<long>, ids binary, symbol int, n long"
_BLOCKS = "shard int, block long, start long, doc_ids array<long>, lengths array<long>, payload binary"

_RAW_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                        ("lengths", pa.list_(pa.int64())), ("ids", pa.binary()), ("symbol", pa.int32()), ("n", pa.int64())])


def ranked_pieces(library: Tokenizer) -> tiktoken.Encoding | None:
    """The vocabulary as ranks for the other library, which takes a third of the time a piece.

    Both apply the merge of least rank again and again. Ranks are the ids, so this holds
    where merges are numbered as their tokens are; None where they are not, or where the
    model has other rules. A piece that is a token itself is no business of the ranks.
    """
    model = json.loads(library.to_str())["model"]
    plain = not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    if model["type"] != "BPE" or not plain:
        return None
    byte = {symbol: b for b, symbol in byte_alphabet().items()}
    ranks = {bytes(map(byte.__getitem__, token)): i for token, i in model["vocab"].items() if all(map(byte.__contains__, token))}
    merged = [bytes(map(byte.__getitem__, "".join(pair if isinstance(pair, list) else pair.split(" ")))) for pair in model["merges"]]
    numbers = [ranks.get(token, -1) for token in merged]
    singles = [ranks.get(bytes([b]), -1) for b in range(256)]
    if min(singles) < 0 or any(a >= b for a, b in zip([max(singles), *numbers], numbers)):
        return None
    known = set(merged)
    return tiktoken.Encoding("pieces", pat_str="(?s).+", mergeable_ranks={t: i for t, i in ranks.items() if len(t) == 1 or t in known}, special_tokens={})


# The byte-level pattern but for its look ahead, by which white space before a last one of it
# that text follows is a piece of its own; texts are cut there first.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUNS = re.compile(f"([{_WHITE}]+(?=[{_WHITE}][^{_WHITE}])|[{_WHITE}]{{2,}}\\Z)")


def old_characters() -> frozenset[str]:
    """Characters that libraries of all Unicode versions take for the same kind: assigned long ago, and of that kind then."""
    old, kind = unicodedata.ucd_3_2_0, lambda x: x[0] if x[0] in "LNZ" else "-"
    return frozenset(x for x in map(chr, range(0x20000)) if old.category(x) != "Cn" and kind(old.category(x)) == kind(unicodedata.category(x)))


class Whole:
    """Whole texts -> ids by the other library's pattern and merges, which remembers nothing.

    It gives what the tokenizers library does where the vocabulary is as ``ranked_pieces``
    wants it and each of its tokens is its own merge, the pattern is the byte-level one, and
    a text has no added token and only ``old_characters``. ``of`` gives None where that can't
    be said of the vocabulary.
    """

    def __init__(self, ranks: dict[bytes, int], added: list[str]):
        self.library = tiktoken.Encoding("whole", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})
        self.added, self.known = added, old_characters()

    @classmethod
    def of(cls, library: Tokenizer, pieces: tiktoken.Encoding | None) -> "Whole | None":
        spec = json.loads(library.to_str())
        cut = spec["pre_tokenizer"] or {}
        if pieces is None or spec["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            return None
        byte, ranks = byte_alphabet(), pieces._mergeable_ranks
        if any(len(library.model.tokenize("".join(map(byte.__getitem__, token)))) != 1 for token in ranks):
            return None
        return cls(ranks, [x["content"] for x in spec["added_tokens"]])

    def sure(self, text: str) -> bool:
        return not any(x in text for x in self.added) and (text.isascii() or self.known.issuperset(set(text)))

    def ids(self, text: str) -> bytes:
        parts = _RUNS.split(text) if side_by_side(text) else [text]
        return b"".join(array("I", self.library.encode_ordinary(x)).tobytes() for x in parts)


class Units(Remembered):
    """Text between spaces -> its ids, as the library gives them after ``prefix``.

    The byte-level pattern always cuts before a space that a non-space follows, so the
    text from such a space to the next one is tokenised alike wherever it stands. It also
    cuts around a single newline between other characters.
    """

    def __init__(self, path: str, prefix: str = " ", library: Tokenizer | None = None):
        super().__init__(MAX_UNITS)
        if library is None:
            library = Tokenizer.from_file(path)
            library.no_padding()
            library.no_truncation()
        self.library, self.model, self.prefix = library, library.model, prefix
        self.vocabulary = library.get_vocab(with_added_tokens=False) if prefix else {}
        self.pieces = ranked_pieces(library) if prefix else None
        self.lead = spelled(prefix) if prefix else ""
        self.tails: dict[str, bytes] = {}
        self.newline = self.ids("\n")
        self.bare = Units(path, "", library) if prefix else self
        self.whole = Whole.of(library, self.pieces) if prefix else None

    def ids(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, unit: str, symbols: str) -> bytes:
        """A unit that is one piece for the model, and the piece's symbols."""
        if self.pieces is not None and symbols not in self.vocabulary:
            return array("I", self.pieces.encode_ordinary(self.prefix + unit)).tobytes()
        return array("I", [x.id for x in self.model.tokenize(symbols)]).tobytes()

    def compute(self, unit: str) -> bytes:
        # A space and letters are one piece, which goes straight to the library's model. (Below
        # U+0250 it is beyond doubt what a letter is.)
        if unit.isascii():
            if unit.isalpha():
                return self.piece(unit, self.lead + unit)
        elif unit.isalpha() and max(unit) < "\u0250":
            return self.piece(unit, self.lead + spelled(unit))
        core = unit.rstrip(_TAIL)
        if core and len(core) < len(unit) and core[-1].isascii() and core[-1].isalnum():
            tail = unit[len(core) :]
            return self[core] + (self.tails.get(tail) or self.tails.setdefault(tail, self.ids(tail)))
        if "\n" in unit:
            lines = unit.split("\n")
            if all(lines) and not any(x[0].isspace() or x[-1].isspace() for x in lines):
                return self[lines[0]] + b"".join(self.newline + self.bare[x] for x in lines[1:])
        return self.ids(self.prefix + unit)

    def encode(self, text: str | None, end: bytes = b"") -> bytes:
        """The text's ids and then ``end``."""
        if not text:
            return end
        if self.whole is not None and self.whole.sure(text):
            return self.whole.ids(text) + end
        return self.by_units(text) + end

    def by_units(self, text: str) -> bytes:
        """The ids of a text that is cut at spaces."""
        units = text.split(" ")
        if more_space(text):
            merged = [units[0]]
            for unit in units[1:]:
                if unit == "" or unit[0].isspace():
                    merged[-1] += " " + unit
                else:
                    merged.append(unit)
            units = merged
        first = self.bare[units[0]] if units[0] else b""
        units[0] = ""
        return b"".join((first, *map(self.__getitem__, filter(None, units))))


def more_space(text: str) -> bool:
    """Whether a space is followed by white space or ends the text.

    The same as a search for ``_MORE_SPACE``, which tries every space of a text; one character
    is sought far faster.
    """
    if any(x in text for x in _RARE_SPACE):
        return _MORE_SPACE.search(text) is not None
    return "  " in text or " \n" in text or text.endswith(" ")


def side_by_side(text: str) -> bool:
    """Whether white space follows white space; rare one counts as if it did."""
    return "  " in text or " \n" in text or "\n " in text or "\n\n" in text or any(x in text for x in _RARE_SPACE)


_units: dict[str, Units] = {}
_tables: dict[str, rans.Table] = {}


def _tokenise(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _units:
            _units[path] = Units(path)
        units, shard = _units[path], TaskContext.get().partitionId()
        final = np.array([end], dtype="<u4").tobytes()
        counts = np.zeros(1, dtype=np.int64)
        start = block = held = 0
        doc_ids, parts = [], []

        def rows(size: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * size), f.type) for f in _RAW_ARROW], schema=_RAW_ARROW)

        def full() -> pa.RecordBatch:
            nonlocal counts
            ids = np.frombuffer(b"".join(parts), "<u4")
            seen = np.bincount(ids)
            size = max(len(seen), len(counts))
            counts = np.pad(counts, (0, size - len(counts))) + np.pad(seen, (0, size - len(seen)))
            return rows(1, shard=[shard], block=[block], start=[start], doc_ids=[doc_ids], lengths=[[len(x) // 4 for x in parts]],
                        ids=[ids.astype("<u2" if len(seen) <= 1 << 16 else "<u4").tobytes()])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = units.encode(text, final)
                doc_ids.append(doc_id)
                parts.append(ids)
                held += len(ids) // 4
                if held >= BLOCK:
                    yield full()
                    start, block, held, doc_ids, parts = start + held, block + 1, 0, [], []
        if parts:
            yield full()
        symbols = np.flatnonzero(counts)
        yield rows(len(symbols), shard=np.full(len(symbols), shard), symbol=symbols, n=counts[symbols])

    return run


def _table(key: str, symbols: list[int], frequencies: list[int]) -> rans.Table:
    if key not in _tables:
        _tables.clear()
        _tables[key] = rans.Table(np.array(symbols), np.array(frequencies))
    return _tables[key]


def _encode(key: str, symbols: np.ndarray, frequencies: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(key, symbols, frequencies)
        for batch in batches:
            for i in range(batch.num_rows):
                raw, n = batch.column(5)[i].as_py(), sum(batch.column(4)[i].as_py())
                payload = rans.encode(np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4"), table)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, 1) for k in range(5)), pa.array([payload], pa.binary())],
                                                 names=["shard", "block", "start", "doc_ids", "lengths", "payload"])

    return run


def _decode(key: str, symbols: np.ndarray, frequencies: np.ndarray, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(key, symbols, frequencies)
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, lengths = batch.column(1)[i].as_py(), np.array(batch.column(2)[i].as_py(), dtype=np.int64)
                ids = rans.decode(batch.column(3)[i].as_py(), table)
                ends = np.concatenate(([0], np.cumsum(lengths)))
                if ends[-1] != len(ids):
                    raise rans.Corrupt("the block's documents do not add up to its ids")
                out = {"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(batch.column(0)[i].as_py() + ends[:-1], pa.int64()),
                       "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends, ends[1:])], pa.int64())}
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view("<i4"), pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    return run


def write_tokens(docs: DataFrame, vocabulary: str, path: str | None = None, end: int = END) -> str:
    """Tokenise ``docs(doc_id, text, ...)`` into a file set; returns its folder.

    Documents lie in ascending ``doc_id`` order (null ids first, rows of one id by their
    text), each followed by the id ``end``. Null and empty texts have only the end id.
    An empty table gives an empty set. Other columns are not read. ``path`` is a folder
    that all machines share; by default one in ``spark.checkpoint.dir``.
    """
    spark = docs.sparkSession
    ship(spark)
    path = path or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex[:12]}"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    raw = keep(ordered.mapInArrow(_tokenise(vocabulary, end), _RAW), "raw-ids")
    shards = (raw.df.where("block is not null")
              .groupBy("shard").agg(F.min(F.get("doc_ids", F.lit(0))).alias("least"), F.max(F.col("start") + F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n"))
              .collect())
    base, total = [], 0
    for shard in sorted(shards, key=lambda r: r["shard"]):
        base.append((shard["shard"], total))
        total += shard["n"]
    counted = raw.df.where("symbol is not null").groupBy("symbol").agg(F.sum("n").alias("n")).collect()
    table = rans.Table.from_counts([r["symbol"] for r in counted] or [end], [r["n"] for r in counted] or [1])
    spark.createDataFrame([(int(s), int(f)) for s, f in zip(table.symbols, table.frequencies)], "symbol int, frequency int").coalesce(1).write.parquet(f"{path}/table")
    offsets = spark.createDataFrame(base, "shard int, base long")
    blocks = (raw.df.where("block is not null").join(F.broadcast(offsets), "shard")
              .select("shard", "block", (F.col("start") + F.col("base")).alias("start"), "doc_ids", "lengths", "ids"))
    blocks.mapInArrow(_encode(path, table.symbols, table.frequencies), _BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    raw.drop()
    return path


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Decode a file set: ``doc_id, start, n_tokens, ids_crc32`` and ``ids``, checksums verified."""
    ship(spark)
    rows = sorted(spark.read.parquet(f"{path}/table").collect())
    symbols, frequencies = (np.array([r[i] for r in rows], dtype=np.int64) for i in (0, 1))
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    return (blocks.select("start", "doc_ids", "lengths", "payload")
            .mapInArrow(_decode(path, symbols, frequencies, with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids))
