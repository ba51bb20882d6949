"""Operator 11: fill-in-middle transformation by a Fenwick tree over text blocks.

A text's UTF-8 bytes are cut into blocks of a fixed size. Every block counts the units
(code points, words or lines) and the code points that begin in it; a Fenwick tree over
the blocks holds both counts. The place after ``k`` units is found by binary lifting: from
the highest power of two down, a step is taken while the units passed stay within ``k``.
That ends at the block of the cut, and only this block is looked into. The text is never
decoded, and a cut costs log(blocks) steps and one block whatever the text's length.

Which form a document gets and where it is cut follow from a hash of its id, so a task
that is run again, or another partitioning, gives the same rows. No shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsift.llm.store import ship

BLOCK = 4096
BATCH = 512
PLAIN_FROM = 90     # of 100: from here on a document stays plain
SPM_BELOW = 20      # of 100: below it suffix-prefix-middle, else prefix-suffix-middle
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def point_starts(raw: np.ndarray) -> np.ndarray:
    """Whether a byte begins a code point."""
    return (raw & 0xC0) != 0x80


def unit_starts(raw: np.ndarray, unit: str) -> np.ndarray:
    """Whether a byte begins a unit. The first byte always does, so every byte is in a unit."""
    if unit == "char":
        return point_starts(raw)
    starts = np.zeros(len(raw), dtype=bool)
    if unit == "line":
        starts[1:] = raw[:-1] == 10
    elif unit == "word":
        space = _SPACE[raw]
        starts[1:] = space[:-1] & ~space[1:]
        if len(raw) and space[0] and starts.any():    # leading blanks belong to the first word
            starts[np.argmax(starts)] = False
    else:
        raise ValueError(f"unit {unit!r} is none of char, word, line")
    starts[:1] = True
    return starts


class BlockTree:
    """Fenwick tree over the blocks of one text; row 0 counts units, row 1 code points."""

    def __init__(self, data: bytes, unit: str = "char", block: int = BLOCK):
        raw = np.frombuffer(data, dtype=np.uint8)
        self.size, self.block = len(raw), block
        self.starts = unit_starts(raw, unit)
        self.points = self.starts if unit == "char" else point_starts(raw)
        edges = np.arange(0, len(raw), block)
        self.blocks = len(edges)
        self.tree = np.zeros((2, self.blocks + 1), dtype=np.int64)
        if self.blocks:
            for row, flags in enumerate((self.starts, self.points)):
                self.tree[row, 1:] = np.add.reduceat(flags, edges, dtype=np.int64)
        self.units = int(self.tree[0].sum())
        step = 1
        while 2 * step <= self.blocks:     # a node takes its children's sums, narrow ones first
            at = np.arange(2 * step, self.blocks + 1, 2 * step)
            self.tree[:, at] += self.tree[:, at - step]
            step *= 2

    def cut(self, k: int) -> tuple[int, int]:
        """Byte offset and code points before the place after the first ``k`` units."""
        if not 0 <= k <= self.units:
            raise ValueError(f"{k} of {self.units} units")
        at, passed, points, step = 0, 0, 0, 1 << max(self.blocks.bit_length() - 1, 0)
        while step:
            ahead = at + step
            if ahead <= self.blocks and passed + self.tree[0, ahead] <= k:
                at, passed, points = ahead, passed + int(self.tree[0, ahead]), points + int(self.tree[1, ahead])
            step >>= 1
        if k == self.units:
            return self.size, points
        first = at * self.block
        inside = int(np.flatnonzero(self.starts[first : first + self.block])[k - passed])
        return first + inside, points + int(np.count_nonzero(self.points[first : first + inside]))


def arrange(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    """The three parts in the order and between the marks of the form."""
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    return b"".join((p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle))


def _cutter(unit: str, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                texts, forms, first, second = (part.column(i).to_pylist() for i in range(1, 5))
                units, prefixes, middles, outputs = [], [], [], []
                for text, form, one, two in zip(texts, forms, first, second):
                    tree = BlockTree(text, unit, block)
                    units.append(tree.units)
                    if form == "plain":
                        prefixes.append(None)
                        middles.append(None)
                        outputs.append(text)
                        continue
                    (a, before), (b, upto) = map(tree.cut, sorted((one % (tree.units + 1), two % (tree.units + 1))))
                    prefixes.append(before)
                    middles.append(upto - before)
                    outputs.append(arrange(form, text[:a], text[a:b], text[b:]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(units, pa.int64()), part.column(2), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, pa.binary())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def _draws(key: Column, seed: str) -> list[Column]:
    """Four numbers below 2^32 from the hash of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: str = "1", unit: str = "char", plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW, block: int = BLOCK) -> DataFrame:
    """Cut every whole text of ``docs(doc_id, text, ...)`` in three and put the middle last.

    Returns ``doc_id, n, form, prefix_chars, middle_chars, output``: the units of the text,
    ``plain``, ``psm`` or ``spm``, the code points of prefix and middle (null if plain) and
    the transformed text. Cuts fall between units, each place with equal chance, drawn from
    the hash of ``seed`` and ``doc_id``.

    Null texts count as empty ones; an empty text, and one that holds a mark itself, stays
    plain, so ``restore`` is exact. A null id is drawn as an empty id. Equal ids, repeated
    rows among them, get equal draws; every row comes back once. An empty table gives no
    rows. Other columns, whatever their names, are not read. A text is held by one task.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    h1, h2, h3, h4 = _draws(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), seed)
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("text") == "") | marked | (h3 % 100 >= plain_from), "plain").when(h4 % 100 < spm_below, "spm").otherwise("psm")
    asked = rows.select("doc_id", F.col("text").cast("binary").alias("text"), form.alias("form"), h1.alias("first"), h2.alias("second"))
    cut = asked.mapInArrow(_cutter(unit, block), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return cut.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text rebuilt from an output and its form alone.

    The parts hold no mark, and none can arise where a part and a mark meet (a mark's
    second and third characters begin no mark), so each mark stands once.
    """
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    one, two, three = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(one, three, two)).when(form == "spm", F.concat(two, three, one)).otherwise(output)
