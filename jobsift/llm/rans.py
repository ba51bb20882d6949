"""Static range asymmetric numeral system (rANS) over token ids, in interleaved blocks.

All blocks share one frequency table, quantised to ``1 << BITS``. Token ``i`` of a block
belongs to lane ``i mod LANES``; all lanes step together, so numpy codes ``LANES`` tokens
at a time. States stay in [2^31, 2^63) and are renewed by 32-bit words, which lie in
the stream in the order in which the decoder takes them.

A block is: header, checkpoints, words. A checkpoint holds all lane states and the word
position before step ``k * EVERY``: decoding can start at any of them, so the parts of
a block can be decoded apart. The header has the CRC-32 of the ids (little-endian unsigned
32-bit) and of the rest of the block.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BITS = 20
LANES = 2048
EVERY = 128
_LOW = np.uint64(1 << 31)
_MASK = np.uint64((1 << BITS) - 1)
_HEADER = struct.Struct("<4sIIIIIII")
_MAGIC = b"RNS1"
_U = np.uint64


class Corrupt(ValueError):
    """A block whose checksum, length or magic number is wrong."""


class Table:
    """Symbol frequencies that sum to ``1 << BITS``; every counted symbol keeps a slot."""

    def __init__(self, symbols: np.ndarray, frequencies: np.ndarray):
        self.symbols = np.asarray(symbols, dtype=np.int64)
        self.frequencies = np.asarray(frequencies, dtype=np.int64)
        if int(self.frequencies.sum()) != 1 << BITS or (self.frequencies < 1).any():
            raise ValueError("frequencies must be positive and sum to the scale")
        size = int(self.symbols.max()) + 1
        self.freq = np.zeros(size, dtype=np.uint64)
        self.start = np.zeros(size, dtype=np.uint64)
        self.freq[self.symbols] = self.frequencies
        self.start[self.symbols] = np.cumsum(self.frequencies) - self.frequencies
        self.slot = np.repeat(self.symbols, self.frequencies).astype(np.int32)

    @classmethod
    def from_counts(cls, symbols, counts) -> "Table":
        """Quantise counts: at least one slot each, what is left over goes to the largest."""
        order = np.argsort(np.asarray(symbols))
        symbols, counts = np.asarray(symbols)[order], np.asarray(counts, dtype=np.float64)[order]
        scale = 1 << BITS
        if len(symbols) == 0 or len(symbols) > scale:
            raise ValueError("the table needs between one symbol and as many as it has slots")
        freq = np.maximum(1, np.floor(counts / counts.sum() * (scale - len(symbols)))).astype(np.int64)
        over = int(freq.sum()) - scale
        if over > 0:
            for i in np.argsort(-freq, kind="stable"):
                cut = min(over, int(freq[i]) - 1)
                freq[i] -= cut
                over -= cut
                if not over:
                    break
        else:
            freq[int(np.argmax(freq))] -= over
        return cls(symbols, freq)


def encode(ids: np.ndarray, table: Table) -> bytes:
    """One block."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    n, steps = len(ids), -(-len(ids) // LANES)
    state = np.full(LANES, _LOW, dtype=np.uint64)
    words: list[np.ndarray] = [np.zeros(0, dtype="<u4")] * steps
    points = []
    for step in range(steps - 1, -1, -1):
        part = ids[step * LANES : (step + 1) * LANES]
        x, f = state[: len(part)], table.freq[part]
        full = x >= f << _U(63 - BITS)
        words[step] = (x[full] & _U(0xFFFFFFFF)).astype("<u4")
        x = np.where(full, x >> _U(32), x)
        over = x // f
        state[: len(part)] = (over << _U(BITS)) + (x - over * f) + table.start[part]
        if step % EVERY == 0:
            points.append(state.copy())
    lengths = np.cumsum([0] + [len(x) for x in words])
    body = b"".join(struct.pack("<I", lengths[k * EVERY]) + states.astype("<u8").tobytes() for k, states in enumerate(reversed(points)))
    body += b"".join(x.tobytes() for x in words)
    return _HEADER.pack(_MAGIC, n, LANES, EVERY, len(points), int(lengths[-1]), zlib.crc32(ids.tobytes()), zlib.crc32(body)) + body


def checkpoints(block: bytes) -> int:
    """Number of places from which the block can be decoded."""
    return _HEADER.unpack_from(block)[4]


def decode_part(block: bytes, table: Table, point: int) -> np.ndarray:
    """The ids between checkpoint ``point`` and the next one."""
    _, n, lanes, every, points, n_words, _, _ = _HEADER.unpack_from(block)
    at, size = _HEADER.size + point * (4 + 8 * lanes), 4 + 8 * lanes
    position = struct.unpack_from("<I", block, at)[0]
    state = np.frombuffer(block, "<u8", lanes, at + 4).astype(np.uint64)
    words = np.frombuffer(block, "<u4", n_words, _HEADER.size + points * size)
    first, last = point * every * lanes, min(n, (point + 1) * every * lanes)
    out = np.empty(last - first, dtype="<u4")
    for done in range(0, len(out), lanes):
        x = state[: len(out) - done]
        slot = x & _MASK
        ids = table.slot[slot.astype(np.int64)]
        out[done : done + len(x)] = ids
        x = table.freq[ids] * (x >> _U(BITS)) + slot - table.start[ids]
        low = np.flatnonzero(x < _LOW)
        x[low] = (x[low] << _U(32)) | words[position : position + len(low)]
        position += len(low)
        state = x
    return out


def decode(block: bytes, table: Table) -> np.ndarray:
    """All ids of a block; raises ``Corrupt`` if a checksum differs."""
    if len(block) < _HEADER.size or block[:4] != _MAGIC:
        raise Corrupt("not a block of this format")
    head = _HEADER.unpack_from(block)
    if zlib.crc32(block[_HEADER.size :]) != head[7]:
        raise Corrupt("the block's bytes do not match their checksum")
    parts = [decode_part(block, table, k) for k in range(head[4])]
    ids = np.concatenate(parts) if parts else np.zeros(0, dtype="<u4")
    if len(ids) != head[1] or zlib.crc32(ids.tobytes()) != head[6]:
        raise Corrupt("the decoded ids do not match their checksum")
    return ids
