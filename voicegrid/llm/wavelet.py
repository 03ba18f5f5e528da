"""Wavelet matrix: a sequence of small numbers as bit planes with rank and select.

Plane by plane, from the highest bit, the sequence is split stably by its bit:
zeros first, then ones.  The file holds, for each plane, its bits in compressed
blocks of ``BLOCK_BITS`` with the ones before each block, so one symbol is read,
counted or found by touching one block a plane.

File: magic, version, bits, number of symbols, number of documents; the
documents' ids, null marks and lengths; for each plane its zeros, the ones
before each block and each block's place; then the blocks (zstandard).
All numbers are little-endian.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import zstandard

MAGIC = b"WVLT"
HEADER = "<4sHHQQ"
BLOCK_BITS = 1 << 16
BLOCK_BYTES = BLOCK_BITS // 8


def build(values: np.ndarray, bits: int, ids: list[int | None], lengths: np.ndarray) -> bytes:
    """One file's bytes for the tokens of some documents in a row."""
    count = len(values)
    blocks = -(-count // BLOCK_BITS)
    pack = zstandard.ZstdCompressor(level=1).compress
    zeros, ones_before, places, body, at = [], [], [], [], 0
    values = values.astype(np.uint16 if bits <= 16 else np.uint32)
    for bit in range(bits - 1, -1, -1):
        plane = (values & values.dtype.type(1 << bit)).astype(bool)
        packed = np.zeros(blocks * BLOCK_BYTES, np.uint8)
        packed[: -(-count // 8)] = np.packbits(plane)
        ones = np.bitwise_count(packed).reshape(blocks, BLOCK_BYTES).sum(axis=1, dtype=np.uint64)
        zeros.append(count - int(ones.sum()))
        ones_before.append(np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u8") if blocks else np.zeros(0, "<u8"))
        for k in range(blocks):
            body.append(pack(packed[k * BLOCK_BYTES : (k + 1) * BLOCK_BYTES].tobytes()))
            places.append((at, len(body[-1])))
            at += len(body[-1])
        values = np.concatenate([values[~plane], values[plane]])
    return b"".join(
        [
            struct.pack(HEADER, MAGIC, 1, bits, count, len(ids)),
            np.array([0 if i is None else i for i in ids], "<i8").tobytes(),
            np.array([i is None for i in ids], "<u1").tobytes(),
            np.asarray(lengths, "<u8").tobytes(),
            np.array(zeros, "<u8").tobytes(), b"".join(x.tobytes() for x in ones_before),
            np.array(places, "<u8").tobytes(), *body,
        ]
    )


class WaveletFile:
    """A file open for reading; only the blocks in use are read."""

    def __init__(self, handle) -> None:
        self.handle = handle
        magic, version, self.bits, self.count, docs = struct.unpack(HEADER, handle.read(struct.calcsize(HEADER)))
        if magic != MAGIC or version != 1:
            raise ValueError("not a wavelet file of this version")
        self.blocks = -(-self.count // BLOCK_BITS)
        ids, nulls = np.frombuffer(handle.read(8 * docs), "<i8"), np.frombuffer(handle.read(docs), "<u1")
        self.ids = [None if null else int(i) for i, null in zip(ids, nulls)]
        self.lengths = np.frombuffer(handle.read(8 * docs), "<u8").astype(np.int64)
        self.zeros = np.frombuffer(handle.read(8 * self.bits), "<u8").astype(np.int64)
        size = self.bits * self.blocks
        self.ones_before = np.frombuffer(handle.read(8 * size), "<u8").astype(np.int64).reshape(self.bits, self.blocks)
        self.places = np.frombuffer(handle.read(16 * size), "<u8").astype(np.int64).reshape(self.bits, self.blocks, 2)
        self.body = handle.tell()
        self.block = lru_cache(maxsize=64)(self._block)

    def _block(self, plane: int, block: int) -> np.ndarray:
        """The bits of one block."""
        at, size = self.places[plane, block]
        self.handle.seek(self.body + int(at))
        raw = zstandard.ZstdDecompressor().decompress(self.handle.read(int(size)), max_output_size=BLOCK_BYTES)
        return np.unpackbits(np.frombuffer(raw, np.uint8))

    def _ones(self, plane: int, position: int) -> int:
        """Ones in a plane before a position."""
        block, rest = divmod(position, BLOCK_BITS)
        if block == self.blocks:
            return self.count - int(self.zeros[plane])
        return int(self.ones_before[plane, block]) + int(self.block(plane, block)[:rest].sum(dtype=np.int64))

    def access(self, position: int) -> int:
        """The symbol at a position."""
        if not 0 <= position < self.count:
            raise IndexError(position)
        value = 0
        for plane in range(self.bits):
            bit = int(self.block(plane, position // BLOCK_BITS)[position % BLOCK_BITS])
            ones = self._ones(plane, position)
            position = int(self.zeros[plane]) + ones if bit else position - ones
            value = 2 * value + bit
        return value

    def _range(self, symbol: int, low: int, high: int) -> tuple[int, int]:
        """Where the symbol's occurrences in [low, high) stand behind the last plane."""
        for plane in range(self.bits):
            low_ones, high_ones = self._ones(plane, low), self._ones(plane, high)
            if symbol >> (self.bits - 1 - plane) & 1:
                low, high = int(self.zeros[plane]) + low_ones, int(self.zeros[plane]) + high_ones
            else:
                low, high = low - low_ones, high - high_ones
        return low, high

    def rank(self, symbol: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of a symbol in [low, high)."""
        if not 0 <= symbol < 1 << self.bits:
            return 0
        first, end = self._range(symbol, low, self.count if high is None else high)
        return end - first

    def _find(self, plane: int, bit: int, nth: int) -> int:
        """Position of the n-th (from 0) such bit in a plane."""
        before = self.ones_before[plane]
        if not bit:
            before = np.arange(self.blocks) * BLOCK_BITS - before
        block = int(np.searchsorted(before, nth, "right")) - 1
        return block * BLOCK_BITS + int(np.flatnonzero(self.block(plane, block) == bit)[nth - int(before[block])])

    def select(self, symbol: int, nth: int) -> int:
        """Position of the n-th occurrence (from 0) of a symbol."""
        if not 0 <= nth < self.rank(symbol):
            raise IndexError(nth)
        at = self._range(symbol, 0, self.count)[0] + nth
        for plane in range(self.bits - 1, -1, -1):
            bit = symbol >> (self.bits - 1 - plane) & 1
            at = self._find(plane, bit, at - int(self.zeros[plane]) if bit else at)
        return at

    def tokens(self) -> np.ndarray:
        """The whole sequence, from the lowest plane back to the order of the first."""
        values = np.zeros(self.count, np.uint16 if self.bits <= 16 else np.uint32)
        for plane in range(self.bits - 1, -1, -1):
            ones = np.concatenate([self._block(plane, k) for k in range(self.blocks)] or [np.zeros(0, np.uint8)])
            ones = ones[: self.count].astype(bool)
            zeros = int(self.zeros[plane])
            out = np.empty_like(values)
            out[~ones] = values[:zeros]
            out[ones] = values[zeros:] | values.dtype.type(1 << (self.bits - 1 - plane))
            values = out
        return values
