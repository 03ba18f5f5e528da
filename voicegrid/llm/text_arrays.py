"""Whole Arrow text columns as NumPy arrays: words and their 64-bit hashes.

Words are found and hashed on the UTF-8 bytes of many rows at once.  Null
texts count as empty.  A word's hash depends on its bytes only, so equal words
hash equally in every task; two different words share a hash with a chance of
about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
_SEGMENT = 1 << 20
_BYTES = np.arange(256)
#: Lower-cases A-Z only; bytes of longer characters stay.
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Words of anything but white space (space and tab to carriage return).
NOT_SPACE = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
#: Words of a-z, 0-9 and every character beyond ASCII, after lower-casing.
ALPHANUMERIC = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)


def mix(values: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one."""
    x = values + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0xD6E8FEB86659FD93
_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64))
_POWERS: list[np.ndarray] = []


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < size:
        grown = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            values = np.full(max(2 * size, 4096), base, np.uint64)
            values[0] = 1
            grown.append(np.multiply.accumulate(values))
        _POWERS[:] = grown
    return _POWERS[0], _POWERS[1]


@dataclass
class Words:
    """Words of several texts in one row of arrays; text i has words ``first[i]:first[i + 1]``."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_words(column: pa.Array, word_bytes: np.ndarray, lower: bool = True) -> Words:
    """Words of every text, by default lower-cased in A-Z; ``word_bytes`` says which bytes make words."""
    raw, offsets = utf8(column)
    data = LOWER[raw] if lower else raw
    inside = word_bytes[data]
    size = len(data)
    breaks = np.zeros(size + 1, bool)
    breaks[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | breaks[1:size]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | breaks[1:size]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(end) + 1
    return Words(starts, ends, _hashes(data, inside, starts, ends), np.searchsorted(starts, offsets), data, offsets)


def _hashes(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(starts, low + _SEGMENT)))
        high = ends[to - 1]
        power, inverse = _powers(int(high - low))
        values = _BYTE_VALUE[data[low:high]] * power[: high - low]
        values *= inside[low:high]
        out[at:to] = np.add.reduceat(values, starts[at:to] - low) * inverse[starts[at:to] - low]
        at = to
    return mix(out ^ (ends - starts).astype(np.uint64))


def hash_phrase(text: str, word_bytes: np.ndarray) -> np.ndarray:
    """Word hashes of one text."""
    return split_words(pa.array([text]), word_bytes).hashes


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each window of ``size`` words, over all texts without regard to their borders."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for k in range(size):
        out = out * np.uint64(_BASE) + hashes[k : k + count]
    return mix(out)


def in_chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each piece has about ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(batch.schema.names.index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A column by name."""
    return batch.column(batch.schema.names.index(name))


def binaries(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())
