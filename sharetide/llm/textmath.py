"""Words, word hashes and rolling window hashes of Arrow text columns, without a loop over words.

All functions work on the UTF-8 bytes of a whole batch.  A word is a run of bytes other than
0x20 and 0x09-0x0D; bytes of longer UTF-8 sequences are never among those, so byte-wise splitting is
exact.  Hashes are 64 bits wide: two different word sequences are taken for equal with a probability
of 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20  # text handled at a time; longer single documents are hashed in pieces

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = np.random.Generator(np.random.PCG64(20240613)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << max(0, int(n) - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        _powers[base] = np.multiply.accumulate(have, out=have)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of several documents in a row: document i has words first[i] .. first[i+1]-1."""

    data: np.ndarray  # bytes of the texts
    start: np.ndarray  # first byte of each word
    end: np.ndarray  # byte after each word
    hash: np.ndarray  # uint64
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a piece have about ``limit`` bytes (a longer text stays whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def words_of(column: pa.Array, lower: bool) -> Words:
    data, at = text_bytes(column)
    n = len(data)
    inside = ~_SPACE[data]
    begin, last = inside.copy(), inside.copy()
    if n:
        edges = at[(at > 0) & (at < n)]
        begin[1:] &= ~inside[:-1]
        begin[edges] = inside[edges]
        last[:-1] &= ~inside[1:]
        last[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
    table, hashes, a = _BYTE_LOWER if lower else _BYTE, np.empty(len(start), np.uint64), 0
    while a < len(start):  # whole words of about a megabyte
        b = max(a + 1, int(np.searchsorted(end, start[a] + (1 << 20), side="right")))
        low, high = start[a], end[b - 1]
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(table[data[low:high]] * _power(_BASE, high - low), out=total[1:])
        hashes[a:b] = (total[end[a:b] - low] - total[start[a:b] - low]) * _power(_INVERSE, high - low)[start[a:b] - low]
        a = b
    return Words(data, start, end, mix(hashes), np.searchsorted(start, at).astype(np.int64))


def windows_of(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive words; runs over document borders are the caller's matter."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * _power(_BASE, n), out=total[1:])
    return mix((total[k:] - total[:-k]) * _power(_INVERSE, n - k + 1))


def inner(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and documents of all runs of k words that lie within one document."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    shift = first[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else first[:0]
    return np.arange(len(doc)) + shift[doc], doc


def slide(x: np.ndarray, w: int, op=np.minimum) -> np.ndarray:
    """op over every w consecutive values, by doubling."""
    have, out = 1, x
    while have < w:
        step = min(have, w - have)
        out = op(out[:-step], out[step:])
        have += step
    return out


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (length[0] of them), then start[1], ..."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)
