"""Words of whole Arrow text columns, found with numpy over the column's own bytes.

A word is a maximal run of bytes other than space and 0x09-0x0D. Texts are UTF-8, so
those six bytes never occur inside a character. Words and lines are compared by a 64-bit
hash that is the same in every process: spans of up to 7 bytes map one to one, those of up to
SHORT are polynomials over the integers modulo the prime 2**61 - 1, longer ones BLAKE2 digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text looked at together; a longer text is taken alone, whole.
CHUNK_BYTES = 1 << 21
#: Bytes of a span in one coefficient, and of the longest span hashed as a polynomial.
STEP, SHORT = 7, 28
_PRIME = np.uint64((1 << 61) - 1)
_HIGH, _LOW = (np.uint64(x) for x in divmod(0x1B7E9D3A54C6F08B, 1 << 31))
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(STEP + 1)], np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def _times_base(h: np.ndarray) -> np.ndarray:
    """h times the base modulo 2**61 - 1, to within one multiple of it, by halves of 31 bits."""
    high, low = h >> np.uint64(31), h & np.uint64((1 << 31) - 1)
    middle = high * _LOW + low * _HIGH
    total = np.uint64(2) * high * _HIGH + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << np.uint64(31)) + low * _LOW
    return (total & _PRIME) + (total >> np.uint64(61))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``data[start:end]`` for every span."""
    size = ends - starts
    if not len(size):
        return np.zeros(0, np.uint64)
    padded = np.concatenate((data, np.zeros(8 + SHORT, np.uint8)))
    eights = np.lib.stride_tricks.as_strided(padded, (len(data) + SHORT + 1, 8), (1, 1))

    def coefficient(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        return eights[at].view("<u8")[:, 0] & _FIRST[np.minimum(left, STEP)]

    h = coefficient(starts, size) | (np.minimum(size, SHORT).astype(np.uint64) << np.uint64(8 * STEP))
    for k in range(STEP, SHORT, STEP):
        more = np.flatnonzero(size > k)
        h[more] = _times_base(h[more]) + coefficient(starts[more] + k, size[more] - k)
    h = mix(np.where(h >= _PRIME, h - _PRIME, h))
    long = np.flatnonzero(size > SHORT)
    if len(long):
        raw, digest = data.tobytes(), hashlib.blake2b
        whole = b"".join(digest(raw[a:b], digest_size=8).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True))
        h[long] = np.frombuffer(whole, "<u8")
    return h


@dataclass
class Words:
    """Words of consecutive texts: ``bounds[i]:bounds[i + 1]`` are those of text ``i``."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    @property
    def texts(self) -> int:
        return len(self.offsets) - 1

    def owner(self) -> np.ndarray:
        """Index of the text that holds each word."""
        return np.repeat(np.arange(self.texts), np.diff(self.bounds))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows within CHUNK_BYTES, whole texts each."""
    data, offsets = text_bytes(column)
    at = 0
    while at < len(column):
        to = int(max(at + 1, np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, "right") - 1))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def find_words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    if lower:
        data = _LOWER[data]
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | np.concatenate(([True], ~inside[:-1]))) if len(data) else inside)
    ends = np.flatnonzero(inside & (edge[1:] | np.concatenate((~inside[1:], [True]))) if len(data) else inside) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` within each pair of neighbouring bounds."""
    run = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return run[bounds[1:]] - run[bounds[:-1]]


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans' bytes, each followed by one space, and where each begins there."""
    size = ends - starts
    first = np.cumsum(size + 1) - (size + 1)
    out = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    before = np.cumsum(size) - size
    at = np.arange(int(size.sum()))
    out[at + np.repeat(first - before, size)] = data[at + np.repeat(starts - before, size)]
    return out, first
