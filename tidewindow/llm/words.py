"""Vectorised word scanning and hashing over Arrow string columns.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D``; those bytes never occur inside
a multi-byte UTF-8 character, so scanning bytes equals scanning code points.  Hashes are polynomial
prefix sums modulo 2**64, finished by a mixer; every array is a few times the size of one block of
text (``BLOCK`` bytes, or one document when that is longer).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
U = np.uint64
#: Odd multipliers of the byte-level and word-level polynomial hashes.
BYTE_BASE, BYTE_BASE_2, WORD_BASES = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Of a byte: 0 space, 1 letter or digit, 2 other.
KIND = np.where(SPACE, 0, 2).astype(np.uint8)
KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = LOWER.tobytes()

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = n + 1 + n // 4
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, dtype=U)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        have = _powers[base] = (out[0], out[1])
    return have


def release() -> None:
    """Hands memory that a task has freed back to the system: workers are used again, and allocators keep what they had."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply), so that any bits of the result may be used."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _prefix(values: np.ndarray, base: int) -> np.ndarray:
    out = np.empty(len(values) + 1, dtype=U)
    out[0] = 0
    np.cumsum(values * powers(base, len(values))[0][: len(values)], out=out[1:])
    return out


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BYTE_BASE) -> np.ndarray:
    """A mixed 64-bit hash of buf[start:end] for each span."""
    if not len(starts):
        return np.zeros(0, dtype=U)
    c = _prefix(buf.astype(U) + U(1), base)
    inverse = powers(base, len(buf))[1]
    return mix((c[ends] - c[starts]) * inverse[starts] + (ends - starts).astype(U))


def window_hashes(tokens: np.ndarray, width: int, base: int = WORD_BASES[0]) -> np.ndarray:
    """A mixed 64-bit hash of each run of width consecutive token hashes."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    c = _prefix(tokens, base)
    return mix((c[width:] - c[:-width]) * powers(base, n)[1][:n])


class Block:
    """Consecutive documents of one batch: rows lo..hi, their bytes, offsets and words.

    first[i]:first[i + 1] are the words of document i; starts and ends are byte positions in buf.
    """

    def __init__(self, lo: int, hi: int, buf: np.ndarray, offsets: np.ndarray, lower: bool):
        self.lo, self.hi, self.offsets = lo, hi, offsets
        self.buf = LOWER[buf] if lower else buf
        inside = np.zeros(len(buf) + 2, dtype=bool)
        np.logical_not(SPACE[self.buf], out=inside[1:-1])
        edge = np.zeros(len(buf) + 1, dtype=bool)
        edge[offsets] = True
        self.starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
        self.ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self, base: int = BYTE_BASE) -> np.ndarray:
        return span_hashes(self.buf, self.starts, self.ends, base)

    def tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and first-of-document of the block's tokens: runs of letters and digits (bytes over
        0x7F count as letters), and runs of other printing characters."""
        kind = np.zeros(len(self.buf) + 2, dtype=np.uint8)
        kind[1:-1] = KIND[self.buf]
        edge = kind[1:] != kind[:-1]
        edge[self.offsets] = True
        starts = np.flatnonzero(edge & (kind[1:] > 0))
        ends = np.flatnonzero(edge & (kind[:-1] > 0))
        return starts, ends, np.searchsorted(starts, self.offsets)

    def text(self, i: int) -> bytes:
        return self.buf[self.offsets[i] : self.offsets[i + 1]].tobytes()


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def blocks(column: pa.Array, lower: bool = False, size: int = BLOCK) -> Iterator[Block]:
    """The documents of a column in blocks of about size bytes, a longer document alone."""
    if not len(column):
        return
    buf, offsets = raw_text(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        part = offsets[lo : hi + 1]
        yield Block(lo, hi, buf[part[0] : part[-1]], part - part[0], lower)
        lo = hi


def segment_min_positions(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of width consecutive values, the position of its smallest (leftmost of equals)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best = np.arange(len(values))
    have = 1
    while have < width:  # double the span that best covers, then finish with an overlapping pair
        step = min(have, width - have)
        a, b = best[:-step], best[step:]
        best = np.where(values[b] < values[a], b, a)
        have += step
    return best
