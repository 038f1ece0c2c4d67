"""Vectorised word splitting and rolling hashes over Arrow string columns.

Everything here works on the UTF-8 bytes of many documents at once, so the
per-word cost inside a Python worker is a few numpy operations.  Chunks bound
the memory: a chunk holds at most ``CHUNK_BYTES`` of text, or one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

#: Bytes that belong to words split at ASCII white space only.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, 9, 10, 11, 12, 13]] = False

#: Bytes that belong to lower-cased alphanumeric words (all of U+0080 and up).
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True

#: Lower-cases A-Z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser over an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base modulo 2**64 and their inverses, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n >= self.n:
            self.n = max(n + 1, 1 << 16, 2 * self.n)
            steps = np.full(self.n, self.base, np.uint64)
            back = np.full(self.n, self.inverse, np.uint64)
            steps[0] = back[0] = 1
            self.up, self.down = np.cumprod(steps), np.cumprod(back)
        return self.up, self.down


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE_POWERS = Powers(0x9E3779B97F4A7C15 | 1)
FIRST_BASE = Powers(0xD1B54A32D192ED03)
SECOND_BASE = Powers(0xA24BAED4963EE407)


def range_hashes(values: np.ndarray, powers: Powers):
    """A function (starts, ends) -> hashes of values[start:end], any ranges."""
    up, down = powers.upto(len(values))
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=prefix[1:])

    def of(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        spread = (prefix[ends] - prefix[starts]) * down[starts]
        return mix(spread + (ends - starts).astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD))

    return of


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), len(column))
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def split_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """Byte starts and ends of all words, and each document's first word number."""
    flag = is_word[data]
    if len(flag) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    full = offsets[:-1] < offsets[1:]
    before = np.empty_like(flag)
    before[0], before[1:] = False, flag[:-1]
    before[offsets[:-1][full]] = False
    after = np.empty_like(flag)
    after[-1], after[:-1] = False, flag[1:]
    after[offsets[1:][full] - 1] = False
    starts = np.flatnonzero(flag & ~before)
    ends = np.flatnonzero(flag & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    return range_hashes(_BYTES[data], _BYTE_POWERS)(starts, ends)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i:i+width] for each i that has width values."""
    if len(values) < width:
        return values[:0]
    held, have = values, 1
    while 2 * have <= width:
        held, have = np.minimum(held[: len(held) - have], held[have:]), 2 * have
    rest = width - have
    return np.minimum(held[: len(held) - rest], held[rest:]) if rest else held
