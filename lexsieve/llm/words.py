"""Vectorised word splitting and rolling hashes over Arrow text columns.

A *word* is a maximal run of ASCII letters, digits or non-ASCII bytes (white space and general
punctuation outside ASCII separate words too); case is folded for ASCII and Latin-1 letters.
Words are known by 64-bit hashes. Everything works on Arrow buffers with numpy, a slab of
documents at a time, so that a Python worker needs a few tens of megabytes whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_M = 0x9E3779B97F4A7C15 | 1
_MI = pow(_M, -1, 1 << 64)
SLAB_BYTES = 1 << 20

_IS_WORD = np.zeros(256, bool)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _IS_WORD[_c] = True
_IS_WORD[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_pow: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


_VALUE = mix(np.arange(1, 257, dtype=U) * U(0x2545F4914F6CDD1D))


def powers(n: int, base: int = _M) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _pow.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        run = np.full(size, base, U)
        run[0] = 1
        with np.errstate(over="ignore"):
            have = _pow[base] = np.cumprod(run, dtype=U)
        if size > 1 << 22:
            del _pow[base]
    return have[:n]


def _segment_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end], position independent, for many segments at once."""
    n = len(values)
    total = np.zeros(n + 1, U)
    np.cumsum(values * powers(n), out=total[1:])
    return mix((total[end] - total[start]) * powers(n + 1, _MI)[start] + (end - start).astype(U))


@dataclass
class Slab:
    """Words of consecutive documents: rows [row, row + len(offsets) - 1) of the batch."""

    row: int
    offsets: np.ndarray  # first word of each document, and the end
    words: np.ndarray  # uint64 hash of each word
    begin: np.ndarray  # byte position of each word within its document
    end: np.ndarray

    @property
    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def text_buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; nulls count as empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = text.cast(pa.large_string())
    if text.null_count:
        text = text.fill_null("")
    if not len(text):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], body[offsets[0] : offsets[-1]]


def slab_bounds(offsets: np.ndarray, size: int = SLAB_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that hold about `size` bytes; a longer document has a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def fold(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Case-folded bytes, and which of them belong to words."""
    inside = _IS_WORD[body]
    low = _FOLD[body]
    high = np.flatnonzero(body >= 0xC2)
    if len(high):
        lead = body[high]
        nxt = body[np.minimum(high + 1, len(body) - 1)]
        upper = high[(lead == 0xC3) & (nxt >= 0x80) & (nxt <= 0x9E) & (nxt != 0x97)] + 1
        low[upper] += 0x20
        blank = high[(lead == 0xC2) & (nxt <= 0xBF) & (np.isin(nxt, (0xA0, 0x85, 0xA1, 0xAB, 0xB7, 0xBB, 0xBF)))]
        inside[blank] = inside[np.minimum(blank + 1, len(body) - 1)] = False
        third = body[np.minimum(high + 2, len(body) - 1)]
        wide = high[((lead == 0xE2) & (nxt <= 0x81)) | ((lead == 0xE3) & (nxt == 0x80) & (third <= 0x82))]
        for step in (0, 1, 2):
            inside[np.minimum(wide + step, len(body) - 1)] = False
    return low, inside


def slabs(text: pa.Array, size: int = SLAB_BYTES) -> Iterator[Slab]:
    offsets, body = text_buffers(text)
    for lo, hi in slab_bounds(offsets, size):
        part, cuts = body[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        if not len(part):
            none = np.zeros(0, np.int64)
            yield Slab(lo, np.zeros(hi - lo + 1, np.int64), np.zeros(0, U), none, none)
            continue
        low, inside = fold(part)
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = cuts[:-1][cuts[:-1] < len(part)]
        first[edges] |= inside[edges]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        tails = cuts[1:][cuts[1:] > 0] - 1
        last[tails] |= inside[tails]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        hashed = _segment_hash(_VALUE[low], start, end)
        at = np.searchsorted(start, cuts, "left")
        base = np.repeat(cuts[:-1], np.diff(at))
        yield Slab(lo, at, hashed, start - base, end - base)


def gram_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words (length n - k + 1, at least 0)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    at = np.arange(n)
    return _segment_hash(words, at, at + k)


def starts_within(offsets: np.ndarray, k: int, n: int) -> np.ndarray:
    """Whether k words from each of the first n positions lie in one document."""
    end = np.repeat(offsets[1:], np.diff(offsets))[:n]
    return np.arange(n) + k <= end


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    if len(x) < w:
        return x[:0]
    have, run = 1, x
    while have * 2 <= w:
        run = np.minimum(run[: len(run) - have], run[have:])
        have *= 2
    rest = w - have
    return np.minimum(run[: len(run) - rest], run[rest:]) if rest else run
