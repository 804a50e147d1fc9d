"""Vectorised tokenising and hashing of Arrow text, shared by the operators.

A token is a maximal run of ASCII letters and digits or of non-ASCII
characters other than Latin-1 and general punctuation, lower-cased without
changing its length.  All work is done on the UTF-8 bytes with numpy, a
bounded chunk of documents at a time; only one very long document can make a
chunk larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)

_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = True
_WORD[ord("a") : ord("z") + 1] = True
_WORD[ord("A") : ord("Z") + 1] = True
_WORD[128:] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = n + n // 4  # chunks differ in length: not another table for each longer one
        for k, base in ((0, _P), (1, _P_INV)):
            out = np.empty(size, np.uint64)
            out[0] = 1
            out[1:] = np.uint64(base)
            np.multiply.accumulate(out, out=out)
            _powers[k] = out
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(raw: np.ndarray, off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Successive row ranges of about ``limit`` bytes: first row, end row, bytes, offsets."""
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def lower(raw: np.ndarray) -> np.ndarray:
    """Lower case of ASCII, Latin-1, Greek and Cyrillic capitals, byte for byte."""
    out = _LOWER[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    if len(lead):
        second = raw[lead + 1]
        hit = (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
        out[lead[hit] + 1] += 32
    lead = np.flatnonzero((raw[:-1] == 0xCE) | (raw[:-1] == 0xD0))
    if len(lead):
        first, second = raw[lead], raw[lead + 1]
        near = ((first == 0xCE) & (second >= 0x91) & (second <= 0x9F)) | ((first == 0xD0) & (second >= 0x90) & (second <= 0x9F))
        out[lead[near] + 1] += 32
        far = ((first == 0xCE) & (second >= 0xA0) & (second <= 0xA9)) | ((first == 0xD0) & (second >= 0xA0) & (second <= 0xAF))
        out[lead[far]] += 1
        out[lead[far] + 1] -= 32
    return out


@dataclass
class Tokens:
    """Tokens of a chunk: byte ranges, hashes, and where each row's tokens begin."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row: np.ndarray
    bounds: np.ndarray
    prefix: np.ndarray

    def head(self, k: int) -> np.ndarray:
        """Hash of the first k bytes of each token, or of all of a shorter one."""
        _, inv = powers(len(self.prefix))
        return mix((self.prefix[np.minimum(self.start + k, self.end)] - self.prefix[self.start]) * inv[self.start] + np.uint64(k))


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """h, so that (h[b] - h[a]) / base**a identifies raw[a:b]."""
    power, _ = powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    value = raw.astype(np.uint64)
    value += np.uint64(1)
    value *= power[: len(raw)]
    np.cumsum(value, out=out[1:])
    return out


def tokens(raw: np.ndarray, off: np.ndarray) -> Tokens:
    """The tokens of the rows raw[off[i]:off[i + 1]]."""
    raw = lower(raw) if len(raw) else raw
    word = _WORD[raw]
    if len(raw):
        lead = np.flatnonzero(raw[:-1] == 0xC2)
        lead = lead[~np.isin(raw[lead + 1], (0xAA, 0xB5, 0xBA))]
        word[lead] = word[lead + 1] = False
        lead = np.flatnonzero(raw[:-2] == 0xE2)
        lead = lead[(raw[lead + 1] == 0x80) | (raw[lead + 1] == 0x81)]
        for k in range(3):
            word[lead + k] = False
    fresh = word.copy()
    fresh[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    begins = off[:-1][off[:-1] < off[1:]]
    fresh[begins] = word[begins]
    last[begins[1:] - 1] = word[begins[1:] - 1]
    start, end = np.flatnonzero(fresh), np.flatnonzero(last) + 1
    prefix = prefix_hashes(raw)
    _, inv = powers(len(raw) + 1)
    h = mix((prefix[end] - prefix[start]) * inv[start])
    bounds = np.searchsorted(start, off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(bounds))
    return Tokens(start, end, h, row, bounds, prefix)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values from each place on; fewer places by n - 1."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    power, inv = powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum((h | np.uint64(1)) * power[: len(h)], out=total[1:])
    m = len(h) - n + 1
    return mix((total[n:] - total[:m]) * inv[:m])


def char_starts(raw: np.ndarray) -> np.ndarray:
    """For each byte place, and the end, how many characters begin before it."""
    out = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out


def run_ids(*columns: np.ndarray) -> np.ndarray:
    """Number of each row's run of equal rows, for sorted columns."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)
