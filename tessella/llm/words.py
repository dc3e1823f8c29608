"""Vectorised words and word fingerprints over UTF-8 buffers.

A word's fingerprint is a mix of its bytes read as whole numbers (longer words:
their XXH3 hash). A-Z is folded to a-z; other characters count as they are.
``prefix_sums`` are polynomials modulo 2**64, for choosing positions only:
texts can be made up whose polynomials collide.
"""

from __future__ import annotations

import numpy as np
import xxhash

BASE = 0x9E3779B97F4A7C15
PIECE = 1 << 20
#: Words of at most so many bytes are read as two numbers.
PACKED = 16
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_PUNCT = _SPACE.copy()
for _c in range(128):
    if not chr(_c).isalnum():
        _PUNCT[_c] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of BASE and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, PIECE + 4096)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """S with S[j]-S[i] = fingerprint of values[i:j] times BASE**-i."""
    _, down = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * down[:len(values)], out=out[1:])
    return out


def words(text: np.ndarray, offsets: np.ndarray, punctuation: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and fingerprint of each word; words never cross rows.

    Words are runs without ``[\\x20\\x09-\\x0D]``, or, with ``punctuation``,
    runs without ASCII characters other than letters and digits.
    """
    apart = (_PUNCT if punctuation else _SPACE)[text]
    n = len(text)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64)
    before = np.ones(n + 1, bool)
    before[1:] = apart
    before[offsets[:-1]] = True
    after = np.ones(n + 1, bool)
    after[:n] = apart
    after[offsets[1:]] = True
    inside = ~apart
    starts = np.flatnonzero(inside & before[:n])
    ends = np.flatnonzero(inside & after[1:]) + 1
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    return starts, ends, rows, _fingerprints(text, starts, ends)


def _fingerprints(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each word's folded bytes: up to ``PACKED`` bytes as two whole numbers, longer ones by XXH3."""
    folded = np.zeros(len(text) + PACKED, np.uint8)
    folded[:len(text)] = _LOWER[text]
    eights = np.ndarray(len(text) + PACKED - 7, "<u8", folded, strides=(1,))
    size = ends - starts
    first, second = eights[starts], eights[np.minimum(starts + 8, len(eights) - 1)]
    first = first & _MASKS[np.minimum(size, 8)]
    second = second & _MASKS[np.clip(size - 8, 0, 8)]
    out = mix(mix(first ^ np.uint64(BASE)) + second * np.uint64(0xD6E8FEB86659FD93) + size.astype(np.uint64))
    long = np.flatnonzero(size > PACKED)
    if len(long):
        view = memoryview(folded)
        out[long] = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist())), np.uint64, len(long))
    return out


def prefixes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """The words' first bytes (at most 7, A-Z folded) as numbers, for each of ``lengths`` in rising order."""
    out, key, last = [], np.zeros(len(starts), np.uint64), max(len(text) - 1, 0)
    for k in range(lengths[-1]):
        at = starts + k
        here = np.where(at < ends, _LOWER[text[np.minimum(at, last)]], 0) if len(text) else at
        key = key | (here.astype(np.uint64) << np.uint64(8 * k))
        if k + 1 in lengths:
            out.append(key | np.uint64(k + 1) << np.uint64(56))
    return out


def shingles(rows: np.ndarray, prints: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of runs of ``width`` words, row bounds and word bounds.

    A row with fewer words, but at least one, gives its whole sequence as one.
    The result's values are grouped by row: row r holds values[b[r]:b[r+1]].
    """
    counts = np.bincount(rows, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(counts)])
    sizes = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    base = np.uint64(0xD6E8FEB86659FD93)
    mixed = mix(prints)
    values = np.empty(bounds[-1], np.uint64)
    if len(prints) >= width:
        run = np.zeros(len(prints) - width + 1, np.uint64)
        for k in range(width):
            run = run * base + mixed[k:len(prints) - width + 1 + k]
        at = np.flatnonzero(rows[:len(run)] == rows[width - 1:])
        long = np.repeat(counts >= width, sizes)
        values[long] = run[at]
    for r in np.flatnonzero((counts > 0) & (counts < width)):
        acc = np.uint64(counts[r])
        with np.errstate(over="ignore"):
            for v in mixed[first[r]:first[r + 1]]:
                acc = acc * base + v
        values[bounds[r]] = acc
    return mix(values), bounds, first
