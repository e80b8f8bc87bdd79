"""Vectorised text primitives on UTF-8 buffers: words, word hashes, sliding windows.

A word is a run of bytes other than 0x20 and 0x09-0x0D. UTF-8 continuation bytes are never
among those, so a split of bytes is a split of characters. Prefix sums make the polynomial
hash of any span one subtraction and one product. There are two kinds:

* hashes that wrap modulo 2**64 choose anchors and samples. Unequal spans may share one (built
  texts can force it), which costs work and no result.
* keys, residues modulo two primes (62 bits), name words and windows.

Long texts are hashed in steps of ``STEP_ROWS`` values, so tables of powers stay short.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

BASE = np.uint64(0x9E3779B97F4A7C15 | 5)  # odd, so it has an inverse modulo 2**64
STEP = np.uint64(0xD6E8FEB86659FD93)

STEP_ROWS = 1 << 18
LONG_WORD = 4096  # longer words are named by a BLAKE2 digest

PRIMES = (2147483647, 2147483629)
#: Bases of the keys of words, and of windows in two independent kinds.
WORD_BASES = (1103515245, 1664525801)
WINDOW_BASES = ((48271069, 1406157717), (69621233, 1812433253))

_POWERS: dict[int, list[np.ndarray]] = {}
_RESIDUES: dict[tuple[int, int], list[np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n; the tables are kept and only grow."""
    key = int(base)
    if key not in _POWERS or len(_POWERS[key][0]) < n:
        size = max(n, 1 << 16)
        made = []
        for b in (key, pow(key, -1, 1 << 64)):
            out = np.empty(size, dtype=np.uint64)
            out[0] = 1
            done = 1
            while done < size:
                m = min(done, size - done)
                out[done : done + m] = out[:m] * np.uint64(pow(b, done, 1 << 64))
                done += m
            made.append(out)
        _POWERS[key] = made
    return _POWERS[key][0], _POWERS[key][1]


def residues(base: int, prime: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo a prime below 2**31, for i below n; the tables are kept and only grow."""
    if (base, prime) not in _RESIDUES or len(_RESIDUES[base, prime][0]) < n:
        size, made = max(n, 1 << 12), []
        for b in (base, pow(base, -1, prime)):
            out = np.empty(size, dtype=np.uint64)
            out[0], done = 1, 1
            while done < size:
                m = min(done, size - done)
                out[done : done + m] = out[:m] * np.uint64(pow(b, done, prime)) % np.uint64(prime)
                done += m
            made.append(out)
        _RESIDUES[base, prime] = made
    return _RESIDUES[base, prime][0], _RESIDUES[base, prime][1]


def spans_key(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, bases: tuple[int, int]) -> np.ndarray:
    """62-bit key of values[start:end] for each span, from residues modulo two primes; at most 2**25 values below 2**31."""
    out = np.zeros(len(starts), dtype=np.uint64)
    sums = np.empty(len(values) + 1, dtype=np.uint64)
    for base, prime in zip(bases, PRIMES, strict=True):
        up, down = residues(base, prime, len(values) + 1)
        p = np.uint64(prime)
        sums[0] = 0
        products = values * up[: len(values)]
        np.cumsum(products % p if len(values) and int(values.max()) >> 9 else products, out=sums[1:])
        out = out << np.uint64(31) | (sums[ends] - sums[starts]) % p * down[starts] % p
    return out


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser on uint64, so that every bit depends on all bits."""
    h = h + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Polynomial hash of values[start:end] for each span (uint64 values)."""
    up, down = powers(base, len(values) + 1)
    sums = np.empty(len(values) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow column as one byte array with offsets; null counts as empty."""
    arr = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = arr.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return buf, offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes; one longer document is a block of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of the first word of each document (one more entry at the end)."""
    if len(buf) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    ink = ~SPACE[buf]
    edge = np.empty(len(buf) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    np.logical_not(ink, out=edge[1:])  # edge[i]: a word cannot go on from i - 1 to i
    after = edge.copy()
    after[offsets] = True
    starts = np.flatnonzero(ink & after[:-1])
    before = np.empty(len(buf) + 1, dtype=bool)
    before[:-1] = ~ink
    before[-1] = True
    before[offsets] = True
    ends = np.flatnonzero(ink & before[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A mixed 64-bit key of each word: residues modulo two primes and the length."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + STEP_ROWS)))
        long = np.flatnonzero(ends[i:j] - starts[i:j] > LONG_WORD)
        s, e = starts[i:j] - starts[i], ends[i:j] - starts[i]
        s[long] = e[long] = 0
        part = buf[starts[i] : starts[i] + int(e.max())]
        out[i:j] = spans_key(part.astype(np.uint64) + np.uint64(1), s, e, WORD_BASES)
        for k in long:
            out[i + k] = int.from_bytes(hashlib.blake2b(buf[starts[i + k] : ends[i + k]].tobytes(), digest_size=8).digest(), "little")
        i = j
    return mix(out ^ ((ends - starts).astype(np.uint64) << np.uint64(56)), seed)


def window_hashes(values: np.ndarray, width: int, base: np.uint64 = STEP, seed: int = 0) -> np.ndarray:
    """Rabin-Karp hash modulo 2**64 of every run of ``width`` values, mixed; empty if there are fewer."""
    n = max(len(values) - width + 1, 0)
    out = np.empty(n, np.uint64)
    up, down = powers(base, min(n, STEP_ROWS) + width)
    sums = np.empty(min(n, STEP_ROWS) + width, dtype=np.uint64)
    for i in range(0, n, STEP_ROWS):
        m = min(STEP_ROWS, n - i)
        part = values[i : i + m + width - 1]
        sums[0] = 0
        np.cumsum(part * up[: len(part)], out=sums[1 : len(part) + 1])
        out[i : i + m] = mix((sums[width : len(part) + 1] - sums[:m]) * down[:m], seed)
    return out


def window_keys(values: np.ndarray, width: int, kind: int = 0) -> np.ndarray:
    """Rabin-Karp key of every run of ``width`` values, from residues modulo two primes; empty if there are fewer."""
    n = max(len(values) - width + 1, 0)
    out = np.empty(n, np.uint64)
    for i in range(0, n, STEP_ROWS):
        m = min(STEP_ROWS, n - i)
        part = values[i : i + m + width - 1]
        at = np.arange(m)
        # A value has 64 bits, a residue 31: a value gives two neighbouring digits.
        digits = np.empty(2 * len(part), np.uint64)
        digits[0::2], digits[1::2] = part >> np.uint64(33), part & np.uint64(0x7FFFFFFF)
        out[i : i + m] = spans_key(digits, 2 * at, 2 * (at + width), WINDOW_BASES[kind])
    return mix(out, 31 + kind)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    span, out = 1, values
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[:n], out[rest : rest + n]) if rest else out[:n]


def sorted_pairs(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, value) pairs in order, and how often each comes."""
    if not len(doc):
        return doc.astype(np.int64), value, np.zeros(0, np.int64)
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (v[1:] != v[:-1])]))
    return d[first], v[first], np.diff(np.append(first, len(d)))
