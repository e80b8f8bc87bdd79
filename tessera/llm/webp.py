"""Lossless WebP images: a decoder and an encoder for arrays of ARGB pixels.

Decoder: container, transforms (predictor, cross-colour, subtract-green, palette), prefix
codes, back-references, colour cache and meta prefix groups, as the public format says.
The entropy-coded part of an image with one prefix group is decoded without a step for each
bit: in strips, the length of the token that would start at every bit is found by table
look-ups over whole arrays, the chain of real tokens is followed through these lengths, and
the symbols of the real tokens are read together. Runs of literals and cache hits are filled
in together between two back-references. Images with several groups take a plain path.

Encoder: palette where colours are few, otherwise the cheapest by entropy of plain pixels,
subtract-green and a left predictor; long back-references; colour cache; canonical codes.
Small images share one fixed set of code lengths for text-like bytes, made from a rule, so
that their tables are built once; larger ones get codes of their own.
"""

from __future__ import annotations

import heapq
import struct
from array import array
from functools import lru_cache

import numpy as np

from . import _text

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
HASH = np.uint32(0x1E35A7BD)
SIDE = 1 << 14
LENGTHS, DISTANCES = 24, 40
PREDICTOR, CROSS, GREEN, PALETTE = range(4)
BLACK = np.uint32(0xFF000000)

MAX_CODE = 12  # of our own codes; a reader takes up to 15
STRIP = 1 << 15
SMALL = 1 << 14  # pixels up to which the shared codes are used
TOKEN = 20  # bits of the table of token lengths
MATCH = 8  # pixels that a back-reference needs at least


class Broken(ValueError):
    """Not a lossless WebP image, or a damaged one."""


# ---------------------------------------------------------------- prefix codes


@lru_cache(maxsize=None)
def _reversal(bits: int) -> np.ndarray:
    out = np.zeros(1, dtype=np.int64)
    for _ in range(bits):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Huffman code lengths of at most ``limit`` bits; 0 for symbols without a count."""
    lens = np.zeros(len(counts), dtype=np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lens[used] = 1
        return lens
    weights = counts[used].astype(np.int64)
    while True:
        heap = [(int(w), i) for i, w in enumerate(weights.tolist())]
        heapq.heapify(heap)
        parent, free = [0] * (2 * len(used) - 1), len(used)
        while len(heap) > 1:
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            parent[i] = parent[j] = free
            heapq.heapreplace(heap, (a + b, free))
            free += 1
        depth = [0] * free
        for i in range(free - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth[: len(used)]) <= limit:
            lens[used] = depth[: len(used)]
            return lens
        weights = (weights >> 1) + 1


def codes(lens: np.ndarray) -> np.ndarray:
    """Canonical codes, first bit lowest. A lone symbol has no bits."""
    out = np.zeros(len(lens), dtype=np.int64)
    used = np.flatnonzero(lens)
    order = used[np.argsort(lens[used], kind="stable")]
    span = 1 << (15 - lens[order])
    out[order] = _reversal(15)[(np.cumsum(span) - span) & 32767]
    return out


class Code:
    """Look-up tables of a prefix code: ``bits`` to index by, symbol and length at each index."""

    def __init__(self, lens: np.ndarray):
        used = np.flatnonzero(lens)
        if len(used) == 0:
            raise Broken("a prefix code without symbols")
        if len(used) == 1:
            self.bits, self.symbol, self.length = 0, used[:1].astype(np.int64), np.zeros(1, np.int64)
            return
        self.bits = int(lens.max())
        order = used[np.argsort(lens[used], kind="stable")]
        span = 1 << (self.bits - lens[order])
        if span.sum() != 1 << self.bits:
            raise Broken("a prefix code that is not complete")
        at = _reversal(self.bits)
        self.symbol, self.length = np.repeat(order, span)[at].astype(np.int64), np.repeat(lens[order], span)[at].astype(np.int64)


# ---------------------------------------------------------------- reading bits


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + bytes(16), 0, len(data) * 8

    def read(self, n: int) -> int:
        i = self.at >> 3
        got = int.from_bytes(self.data[i : i + 8], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        if self.at > self.end:
            raise Broken("the data end too soon")
        return got

    def peek_bits(self, at: int, n: int) -> int:
        return int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7) & ((1 << n) - 1)

    def symbol(self, code: Code) -> int:
        i = self.at >> 3
        k = int.from_bytes(self.data[i : i + 4], "little") >> (self.at & 7) & ((1 << code.bits) - 1)
        self.at += int(code.length[k])
        if self.at > self.end:
            raise Broken("the data end too soon")
        return int(code.symbol[k])

    def code(self, size: int) -> Code:
        """One prefix code of an alphabet."""
        lens = np.zeros(max(size, 256), dtype=np.int64)
        if self.read(1):
            two = self.read(1)
            lens[self.read(8 if self.read(1) else 1)] = 1
            if two:
                lens[self.read(8)] = 1
            return Code(lens[:size])
        own = np.zeros(19, dtype=np.int64)
        for k in CODE_LENGTH_ORDER[: 4 + self.read(4)]:
            own[k] = self.read(3)
        own, left = Code(own), size
        if self.read(1):
            left = 2 + self.read(2 + 2 * self.read(3))
        i, last = 0, 8
        while i < size and left:
            left -= 1
            k = self.symbol(own)
            if k < 16:
                lens[i] = k
                last, i = k or last, i + 1
                continue
            n = 3 + self.read(2) if k == 16 else 3 + self.read(3) if k == 17 else 11 + self.read(7)
            if i + n > size:
                raise Broken("too many code lengths")
            lens[i : i + n] = last if k == 16 else 0
            i += n
        return Code(lens[:size])

    #: Groups of codes read lately: (alphabet, bits they took) -> (those bits, codes).
    seen: dict = {}

    def group(self, cache_size: int) -> Group:
        """The five codes of a group. Equal bits make equal codes, so those read before are kept."""
        for key, (bits, known) in reversed(Reader.seen.items()):
            size, n = key
            if size == cache_size and self.at + n <= self.end and self.peek_bits(self.at, n) == bits:
                self.at += n
                Reader.seen[key] = Reader.seen.pop(key)  # the one used last goes last
                return known
        began = self.at
        got = Group([self.code(n) for n in (256 + LENGTHS + cache_size, 256, 256, 256, DISTANCES)])
        if len(Reader.seen) >= 12:
            Reader.seen.pop(next(iter(Reader.seen)))
        Reader.seen[cache_size, self.at - began] = (self.peek_bits(began, self.at - began), got)
        return got


@lru_cache(maxsize=64)
def _near_offsets(width: int) -> np.ndarray:
    return np.array([max(1, x + y * width) for x, y in NEAR], dtype=np.int64)


def _value(symbol: int, r: Reader) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + r.read(extra) + 1


def _distance(v: int, width: int) -> int:
    return int(_near_offsets(width)[v - 1]) if v <= len(NEAR) else v - len(NEAR)


# ---------------------------------------------------------------- entropy-coded images


def _read_plain(r: Reader, groups, group_of, n: int, width: int, cache_bits: int) -> np.ndarray:
    """Token by token; ``group_of(i)`` gives the group of pixel i."""
    out = np.zeros(n, dtype=np.uint32)
    cache, done, shift = [0] * (1 << cache_bits), 0, 32 - cache_bits
    fresh = 0  # pixels before this one are in the cache
    while done < n:
        green, red, blue, alpha, dist = groups[group_of(done)]
        s = r.symbol(green)
        if s < 256:
            out[done] = (s << 8) | r.symbol(red) << 16 | r.symbol(blue) | r.symbol(alpha) << 24
            done += 1
            continue
        if s < 256 + LENGTHS:
            length = _value(s - 256, r)
            back = _distance(_value(r.symbol(dist), r), width)
            if back > done or done + length > n:
                raise Broken("a back-reference outside the image")
            _copy(out, done, length, back)
            done += length
            continue
        if cache_bits:
            for p in out[fresh:done].tolist():
                cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> shift] = p
            fresh = done
        out[done] = cache[s - 256 - LENGTHS]
        done += 1
    return out


def _copy(out: np.ndarray, at: int, length: int, back: int) -> None:
    if back >= length:
        out[at : at + length] = out[at - back : at - back + length]
    else:
        out[at : at + length] = np.resize(out[at - back : at], length)


def _windows(data: np.ndarray, a: int, n: int) -> np.ndarray:
    """56 or more bits from every bit of bytes a to a + n, as int64."""
    piece = data[a : a + n + 8].astype(np.uint64)
    v = piece[:n].copy()
    for k in range(1, 8):
        v |= piece[k : k + n] << np.uint64(8 * k)
    return (v[:, None] >> np.arange(8, dtype=np.uint64)[None, :]).ravel().view(np.int64)


class Group(list):
    """The five codes of a group, with the length of a whole token by its first bits once that pays."""

    def __init__(self, found):
        super().__init__(found)
        green, _, _, _, dist = found
        self.masks = [(1 << c.bits) - 1 for c in found]
        self.literal = (green.symbol < 256).astype(np.int64)
        self.copy = (green.symbol >= 256) & (green.symbol < 256 + LENGTHS)
        self.extra = np.where(self.copy & (green.symbol >= 260), (green.symbol - 258) >> 1, 0)
        self.dist_extra = np.where(dist.symbol < 4, 0, (dist.symbol - 2) >> 1)
        self.copies = bool(self.copy.any())
        self.reads, self.table = 0, None

    def lengths(self, w: np.ndarray) -> np.ndarray:
        """Bits of the token that starts each window."""
        green, red, blue, alpha, dist = self
        g = w & self.masks[0]
        used = green.length[g]
        rest = red.length[(w >> used) & self.masks[1]]
        rest = rest + blue.length[(w >> (used + rest)) & self.masks[2]]
        if alpha.bits:
            rest = rest + alpha.length[(w >> (used + rest)) & self.masks[3]]
        step = used + rest * self.literal[g]
        if self.copies:
            c = np.flatnonzero(self.copy[g])
            after = used[c] + self.extra[g[c]]
            d = (w[c] >> after) & self.masks[4]
            step[c] = after + dist.length[d] + self.dist_extra[d]
        return step

    def length_of(self, x: int) -> int:
        """``lengths`` of one window."""
        green, red, blue, alpha, dist = self
        g = x & self.masks[0]
        n = int(green.length[g])
        if self.literal[g]:
            n += int(red.length[x >> n & self.masks[1]])
            n += int(blue.length[x >> n & self.masks[2]])
            return n + int(alpha.length[x >> n & self.masks[3]])
        if self.copy[g]:
            n += int(self.extra[g])
            d = x >> n & self.masks[4]
            n += int(dist.length[d]) + int(self.dist_extra[d])
        return n

    def steps(self, w: np.ndarray) -> np.ndarray:
        """As ``lengths``, through a table of the first bits where a group is read often or long; 0: longer than those bits."""
        self.reads += len(w)
        if self.table is None and self.reads > 1 << (TOKEN + 1):
            short = self.lengths(np.arange(1 << TOKEN, dtype=np.int64))
            self.table = np.where(short <= TOKEN, short, 0).astype(np.uint8)
        if self.table is None:
            return self.lengths(w).astype(np.uint8)
        return self.table.take(w & ((1 << TOKEN) - 1))


def _read_fast(r: Reader, group: Group, n: int, width: int, cache_bits: int) -> np.ndarray:
    """All tokens of an image with one group, strip by strip."""
    green, red, blue, alpha, dist = group
    data = np.frombuffer(r.data, dtype=np.uint8)
    _, r_mask, b_mask, a_mask, d_mask = group.masks
    got, pixels, p = [], 0, r.at
    last = len(data) - 8
    while pixels < n:
        a = p >> 3
        size = min(STRIP >> 3, last - a)
        if size <= 0:
            raise Broken("the data end too soon")
        w = _windows(data, a, size)
        step = group.steps(w)
        chain, q = array("i"), p - 8 * a
        stop, note = len(w), chain.append
        if not any(c.bits for c in group[:4]):  # one symbol each: no bits at all
            chain = array("i", [q]) * (n - pixels)
        else:
            follow = memoryview(step)
            while q < stop:
                note(q)
                if k := follow[q]:
                    q += k
                else:
                    q += group.length_of(int(w[q]))
        at = np.frombuffer(chain, dtype=np.int32)
        w = w[at]
        g = w & group.masks[0]
        used = green.length[g]
        sym = green.symbol[g]
        lit = sym < 256
        k = (w >> used) & r_mask
        argb = (sym << 8) | red.symbol[k] << 16
        used = used + red.length[k]
        k = (w >> used) & b_mask
        argb |= blue.symbol[k]
        if alpha.bits:
            argb |= alpha.symbol[(w >> (used + blue.length[k])) & a_mask] << 24
        else:
            argb |= int(alpha.symbol[0]) << 24
        size_of = back = None
        total_end = pixels + len(at)
        if group.copies and (c := np.flatnonzero(group.copy[g])).size:
            size_of = np.ones(len(at), dtype=np.int64)
            back = np.zeros(len(at), dtype=np.int64)
            s, u = sym[c] - 256, green.length[g[c]]
            size_of[c], x = _values(s, w[c] >> u)
            u = u + x
            k = (w[c] >> u) & d_mask
            far, _ = _values(dist.symbol[k], w[c] >> (u + dist.length[k]))
            back[c] = np.where(far <= len(NEAR), _near_offsets(width)[np.minimum(far, len(NEAR)) - 1], far - len(NEAR))
            total = np.cumsum(size_of) + pixels
            total_end = int(total[-1])
        keep = len(at)
        if total_end >= n:
            if size_of is None:
                keep = n - pixels
            else:
                keep = int(np.searchsorted(total, n)) + 1
                if total[keep - 1] != n:
                    raise Broken("a back-reference outside the image")
            total_end = n
        got.append((sym[:keep], np.where(lit, argb, 0)[:keep], None if size_of is None else size_of[:keep], None if back is None else back[:keep]))
        pixels = total_end
        p = 8 * a + q if keep == len(at) else 8 * a + chain[keep]
    if p > r.end:
        raise Broken("the data end too soon")
    r.at = p
    sym = np.concatenate([x[0] for x in got]) if len(got) > 1 else got[0][0]
    argb = (np.concatenate([x[1] for x in got]) if len(got) > 1 else got[0][1]).astype(np.uint32)
    if all(x[2] is None for x in got):
        return _fill(sym, argb, np.zeros(1 << cache_bits, dtype=np.uint32), cache_bits) if cache_bits else argb
    size_of = np.concatenate([np.ones(len(x[0]), np.int64) if x[2] is None else x[2] for x in got])
    back = np.concatenate([np.zeros(len(x[0]), np.int64) if x[3] is None else x[3] for x in got])
    return _resolve(sym, argb, size_of, back, n, cache_bits)


def _values(symbol: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths or distances from their symbols and the bits after them; the extra bits used."""
    extra = np.where(symbol < 4, 0, (symbol - 2) >> 1)
    return np.where(symbol < 4, symbol + 1, ((2 + (symbol & 1)) << extra) + (bits & ((1 << extra) - 1)) + 1), extra


def _slots(argb: np.ndarray, cache_bits: int) -> np.ndarray:
    return ((argb * HASH) >> np.uint32(32 - cache_bits)).astype(np.uint16)


def _fill(sym: np.ndarray, argb: np.ndarray, cache: np.ndarray, cache_bits: int) -> np.ndarray:
    """Pixels of a run of literals and cache hits; ``cache`` is brought up to date.

    A hit shows the last literal before it in its slot, for hits leave their slot as it was.
    """
    hit = sym >= 256
    if not hit.any():
        cache[_slots(argb, cache_bits)] = argb
        return argb
    slot = _slots(argb, cache_bits)
    slot[hit] = sym[hit] - 256 - LENGTHS
    order = np.argsort(slot, kind="stable")
    s, at = slot[order], np.arange(len(order))
    last = np.maximum.accumulate(np.where(hit[order], -1, at))
    known = (last >= 0) & (s[np.maximum(last, 0)] == s)
    out = np.empty(len(order), dtype=np.uint32)
    out[order] = np.where(known, argb[order][np.maximum(last, 0)], cache[s])
    cache[slot[~hit]] = argb[~hit]
    return out


def _resolve(sym, argb, size_of, back, n: int, cache_bits: int) -> np.ndarray:
    cache = np.zeros(1 << cache_bits, dtype=np.uint32) if cache_bits else None
    copies = np.flatnonzero(back)
    out, done, a = np.empty(n, dtype=np.uint32), 0, 0
    for c in [*copies.tolist(), len(sym)]:
        if c > a:
            out[done : done + c - a] = _fill(sym[a:c], argb[a:c], cache, cache_bits) if cache_bits else argb[a:c]
            done += c - a
        if c < len(sym):
            length, far = int(size_of[c]), int(back[c])
            if far > done:
                raise Broken("a back-reference outside the image")
            _copy(out, done, length, far)
            if cache_bits:
                copied = out[done : done + length]
                cache[_slots(copied, cache_bits)] = copied
            done += length
        a = c + 1
    return out


def _read_image(r: Reader, width: int, height: int, main: bool = False) -> np.ndarray:
    cache_bits = r.read(4) if r.read(1) else 0
    if cache_bits > 11:
        raise Broken("a colour cache of more than 11 bits")
    n, size = width * height, (1 << cache_bits) if cache_bits else 0
    if main and r.read(1):
        tile = r.read(3) + 2
        across = (width + (1 << tile) - 1) >> tile
        meta = (_read_image(r, across, (height + (1 << tile) - 1) >> tile) >> np.uint32(8)) & np.uint32(0xFFFF)
        meta = meta.astype(np.int64).tolist()
        groups = [r.group(size) for _ in range(max(meta) + 1)]
        return _read_plain(r, groups, lambda i: meta[(i // width >> tile) * across + (i % width >> tile)], n, width, cache_bits)
    group = r.group(size)
    # A token must lie within the 56 bits of a window; lengths and distances have up to 10 and 18 extra bits.
    if sum(c.bits for c in group[:4]) > 56 or group[0].bits + 10 + group[4].bits + 18 > 56:
        return _read_plain(r, [group], lambda i: 0, n, width, cache_bits)
    return _read_fast(r, group, n, width, cache_bits)


# ---------------------------------------------------------------- transforms


def _bgra(pixels: np.ndarray) -> np.ndarray:
    return pixels.view(np.uint8).reshape(*pixels.shape, 4)


def _mean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.int16) + b) >> 1).astype(np.uint8)


def _predict(mode: int, left, top, right, corner) -> np.ndarray:
    """Prediction of pixels (… x 4 bytes) from their left, top, top-right and top-left neighbours."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return _mean(_mean(left, right), top)
    if mode == 6:
        return _mean(left, corner)
    if mode == 7:
        return _mean(left, top)
    if mode == 8:
        return _mean(corner, top)
    if mode == 9:
        return _mean(top, right)
    if mode == 10:
        return _mean(_mean(left, corner), _mean(top, right))
    if mode == 11:
        a, b, c = left.astype(np.int16), top.astype(np.int16), corner.astype(np.int16)
        near_left = np.abs(b - c).sum(axis=-1) < np.abs(a - c).sum(axis=-1)
        return np.where(near_left[..., None], left, top)
    if mode == 12:
        return np.clip(left.astype(np.int16) + top - corner, 0, 255).astype(np.uint8)
    if mode == 13:
        a = _mean(left, top).astype(np.int16)
        return np.clip(a + np.trunc((a - corner) / 2).astype(np.int16), 0, 255).astype(np.uint8)
    out = np.zeros(left.shape, np.uint8)
    out[..., 3] = 255
    return out


def _from_above(mode: int) -> bool:
    """Whether a prediction needs no pixel of its own row."""
    return mode in (0, 2, 3, 4, 8, 9, 14, 15)


def undo_predictor(pixels: np.ndarray, modes: np.ndarray, tile: int) -> np.ndarray:
    """Pixels from residuals; ``modes`` has the mode of each tile."""
    out = _bgra(pixels.copy())
    height, width = pixels.shape
    out[0, 0] += np.array([0, 0, 0, 255], np.uint8)
    out[0] = np.cumsum(out[0], axis=0, dtype=np.uint8)
    for y in range(1, height):
        row, up = out[y], out[y - 1]
        row[0] += up[0]
        line = modes[y >> tile]
        x = 1
        while x < width:
            mode, end = int(line[x >> tile]), min(width, ((x >> tile) + 1) << tile)
            while end < width and int(line[end >> tile]) == mode:
                end = min(width, end + (1 << tile))
            if _from_above(mode):
                right = up[x + 1 : end + 1] if end < width else np.concatenate([up[x + 1 : end], row[:1]])
                row[x:end] += _predict(mode, up[x:end], up[x:end], right, up[x - 1 : end - 1])
            elif mode == 1:
                row[x - 1 : end] = np.cumsum(row[x - 1 : end], axis=0, dtype=np.uint8)
            else:
                for i in range(x, end):
                    row[i] += _predict(mode, row[i - 1], up[i], up[i + 1] if i + 1 < width else row[0], up[i - 1])
            x = end
    return out.reshape(height, -1).view(np.uint32)


def do_predictor(pixels: np.ndarray, modes: np.ndarray, tile: int) -> np.ndarray:
    """Residuals of pixels under the mode of each tile."""
    height, width = pixels.shape
    p = _bgra(np.ascontiguousarray(pixels))
    left, top = np.zeros_like(p), np.zeros_like(p)
    left[:, 1:], top[1:] = p[:, :-1], p[:-1]
    right, corner = np.zeros_like(p), np.zeros_like(p)
    right[1:, :-1], right[1:, -1] = p[:-1, 1:], p[1:, 0]
    corner[1:, 1:] = p[:-1, :-1]
    which = modes[np.arange(height)[:, None] >> tile, np.arange(width)[None, :] >> tile]
    which = which.copy()
    which[0], which[:, 0], which[0, 0] = 1, 2, 0
    guess = np.zeros_like(p)
    for mode in np.unique(which).tolist():
        at = which == mode
        guess[at] = _predict(mode, left[at], top[at], right[at], corner[at])
    return (p - guess).reshape(height, -1).view(np.uint32)


def _signed(x) -> np.ndarray:
    return x.astype(np.uint8).view(np.int8).astype(np.int32)


def _cross_factors(elements: np.ndarray, tile: int, shape):
    e = elements[np.arange(shape[0])[:, None] >> tile, np.arange(shape[1])[None, :] >> tile]
    return _signed(np.ascontiguousarray(e & 255)), _signed(np.ascontiguousarray(e >> 8 & 255)), _signed(np.ascontiguousarray(e >> 16 & 255))


def cross_colour(pixels: np.ndarray, elements: np.ndarray, tile: int, undo: bool) -> np.ndarray:
    """The cross-colour transform or its inverse; an element holds green-to-red, green-to-blue, red-to-blue from the low byte up."""
    g2r, g2b, r2b = _cross_factors(elements, tile, pixels.shape)
    out = _bgra(pixels.copy())
    green = _signed(np.ascontiguousarray(out[..., 1]))
    red = out[..., 2].astype(np.int32)
    shift = (g2r * green) >> 5
    new_red = (red + shift if undo else red - shift) & 255
    true_red = _signed(new_red if undo else red)
    shift = ((g2b * green) >> 5) + ((r2b * true_red) >> 5)
    blue = out[..., 0].astype(np.int32)
    out[..., 2] = new_red
    out[..., 0] = (blue + shift if undo else blue - shift) & 255
    return out.reshape(pixels.shape[0], -1).view(np.uint32)


def shift_green(pixels: np.ndarray, undo: bool) -> np.ndarray:
    out = _bgra(pixels.copy())
    green = out[..., 1].copy()
    for c in (0, 2):
        out[..., c] = out[..., c] + green if undo else out[..., c] - green
    return out.reshape(pixels.shape[0], -1).view(np.uint32)


def _bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def undo_palette(pixels: np.ndarray, colours: np.ndarray, width: int) -> np.ndarray:
    bits = _bundle_bits(len(colours))
    index = (pixels >> np.uint32(8)) & np.uint32(255)
    if bits:
        each = 8 >> bits
        parts = [(index >> np.uint32(k * each)) & np.uint32((1 << each) - 1) for k in range(1 << bits)]
        index = np.stack(parts, axis=-1).reshape(pixels.shape[0], -1)[:, :width]
    table = np.zeros(256, dtype=np.uint32)
    table[: len(colours)] = colours
    return table[index]


def do_palette(pixels: np.ndarray, colours: np.ndarray) -> np.ndarray:
    index = np.searchsorted(colours, pixels).astype(np.uint32)
    bits = _bundle_bits(len(colours))
    if bits:
        each, per = 8 >> bits, 1 << bits
        wide = -(-pixels.shape[1] // per) * per
        padded = np.zeros((pixels.shape[0], wide), dtype=np.uint32)
        padded[:, : pixels.shape[1]] = index
        index = (padded.reshape(pixels.shape[0], -1, per) << np.arange(0, 8, each, dtype=np.uint32)).sum(axis=-1).astype(np.uint32)
    return index << np.uint32(8) | BLACK


# ---------------------------------------------------------------- decoder


def decode(file: bytes) -> np.ndarray:
    """Pixels (height x width, ARGB) of a lossless WebP file."""
    if file[:4] != b"RIFF" or file[8:16] != b"WEBPVP8L" or len(file) < 25:
        raise Broken("not a lossless WebP file")
    (size,) = struct.unpack("<I", file[16:20])
    r = Reader(file[20 : 20 + size])
    if r.read(8) != 0x2F:
        raise Broken("wrong signature")
    width, height = r.read(14) + 1, r.read(14) + 1
    r.read(1)
    if r.read(3):
        raise Broken("unknown version")
    undo, seen, wide = [], set(), width
    while r.read(1):
        kind = r.read(2)
        if kind in seen:
            raise Broken("a transform twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS):
            tile = r.read(3) + 2
            shape = (height + (1 << tile) - 1) >> tile, (wide + (1 << tile) - 1) >> tile
            side = _read_image(r, shape[1], shape[0]).reshape(shape)
            if kind == PREDICTOR:
                undo.append(lambda x, m=((side >> np.uint32(8)) & np.uint32(15)).astype(np.int64), t=tile: undo_predictor(x, m, t))
            else:
                undo.append(lambda x, e=side, t=tile: cross_colour(x, e, t, True))
        elif kind == GREEN:
            undo.append(lambda x: shift_green(x, True))
        else:
            n = r.read(8) + 1
            colours = np.cumsum(_bgra(_read_image(r, n, 1)), axis=0, dtype=np.uint8).reshape(-1).view(np.uint32)
            undo.append(lambda x, c=colours, w=wide: undo_palette(x, c, w))
            wide = (wide + (1 << _bundle_bits(n)) - 1) >> _bundle_bits(n)
    pixels = _read_image(r, wide, height, main=True).reshape(height, wide)
    for f in reversed(undo):
        pixels = f(pixels)
    return pixels


# ---------------------------------------------------------------- encoder


class Writer:
    """Bit fields, lowest bit first, kept as arrays of values and widths."""

    def __init__(self):
        self.values, self.widths, self.few, self.few_widths = [], [], [], []

    def put(self, value: int, width: int) -> None:
        if width:
            self.few.append(value)
            self.few_widths.append(width)

    def many(self, values: np.ndarray, widths: np.ndarray) -> None:
        self.flush()
        self.values.append(values)
        self.widths.append(widths)

    def flush(self) -> None:
        if self.few:
            self.values.append(np.array(self.few, np.uint64))
            self.widths.append(np.array(self.few_widths, np.int64))
            self.few, self.few_widths = [], []

    def bytes(self) -> bytes:
        self.flush()
        values, widths = np.concatenate(self.values).astype(np.uint64), np.concatenate(self.widths)
        live = widths > 0
        if not live.all():
            values, widths = values[live], widths[live]
        end = np.cumsum(widths)
        at = end - widths
        word, off = at >> 6, (at & 63).astype(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out = np.zeros(int(end[-1] >> 6) + 2, dtype=np.uint64)
        out[word[first]] = np.bitwise_or.reduceat(values << off, first)
        over = np.flatnonzero((at & 63) + widths > 64)
        out[word[over] + 1] |= values[over] >> (np.uint64(64) - off[over])
        return out.tobytes()[: int(end[-1] + 7) // 8]


def _put_code(w: Writer, lens: np.ndarray) -> None:
    """The lengths of one prefix code."""
    used = np.flatnonzero(lens)
    if len(used) <= 2 and (len(used) == 0 or used[-1] < 256):
        used = used.tolist() or [0]
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        w.put(int(used[0] > 1), 1)
        w.put(used[0], 8 if used[0] > 1 else 1)
        if len(used) == 2:
            w.put(used[1], 8)
        return
    tokens, i, n, all_lens = [], 0, int(used[-1]) + 1, lens.tolist()
    while i < n:
        j = i
        while j < n and all_lens[j] == all_lens[i]:
            j += 1
        run, x = j - i, all_lens[i]
        if x:
            tokens.append((x, 0, 0))
            run -= 1
        while run:
            if x == 0 and run >= 11:
                k = min(run, 138)
                tokens.append((18, k - 11, 7))
            elif x == 0 and run >= 3:
                k = min(run, 10)
                tokens.append((17, k - 3, 3))
            elif x and run >= 3:
                k = min(run, 6)
                tokens.append((16, k - 3, 2))
            else:
                k = 1
                tokens.append((x, 0, 0))
            run -= k
        i = j
    own = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    bits = codes(own)
    alone = np.count_nonzero(own) == 1
    last = max(k for k in range(19) if own[CODE_LENGTH_ORDER[k]])
    w.put(0, 1)
    w.put(max(last + 1, 4) - 4, 4)
    for k in CODE_LENGTH_ORDER[: max(last + 1, 4)]:
        w.put(int(own[k]), 3)
    count = len(tokens)
    if n == len(lens):
        w.put(0, 1)
    else:
        w.put(1, 1)
        width = max(2, 2 * -(-max(count - 2, 1).bit_length() // 2))
        w.put((width - 2) // 2, 3)
        w.put(count - 2, width)
    for s, extra, width in tokens:
        if not alone:
            w.put(int(bits[s]), int(own[s]))
        w.put(extra, width)


def _split(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, extra bits and their number of lengths or distances (1 and more)."""
    v = value - 1
    high = np.where(v < 4, 1, np.int64(np.log2(np.maximum(v, 1) + 0.5)))
    extra = np.where(v < 4, 0, high - 1)
    return np.where(v < 4, v, 2 * high + ((v >> np.maximum(high - 1, 0)) & 1)), v & ((1 << extra) - 1), extra


def find_copies(pixels: np.ndarray, least: int = MATCH, longest: int = 4096, reach: int = (1 << 20) - 121) -> list[tuple[int, int, int]]:
    """(position, length, distance) of back-references that do not overlap, greedily."""
    h = _text.window_hashes(pixels.astype(np.uint64), least)
    ordered = np.sort(h)
    if not (ordered[1:] == ordered[:-1]).any():
        return []
    order = np.argsort(h, kind="stable")
    prev = np.full(len(h), -1, dtype=np.int64)
    same = h[order][1:] == h[order][:-1]
    prev[order[1:][same]] = order[:-1][same]
    spots = np.flatnonzero(prev >= 0)
    out, done, k, n = [], 0, 0, len(pixels)
    while k < len(spots):
        i = int(spots[k])
        j = int(prev[i])
        if i < done or i - j > reach:
            k = int(np.searchsorted(spots, done)) if i < done else k + 1
            continue
        length, step = 0, 256
        while i + length < n:
            m = min(step, n - i - length)
            differ = pixels[i + length : i + length + m] != pixels[j + length : j + length + m]
            if differ.any():
                length += int(differ.argmax())
                break
            length, step = length + m, step * 2
        if length < least:  # equal hashes only
            k += 1
            continue
        for at in range(0, length, longest):
            out.append((i + at, min(longest, length - at), i - j))
        done, k = i + length, k + 1
    return out


@lru_cache(maxsize=64)
def _near_codes(width: int) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, d in enumerate(_near_offsets(width).tolist()):
        out.setdefault(d, k + 1)
    return out


@lru_cache(maxsize=None)
def _shared_lengths(cache_bits: int) -> tuple[np.ndarray, ...]:
    """Code lengths for bytes of text, by a rule: white space, small letters, capitals, digits and signs, lead and trail bytes."""
    byte = np.ones(256, dtype=np.int64)
    byte[32:127] = 12
    byte[48:58] = 20
    byte[65:91] = 24
    byte[97:123] = 200
    byte[[97, 101, 105, 110, 111, 114, 115, 116]] = 500
    byte[32], byte[10], byte[44], byte[46] = 1200, 40, 60, 60
    byte[0xC2:0xF0] = 4
    byte[0xC3], byte[0x80:0xC0] = 80, 6
    green = np.concatenate([byte, np.full(LENGTHS, 8), np.full((1 << cache_bits) if cache_bits else 0, max(1, 4000 >> cache_bits))])
    own = code_lengths(byte, MAX_CODE)
    alpha = np.zeros(256, dtype=np.int64)
    alpha[255] = 1
    return code_lengths(green, MAX_CODE), own, own, alpha, code_lengths(np.ones(DISTANCES, np.int64), MAX_CODE)


@lru_cache(maxsize=None)
def _shared_codes(cache_bits: int):
    """The shared lengths' codes and their header, ready to write."""
    lens = _shared_lengths(cache_bits)
    w = Writer()
    for x in lens:
        _put_code(w, x)
    w.flush()
    return _tables([lens]), np.concatenate(w.values), np.concatenate(w.widths)


def _tables(lens: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """Codes and lengths of the five alphabets, a row a group; a lone symbol has no bits."""
    out = []
    for k in range(5):
        rows = [np.where(np.count_nonzero(x[k]) > 1, x[k], 0) for x in lens]
        out.append((np.stack([codes(x[k]) & ((1 << r) - 1) for x, r in zip(lens, rows, strict=True)]).astype(np.uint64), np.stack(rows)))
    return out


def _put_image(w: Writer, pixels: np.ndarray, width: int, cache_bits: int = 0, main: bool = False, groups: tuple[int, np.ndarray] | None = None, match: int | None = MATCH, shared: bool = False) -> None:
    """An entropy-coded image. ``groups``: (tile bits, group of each tile), for the main image only."""
    n = len(pixels)
    found = find_copies(pixels, match) if match and n > match else []
    plain = np.ones(n, dtype=bool)
    for i, length, _ in found:
        plain[i : i + length] = False
    at = np.flatnonzero(plain)
    sym = (pixels[at] >> np.uint32(8) & np.uint32(255)).astype(np.int64)
    if cache_bits:
        slot = _slots(pixels, cache_bits)
        order = np.argsort(slot, kind="stable")
        s, v = slot[order], pixels[order]
        hit = np.zeros(n, dtype=bool)
        hit[order[1:]] = (s[1:] == s[:-1]) & (v[1:] == v[:-1])
        sym = np.where(hit[at], 256 + LENGTHS + slot[at].astype(np.int64), sym)
    red, blue, alpha = ((pixels[at] >> np.uint32(k) & np.uint32(255)).astype(np.int64) for k in (16, 0, 24))
    lit = sym < 256
    group = np.zeros(n, dtype=np.int64)
    if groups:
        tile, of = groups
        y, x = np.divmod(np.arange(n), width)
        group = of[y >> tile, x >> tile].astype(np.int64)
    group_n, size = int(group.max()) + 1 if groups else 1, 256 + LENGTHS + ((1 << cache_bits) if cache_bits else 0)
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(int(groups is not None), 1)
        if groups:
            w.put(groups[0] - 2, 3)
            of = groups[1].astype(np.uint32)
            _put_image(w, ((of & np.uint32(255)) << np.uint32(8) | (of >> np.uint32(8)) << np.uint32(16) | BLACK).ravel(), of.shape[1], match=None)
    if found:
        c_at, c_len, c_far = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True))
        near = _near_codes(width)
        c_code = np.array([near.get(d, d + len(NEAR)) for d in c_far.tolist()], dtype=np.int64)
        l_sym, l_bits, l_extra = _split(c_len)
        d_sym, d_bits, d_extra = _split(c_code)
    if shared and group_n == 1:
        tables, head, head_widths = _shared_codes(cache_bits)
        w.many(head, head_widths)
    else:
        lens = []
        for g in range(group_n):
            mine = group[at] == g
            counts = [np.bincount(sym[mine], minlength=size)] + [np.bincount(x[mine & lit], minlength=256) for x in (red, blue, alpha)] + [np.zeros(DISTANCES, np.int64)]
            if found:
                own = group[c_at] == g
                counts[0] += np.bincount(256 + l_sym[own], minlength=size)
                counts[4] += np.bincount(d_sym[own], minlength=DISTANCES)
            lens.append([code_lengths(c, MAX_CODE) for c in counts])
            for x in lens[-1]:
                _put_code(w, x)
        tables = _tables(lens)
    (gc, gl), (rc, rl), (bc, bl), (ac, al), (dc, dl) = tables
    if group_n == 1:
        value, used = gc[0].take(sym), gl[0].take(sym)
        for c, length, x in ((rc, rl, red), (bc, bl, blue), (ac, al, alpha)):
            if length.any():
                value = value | np.where(lit, c[0].take(x) << used.astype(np.uint64), np.uint64(0))
                used = used + np.where(lit, length[0].take(x), 0)
    else:
        g = group[at]
        value, used = gc[g, sym], gl[g, sym]
        for c, length, x in ((rc, rl, red), (bc, bl, blue), (ac, al, alpha)):
            value = value | np.where(lit, c[g, x] << used.astype(np.uint64), np.uint64(0))
            used = used + np.where(lit, length[g, x], 0)
    if found:
        g = group[c_at]
        cv, cu = gc[g, 256 + l_sym], gl[g, 256 + l_sym]
        for v, m in ((l_bits.astype(np.uint64), l_extra), (dc[g, d_sym], dl[g, d_sym]), (d_bits.astype(np.uint64), d_extra)):
            cv = cv | v << cu.astype(np.uint64)
            cu = cu + m
        order = np.argsort(np.concatenate([at, c_at]), kind="stable")
        value, used = np.concatenate([value, cv])[order], np.concatenate([used, cu])[order]
    w.many(value, used)


def _entropy(pixels: np.ndarray) -> float:
    """Bits of the pixels at the entropy of their bytes by channel."""
    b = _bgra(np.ascontiguousarray(pixels)).reshape(-1, 4) + np.arange(0, 1024, 256)
    c = np.bincount(b.ravel(), minlength=1024)
    c = c[c > 0]
    return 4 * pixels.size * float(np.log2(max(pixels.size, 1))) - float((c * np.log2(c)).sum())


def encode(pixels: np.ndarray, transforms: list | None = None, cache_bits: int | None = None, groups=None, match: int | None = MATCH, shared: bool | None = None) -> bytes:
    """A lossless WebP file of ARGB pixels (height x width).

    ``transforms``: None to choose, or a list of ("green",), ("palette",), ("predictor", tile, modes), ("cross", tile, elements).
    """
    height, width = pixels.shape
    n = height * width
    w = Writer()
    for value, bits in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (int(bool((pixels < BLACK).any())), 1), (0, 3)):
        w.put(value, bits)
    image = np.ascontiguousarray(pixels, dtype=np.uint32)
    if transforms is None:
        transforms = []
        colours = len(np.unique(image.ravel()[:512]))
        if n > 512 and colours <= 256:
            colours = len(np.unique(image))
        if colours <= min(256, n // 4):
            transforms = [("palette",)]
        elif n >= 64:
            some = np.ascontiguousarray(image[:: -(-height // 8)])  # at most 8 rows, spread over the image
            flat = np.ones((-(-height // 512), -(-width // 512)), dtype=np.int64)
            left = (_bgra(some)[:, 1:] - _bgra(some)[:, :-1]).reshape(-1).view(np.uint32)
            options = [(_entropy(some), 0, []), (_entropy(shift_green(some, False)), 1, [("green",)]), (_entropy(left), 2, [("predictor", 9, flat)])]
            transforms = min(options)[2]
    wide, index = width, False
    for kind, *args in transforms:
        w.put(1, 1)
        if kind == "palette":
            index = True
            colours = np.unique(image)
            w.put(PALETTE, 2)
            w.put(len(colours) - 1, 8)
            steps = _bgra(colours.copy())
            steps[1:] = steps[1:] - _bgra(colours)[:-1]
            _put_image(w, steps.reshape(-1).view(np.uint32), len(colours), match=None)
            image = do_palette(image, colours)
            wide = image.shape[1]
        elif kind == "green":
            w.put(GREEN, 2)
            image = shift_green(image, False)
        else:
            tile, side = args
            w.put(PREDICTOR if kind == "predictor" else CROSS, 2)
            w.put(tile - 2, 3)
            cells = (side.astype(np.uint32) << np.uint32(8) if kind == "predictor" else side.astype(np.uint32)) | BLACK
            _put_image(w, np.ascontiguousarray(cells).ravel(), side.shape[1], match=None)
            image = do_predictor(image, side, tile) if kind == "predictor" else cross_colour(image, side, tile, False)
    w.put(0, 1)
    if cache_bits is None:
        cache_bits = 0 if index else 8 if n <= 1 << 12 else 10
    if shared is None:
        shared = not index and n <= SMALL and not transforms and bool((pixels >= BLACK).all())
    _put_image(w, np.ascontiguousarray(image).ravel(), wide, cache_bits, True, groups, match, shared)
    data = w.bytes()
    body = b"VP8L" + struct.pack("<I", len(data)) + data + bytes(len(data) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body
