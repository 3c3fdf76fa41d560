"""Lossless WebP (the VP8L bitstream of RFC 9649): reading, and writing enough to store samples.

decode() handles prefix codes (simple and normal, one group or several), back-references, the colour cache and the
predictor, cross-colour, subtract-green and palette transforms. Streams of literals and copies whose red, blue and alpha
codes have one symbol each, as encode_smallest() mostly writes them, are read for all bit positions at once.
"""

from __future__ import annotations

import functools
import math
import operator
import struct
from collections import Counter
from collections.abc import Generator, Iterable

import numpy as np

PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE = range(4)
MAX_SIDE = 1 << 14
MAX_LENGTH = 15

# Fixed values of the format: the order of code length codes, and the (x, y) steps of short distance codes.
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
_PLACE = [CODE_ORDER.index(s) for s in range(19)]
_HASH = 0x1E35A7BD
BLACK = 0xFF000000
MAX_COPY = 4096
BLOCK = 1920  # bytes whose bit positions are looked at together
FARTHEST = (1 << 20) - len(NEAR)

# By prefix code of a length or distance: how many extra bits it has, and the least value.
_EXTRA = np.array([max(0, (k - 2) >> 1) for k in range(40)], np.int32)
_LEAST = np.array([k + 1 if k < 4 else ((2 + (k & 1)) << ((k - 2) >> 1)) + 1 for k in range(40)], np.int64)
_KIND = np.repeat(np.arange(40, dtype=np.uint8), 1 << _EXTRA)  # of each value from 1
_ONES = (1 << np.arange(20)) - 1
_SHIFTS = np.tile(np.arange(8), BLOCK + 8)


class BadImage(ValueError):
    """The bytes are no lossless WebP image."""


def in_step(runs: Iterable[Generator]) -> list:
    """What generators return, or the BadImage that one raises, run by turns from yield to yield.

    One part of the work on picture after picture runs faster than all parts on one picture and then on the next.
    """
    live = list(enumerate(runs))
    found = [None] * len(live)
    while live:
        left = []
        for at, run in live:
            try:
                next(run)
                left.append((at, run))
            except StopIteration as e:
                found[at] = e.value
            except BadImage as e:
                found[at] = e
        live = left
    return found


def _at_once(run: Generator):
    try:
        while True:
            next(run)
    except StopIteration as e:
        return e.value


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.pos, self.end = data, 0, 8 * len(data)

    def read(self, n: int) -> int:
        at = self.pos
        self.pos = at + n
        if self.pos > self.end:
            raise BadImage("the bitstream ends early")
        return (int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7)) & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        at = self.pos
        return (int.from_bytes(self.data[at >> 3 : (at >> 3) + 3], "little") >> (at & 7)) & ((1 << n) - 1)


_turned: dict[int, np.ndarray] = {}


def _reversed_bits(width: int) -> np.ndarray:
    """All numbers of width bits with their bits in the other order."""
    if width not in _turned:
        r = np.zeros(1, np.int32)
        for _ in range(width):
            r = np.concatenate([2 * r, 2 * r + 1])
        _turned[width] = r
    return _turned[width]


def canonical(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """symbol: (bits as they are stored, length)."""
    return _canonical([(n, s) for s, n in enumerate(lengths) if n])


def _canonical(sizes: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    codes, code, before = {}, 0, 0
    for n, s in sorted(sizes):
        code <<= n - before
        codes[s] = (_turned_bits(code, n), n)
        code, before = code + 1, n
    return codes


def _small_table(lengths: list[int]) -> tuple[int, list[tuple[int, int]]]:
    """Of a code of code lengths: its width, and symbols and sizes by the next bits."""
    used = [(n, s) for s, n in enumerate(lengths) if n]
    if not used:
        raise BadImage("a prefix code is empty")
    if len(used) == 1:
        return 0, [(used[0][1], 0)]
    width = max(used)[0]
    if sum([1 << (width - n) for n, _ in used]) != 1 << width:
        raise BadImage("a prefix code is not complete")
    table = [(0, 0)] * (1 << width)
    for s, (code, n) in _canonical(used).items():
        table[code :: 1 << n] = [(s, n)] * (1 << (width - n))
    return width, table


class _Code:
    """A prefix code; symbols from `first` on are prefixes of lengths or distances, with extra bits behind them."""

    def __init__(self, lengths: bytes, only: int | None = None, first: int = 256):
        n = np.frombuffer(lengths, np.uint8)
        used = n.nonzero()[0] if only is None else np.array([only])
        if not len(used):
            raise BadImage("a prefix code is empty")
        self.only = int(used[0]) if len(used) == 1 else None
        self.width, self.by_size, self.first = 0, used, first
        if self.only is not None:
            self.sizes, self.spread = np.zeros(1, np.int64), np.ones(1, np.int64)
            return
        sizes = n.take(used)
        order = sizes.argsort(kind="stable")
        self.by_size, self.sizes = used.take(order), sizes.take(order).astype(np.int64)
        self.width = int(self.sizes[-1])
        if self.width > MAX_LENGTH:
            raise BadImage("a prefix code is too long")
        self.spread = 1 << (self.width - self.sizes)
        if self.spread.sum() != 1 << self.width:
            raise BadImage("a prefix code is not complete")

    @functools.cached_property
    def table(self) -> np.ndarray:
        """By the next `width` bits: the symbol, its length from bit 16 on, and from bit 24 on that length with the extra bits."""
        kind = self.by_size - self.first
        steps = self.sizes + _EXTRA.take(kind, mode="clip") * (kind >= 0)
        return (steps << 24 | self.sizes << 16 | self.by_size).repeat(self.spread).take(_reversed_bits(self.width))

    def read(self, bits: _Bits) -> int:
        if self.width == 0:
            return self.only
        found = int(self.table[bits.peek(self.width)])
        bits.pos += found >> 16 & 255
        if bits.pos > bits.end:
            raise BadImage("the bitstream ends early")
        return found & 0xFFFF


@functools.cache
def _lone(symbol: int, first: int) -> _Code:
    return _Code(b"", symbol, first)


def _read_code(bits: _Bits, size: int) -> _Code:
    first = 256 if size > 40 else 0
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1), *([bits.read(8)] if two else [])]
        if max(symbols) >= size:
            raise BadImage("a symbol is out of range")
        if len(set(symbols)) == 1:
            return _lone(symbols[0], first)
        return _Code(bytes([int(s in symbols) for s in range(max(symbols) + 1)]), None, first)
    lengths = bytearray(size)
    of_lengths = [0] * 19
    many = 4 + bits.read(4)
    coming = bits.read(3 * many)
    for i in range(many):
        of_lengths[CODE_ORDER[i]] = coming >> 3 * i & 7
    width, table = _small_table(of_lengths)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, before, pos = 0, 8, bits.pos
    start = pos >> 3
    coming = int.from_bytes(bits.data[start : start + 2 * size + 2], "little") >> (pos & 7)  # 14 bits a length at most
    mask = (1 << width) - 1
    while at < size and left:
        left -= 1
        n, used = table[coming & mask]
        coming >>= used
        pos += used
        if n < 16:
            if n:
                lengths[at] = before = n
            at += 1
        else:
            more = 2 if n == 16 else 3 if n == 17 else 7
            many = (11 if n == 18 else 3) + (coming & ((1 << more) - 1))
            coming >>= more
            pos += more
            if at + many > size:
                raise BadImage("a run of code lengths is too long")
            if n == 16:
                lengths[at : at + many] = bytes((before,)) * many
            at += many
    bits.pos = pos
    if pos > bits.end:
        raise BadImage("the bitstream ends early")
    return _Code(lengths, None, first)


def _long(bits: _Bits, code: int) -> int:
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + bits.read(extra) + 1


def _walk(to: np.ndarray, at: int) -> np.ndarray:
    """Positions from `at` on, as `to` leads from each to the next, by eight at a time; its last entry, the end, leads to itself."""
    end = len(to) - 1
    to2 = to.take(to)
    to4 = to2.take(to2)
    jump, starts = memoryview(to4.take(to4)), []
    while at < end:
        starts.append(at)
        at = jump[at]
    p = np.empty((len(starts), 8), np.int64)
    p[:, 0] = starts
    p[:, 4] = to4.take(p[:, 0])
    p[:, 2::4] = to2.take(p[:, 0::4])
    p[:, 1::2] = to.take(p[:, 0::2])
    p = p.reshape(-1)
    return p[: p.searchsorted(end)]


_steps_back: dict[int, np.ndarray] = {}


def _near(width: int) -> np.ndarray:
    """By short distance code, from 1: the pixels to go back."""
    if width not in _steps_back:
        _steps_back[width] = np.array([0, *(max(1, x + y * width) for x, y in NEAR)])
    return _steps_back[width]


@functools.cache
def _short(width: int) -> np.ndarray:
    """By distance: its short code, or 0; the last entry stands for all that are farther."""
    near = _near(width)
    short = np.zeros(near.max() + 2, np.int64)
    short[near[:0:-1]] = np.arange(len(NEAR), 0, -1)
    return short


def _chain(bits: _Bits, code: _Code, far_code: _Code, n: int, width: int) -> Generator:
    """The next n green values where literals and copies are all there is: successors of all bit positions, and a walk."""
    if code.width == 0:
        return np.full(n, code.only, np.int32) if code.only < 256 else None
    first = bits.pos >> 3
    raw = bits.data[first : first + (n * (code.width + far_code.width + 28) + 7) // 8 + 1]
    words = np.ndarray(len(raw) + 9, "<u4", raw + bytes(12), strides=(1,)).astype(np.int64)
    coming = lambda at: words.take(at >> 3) >> (at & 7)
    table, far_table = code.table, far_code.table
    mask, far_mask = (1 << code.width) - 1, (1 << far_code.width) - 1
    some = code.by_size.max() >= 256
    parts, at = [], bits.pos & 7
    yield
    for start in range(0, len(raw), BLOCK):
        end = 8 * min(BLOCK, len(raw) - start)
        if at - 8 * start >= end:
            break
        ahead = words[start : start + (end >> 3) + 8].repeat(8)  # a distance begins 29 bits behind its token at most
        ahead >>= _SHIFTS[: len(ahead)]
        found = table.take(ahead[:end] & mask)
        step = found >> 24
        if some:
            c = (found & 256).astype(bool).nonzero()[0]
            half = step.take(c)
            step[c] = half + (far_table.take(ahead.take(c + half) & far_mask) >> 24)
        to = np.arange(end + 1)
        to[:end] += step
        np.minimum(to[-64:], end, out=to[-64:])  # a token has 58 bits at most
        p = _walk(to, at - 8 * start)
        parts.append((p + 8 * start, found.take(p), step.take(p)))
        at = int(parts[-1][0][-1] + parts[-1][2][-1])
    if not parts:
        raise BadImage("the bitstream ends early")
    yield
    p, seen, step = parts[0] if len(parts) == 1 else map(np.concatenate, zip(*parts, strict=True))
    out = seen & 0xFFFF
    c = (out >= 256).nonzero()[0]
    own = seen.take(c)
    sizes = own >> 16 & 255
    at = p.take(c) + sizes
    extra = (own >> 24) - sizes
    many = np.ones(len(p), np.int64)
    many[c] = _LEAST.take((own & 0xFFFF) - 256) + (coming(at) & _ONES.take(extra))
    after = np.cumsum(many)
    last = int(np.searchsorted(after, n))
    if last == len(p) or p[last] + step[last] + 8 * first > bits.end:
        raise BadImage("the bitstream ends early")
    bits.pos = int(p[last] + step[last]) + 8 * first
    p, out, many, after = p[: last + 1], out[: last + 1], many[: last + 1], after[: last + 1]
    c = c[: np.searchsorted(c, last, "right")]
    if not len(c):
        return out
    at = at[: len(c)] + extra[: len(c)]
    found = far_table.take(coming(at) & far_mask)
    sizes = found >> 16 & 255
    far = _LEAST.take(found & 0xFFFF) + (coming(at + sizes) & _ONES.take((found >> 24) - sizes))
    far = np.where(far > len(NEAR), far - len(NEAR), _near(width).take(np.minimum(far, len(NEAR))))
    if after[-1] != n or (far > (after - many)[c]).any():
        raise BadImage("a back-reference is out of range")
    yield
    back = np.zeros(len(p), np.int64)
    back[c] = far
    source = np.arange(n) - np.repeat(back, many)
    while True:
        older = source.take(source)
        source = older.take(older)
        if (source == older).all():
            break
    return np.repeat(out, many).take(source)


def _read_pixels(bits: _Bits, width: int, height: int, main: bool) -> Generator:
    """ARGB of one entropy-coded image."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise BadImage("the colour cache is too large")
    groups_of, shift, many = None, 0, 1
    if main and bits.read(1):
        shift = bits.read(3) + 2
        w = (width + (1 << shift) - 1) >> shift
        meta = _at_once(_read_pixels(bits, w, (height + (1 << shift) - 1) >> shift, False))
        groups_of = ((meta >> np.uint32(8)) & np.uint32(0xFFFF)).reshape(-1, w).astype(np.int64)
        many = int(groups_of.max()) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    groups = []
    for _ in range(many):
        groups.append([])
        for size in (280 + cache_size, 256, 256, 256, 40):
            groups[-1].append(_read_code(bits, size))
            if size in (256 + 24, 40):
                yield
    n = width * height
    if many == 1 and not cache_bits and all(c.width == 0 for c in groups[0][1:4]):
        at = bits.pos
        green = yield from _chain(bits, groups[0][0], groups[0][4], n, width)
        if green is not None:
            rest = (groups[0][1].only << 16) | groups[0][2].only | (groups[0][3].only << 24)
            return (green.astype(np.uint32) << np.uint32(8)) | np.uint32(rest)
        bits.pos = at
    out: list[int] = []
    cache = [0] * cache_size
    kept = 0

    def keep() -> None:
        nonlocal kept
        if cache_bits:
            for v in out[kept:]:
                cache[((_HASH * v) & 0xFFFFFFFF) >> (32 - cache_bits)] = v
        kept = len(out)

    while len(out) < n:
        at = len(out)
        codes = groups[groups_of[(at // width) >> shift, (at % width) >> shift]] if groups_of is not None else groups[0]
        s = codes[0].read(bits)
        if s < 256:
            red, blue, alpha = codes[1].read(bits), codes[2].read(bits), codes[3].read(bits)
            out.append(alpha << 24 | red << 16 | s << 8 | blue)
        elif s < 280:
            length = _long(bits, s - 256)
            far = _long(bits, codes[4].read(bits))
            if far > len(NEAR):
                far -= len(NEAR)
            else:
                x, y = NEAR[far - 1]
                far = max(1, x + y * width)
            if far > at or at + length > n:
                raise BadImage("a back-reference is out of range")
            while length:
                part = out[-far:][:length] if far > length else out[-far:]
                out += part[:length]
                length -= min(length, len(part))
        else:
            keep()
            out.append(cache[s - 280])
    return np.array(out, np.uint32)


def _split(p: int) -> tuple[int, int, int, int]:
    return p >> 24, (p >> 16) & 255, (p >> 8) & 255, p & 255


def _mean(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _clamp(v: int) -> int:
    return 0 if v < 0 else 255 if v > 255 else v


def _join(parts) -> int:
    a, r, g, b = parts
    return a << 24 | r << 16 | g << 8 | b


def predicted(mode: int, px: list[int], at: int, width: int) -> int:
    """The predictor's value for the pixel at `at`, from those before it."""
    if at < width:
        return px[at - 1] if at else BLACK
    top = px[at - width]
    if at % width == 0:
        return top
    left, corner = px[at - 1], px[at - width - 1]
    right = px[at - width + 1]
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
        by_left = sum(abs(t - c) for t, c in zip(_split(top), _split(corner), strict=True))
        by_top = sum(abs(x - c) for x, c in zip(_split(left), _split(corner), strict=True))
        return left if by_left < by_top else top
    if mode == 12:
        return _join(_clamp(x + t - c) for x, t, c in zip(_split(left), _split(top), _split(corner), strict=True))
    if mode == 13:
        half = ((m, c) for m, c in zip(_split(_mean(left, top)), _split(corner), strict=True))
        return _join(_clamp(m + int((m - c) / 2)) for m, c in half)
    return BLACK


def add_bytes(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00)) & 0xFF00FF00 | ((a & 0x00FF00FF) + (b & 0x00FF00FF)) & 0x00FF00FF


def _undo_predictor(px: np.ndarray, width: int, shift: int, modes: np.ndarray, across: int) -> np.ndarray:
    kinds = ((modes >> np.uint32(8)) & np.uint32(15)).tolist()
    rest, out = px.tolist(), []
    if set(kinds) <= {1}:  # rows of differences: sums along the first row and column, then along the rows
        parts = px.view(np.uint8).reshape(-1, width, 4).copy()
        parts[0, 0, 3:] += np.uint8(255)
        parts[:, 0] = np.cumsum(parts[:, 0], axis=0, dtype=np.uint8)
        return np.ascontiguousarray(np.cumsum(parts, axis=1, dtype=np.uint8)).view(np.uint32).reshape(-1)
    for at, v in enumerate(rest):
        mode = kinds[((at // width) >> shift) * across + ((at % width) >> shift)]
        out.append(0)
        # the pixel right above the last column is the first of this row
        out[at] = add_bytes(v, predicted(mode, out, at, width))
    return np.array(out, np.uint32)


def _undo_cross(px: np.ndarray, width: int, shift: int, parts: np.ndarray, across: int, sign: int = 1) -> np.ndarray:
    at = np.arange(len(px))
    e = parts[((at // width) >> shift) * across + ((at % width) >> shift)]
    part = lambda v, s: ((v >> np.uint32(s)) & np.uint32(255)).astype(np.uint8).view(np.int8).astype(np.int32)
    green = part(px, 8)
    old_red = part(px, 16)
    red = (old_red + sign * ((part(e, 0) * green) >> 5)) & 255
    with_red = (red if sign > 0 else old_red & 255).astype(np.uint8).view(np.int8).astype(np.int32)
    blue = (part(px, 0) + sign * (((part(e, 8) * green) >> 5) + ((part(e, 16) * with_red) >> 5))) & 255
    return (px & np.uint32(0xFF00FF00)) | (red.astype(np.uint32) << np.uint32(16)) | blue.astype(np.uint32)


def _undo_palette(px: np.ndarray, width: int, packed: int, shift: int, colours: np.ndarray) -> np.ndarray:
    index = ((px >> np.uint32(8)) & np.uint32(255)).reshape(-1, packed)
    if shift:
        size = 8 >> shift
        index = ((index[:, :, None] >> (np.arange(1 << shift, dtype=np.uint32) * np.uint32(size))) & np.uint32((1 << size) - 1)).reshape(len(index), -1)[:, :width]
    table = np.zeros(256, np.uint32)
    table[: len(colours)] = colours
    return table[index.reshape(-1)]


def _add_green(px: np.ndarray) -> np.ndarray:
    parts = px.copy().view(np.uint8)
    parts[0::4] += parts[1::4]
    parts[2::4] += parts[1::4]
    return parts.view(np.uint32)


def chunk_of(data: bytes) -> bytes:
    if len(data) < 20 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise BadImage("no WebP file")
    at = 12
    while at + 8 <= len(data):
        size = struct.unpack_from("<I", data, at + 4)[0]
        if data[at : at + 4] == b"VP8L":
            if at + 8 + size > len(data):
                raise BadImage("the file is cut off")
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise BadImage("no lossless image in the file")


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """width, height and the ARGB pixels, row by row, of a lossless WebP file."""
    return _at_once(decoding(data))


def decoding(data: bytes) -> Generator:
    """decode() for in_step()."""
    bits = _Bits(chunk_of(data))
    if bits.read(8) != 0x2F:
        raise BadImage("not VP8L")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise BadImage("unknown version")
    undo, seen, across_now = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise BadImage("a transform is repeated")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOR):
            shift = bits.read(3) + 2
            across = (across_now + (1 << shift) - 1) >> shift
            part = _at_once(_read_pixels(bits, across, (height + (1 << shift) - 1) >> shift, False))
            undo.append((_undo_predictor if kind == PREDICTOR else _undo_cross, (across_now, shift, part, across)))
        elif kind == SUBTRACT_GREEN:
            undo.append((_add_green, ()))
        else:
            size = bits.read(8) + 1
            steps = _at_once(_read_pixels(bits, size, 1, False))
            colours = np.ascontiguousarray(np.cumsum(steps.view(np.uint8).reshape(-1, 4), axis=0, dtype=np.uint8)).view(np.uint32).reshape(-1)
            shift = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            packed = (across_now + (1 << shift) - 1) >> shift
            undo.append((_undo_palette, (across_now, packed, shift, colours)))
            across_now = packed
    px = yield from _read_pixels(bits, across_now, height, True)
    for f, args in reversed(undo):
        px = f(px, *args)
    return width, height, px


# Writing


class _Out:
    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, v: int, n: int) -> None:
        self.value |= v << self.n
        self.n += n


def _code_sizes(counts: list[int], most: int = MAX_LENGTH) -> list[int]:
    """Lengths of a prefix code of at most `most` bits for symbols with these counts, all above 0; a lone symbol gets 1."""
    size = len(counts)
    if size <= 2:
        return [1] * size
    while True:
        # the two least weights are always the first ones left of the symbols, by weight, or of the nodes, as they were made
        order = sorted(range(size), key=counts.__getitem__)
        leaves = [counts[s] for s in order]
        above = sum(leaves) + 1
        leaves += (above, above)
        nodes = [above] * (size + 1)
        leaf_up, node_up, i, j = [], [], 0, 0
        for new in range(size - 1):
            a = leaves[i]
            if nodes[j] < a:
                a = nodes[j]
                j += 1
                node_up.append(new)
            else:
                i += 1
                leaf_up.append(new)
            b = leaves[i]
            if nodes[j] < b:
                b = nodes[j]
                j += 1
                node_up.append(new)
            else:
                i += 1
                leaf_up.append(new)
            nodes[new] = a + b
        depth = [1] * (size - 1)
        for node in range(size - 3, -1, -1):
            depth[node] = depth[node_up[node]] + 1
        if max(depth) <= most:
            lengths = [0] * size
            for s, up in zip(order, leaf_up, strict=True):
                lengths[s] = depth[up]
            return lengths
        counts = [(c + 1) // 2 for c in counts]


def code_lengths(counts: list[int]) -> list[int]:
    """Lengths of a prefix code of at most MAX_LENGTH bits, by symbol; a lone symbol gets 1."""
    used = [s for s, c in enumerate(counts) if c]
    lengths = [0] * len(counts)
    for s, n in zip(used, _code_sizes([counts[s] for s in used]), strict=True):
        lengths[s] = n
    return lengths


def _put_code(out: _Out, lengths: list[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    _put_sizes(out, used, [lengths[s] for s in used])


@functools.cache
def _zeros(gap: int) -> tuple[int, ...]:
    """A gap between used symbols: symbols of the code of lengths, and extra bits from the sixth bit on."""
    runs = []
    while gap:
        n = min(gap, 138)
        runs += [0] * n if n < 3 else [17 | (n - 3) << 5 if n < 11 else 18 | (n - 11) << 5]
        gap -= n
    return tuple(runs)


@functools.cache
def _turned_bits(code: int, n: int) -> int:
    return int(f"{code:0{n}b}"[::-1], 2)


@functools.cache
def _digits(code: int, n: int) -> str:
    return f"{code:0{n}b}"


@functools.cache
def _extra_digits(run: int) -> str:
    """The extra bits of a run of zeros, the lowest first."""
    return f"{run >> 5:0{3 if run & 31 == 17 else 7}b}"[::-1]


def _put_sizes(out: _Out, used: list[int], sizes: list[int]) -> None:
    """The code whose used symbols, in order, have these lengths."""
    if len(used) <= 2 and max(used, default=0) < 256:
        used = used or [0]
        out.put(1 | (len(used) - 1) << 1 | 1 << 2, 3)
        for s in used:
            out.put(s, 8)
        return
    runs, before = [], -1
    for s, size in zip(used, sizes, strict=True):
        if s - before > 1:
            runs += _zeros(s - before - 1)
        runs.append(size)
        before = s
    distinct, counts = Counter(runs), [0] * 19
    for run, n in distinct.items():
        counts[run & 31] += n
    kinds = [s for s in range(19) if counts[s]]
    own = _code_sizes([counts[s] for s in kinds], 7)
    many = max(4, 1 + max([_PLACE[s] for s in kinds]))
    value, at = (many - 4) << 1, 5 + 3 * many
    for s, n in zip(kinds, own, strict=True):
        value |= n << (5 + 3 * _PLACE[s])
    size = len(runs) - 2
    wide = max(0, size.bit_length() - 1) >> 1
    value |= (1 | wide << 1 | size << 4) << at
    at += 6 + 2 * wide
    digits, code, before = {kinds[0]: ""}, 0, 0  # in the order that they are stored in
    if len(own) > 1:
        for n, s in sorted(zip(own, kinds, strict=True)):
            code <<= n - before
            digits[s] = _digits(code, n)
            code, before = code + 1, n
    coded = {run: digits[run] if run < 16 else digits[run & 31] + _extra_digits(run) for run in distinct}
    body = "".join([coded[run] for run in runs])
    out.put(value | int(body[::-1] or "0", 2) << at, at + len(body))


def _wrapped(bits: bytes) -> bytes:
    pad = b"\0" * (len(bits) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(bits) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(bits)) + bits + pad


def _prefix(v: int) -> tuple[int, int, int]:
    """Prefix code, extra bits and their number of a length or distance from 1."""
    v -= 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    second = (v >> (high - 1)) & 1
    return 2 * high + second, v & ((1 << (high - 1)) - 1), high - 1


def _put_pixels(out: _Out, px: list[int], width: int, main: bool, cache_bits: int = 0, matches: bool = False, groups: int = 1) -> None:
    """groups: codes of their own for every fourth row of tiles, by turns."""
    tokens, cache, last, i = [], [None] * (1 << cache_bits), {}, 0
    group_of = lambda at: ((at // width) >> 2) % groups
    place = lambda v: ((_HASH * v) & 0xFFFFFFFF) >> (32 - cache_bits)
    while i < len(px):
        n, far = 0, 0
        if matches and (j := last.get(tuple(px[i : i + 3]))) is not None:
            while i - j <= FARTHEST and i + n < len(px) and n < MAX_COPY and px[j + n] == px[i + n]:
                n += 1
            far = i - j
        if n >= 3:
            near = next((k + 1 for k, (x, y) in enumerate(NEAR) if max(1, x + y * width) == far), far + len(NEAR))
            tokens.append((group_of(i), "copy", _prefix(n), _prefix(near)))
        elif cache_bits and cache[place(px[i])] == px[i]:
            tokens.append((group_of(i), "cache", place(px[i])))
            n = 1
        else:
            tokens.append((group_of(i), "pixel", px[i]))
            n = 1
        for v in range(i, i + n):
            last[tuple(px[v : v + 3])] = v
            if cache_bits:
                cache[place(px[v])] = px[v]
        i += n
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    counts = [[[0] * n for n in sizes] for _ in range(groups)]

    def symbols(t):
        if t[0] == "pixel":
            a, r, g, b = _split(t[1])
            return [(0, g, 0, 0), (1, r, 0, 0), (2, b, 0, 0), (3, a, 0, 0)]
        if t[0] == "cache":
            return [(0, 280 + t[1], 0, 0)]
        return [(0, 256 + t[1][0], *t[1][1:]), (4, t[2][0], *t[2][1:])]

    for g, *t in tokens:
        for k, s, _, _ in symbols(t):
            counts[g][k][s] += 1
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(int(groups > 1), 1)
    if groups > 1:
        out.put(0, 3)  # tiles of four by four pixels
        across, down = (width + 3) >> 2, (len(px) // width + 3) >> 2
        _put_pixels(out, [BLACK | (y % groups) << 8 for y in range(down) for _ in range(across)], across, False)
    lengths = [[code_lengths(c) if any(c) else [1, *c[1:]] for c in own] for own in counts]
    for own in lengths:
        for c in own:
            _put_code(out, c)
    codes = [[canonical(c) for c in own] for own in lengths]
    for g, *t in tokens:
        for k, s, extra, n in symbols(t):
            if len(codes[g][k]) > 1:
                out.put(*codes[g][k][s])
            out.put(extra, n)


def _put_palette(out: _Out, colours: list[int]) -> None:
    out.put(1 | PALETTE << 1 | (len(colours) - 1) << 3, 11)
    parts = np.array(colours, np.uint32).view(np.uint8).reshape(-1, 4)
    steps = np.diff(parts, axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8)
    _put_pixels(out, np.ascontiguousarray(steps).view(np.uint32).reshape(-1).tolist(), len(colours), False)


def _packed(index: np.ndarray, width: int, colours: int) -> tuple[np.ndarray, int]:
    """Indices of a palette, several to a pixel if it is small, and the width in such pixels."""
    shift = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    across = (width + (1 << shift) - 1) >> shift
    wide = np.zeros((len(index) // width, across << shift), np.uint32)
    wide[:, :width] = index.reshape(-1, width)
    places = np.arange(1 << shift, dtype=np.uint32) * np.uint32(8 >> shift)
    return (wide.reshape(len(wide), across, 1 << shift) << places).sum(axis=2).astype(np.uint32).reshape(-1), across


def _put_predictor(out: _Out, mode: int, width: int, height: int) -> None:
    """One mode for the whole picture, in tiles as large as they can be."""
    out.put(1 | PREDICTOR << 1 | 7 << 3, 6)
    out.put(*_one_mode(mode, (width + 511) >> 9, (height + 511) >> 9))


@functools.cache
def _one_mode(mode: int, across: int, down: int) -> tuple[int, int]:
    out = _Out()
    _put_pixels(out, [BLACK | mode << 8] * (across * down), across, False)
    return out.value, out.n


def encode(px: np.ndarray, width: int, mode: int | None = None, cross: tuple[int, int, int] | None = None, palette: bool = False, green: bool = False, cache_bits: int = 0, matches: bool = False, groups: int = 1) -> bytes:
    """A small writer for ARGB pixels that can use each feature that decode() reads; pixel by pixel, so not for bulk."""
    height = len(px) // width
    out = _Out()
    out.put(0x2F | (width - 1) << 8 | (height - 1) << 22, 36)
    out.put(1, 1)
    out.put(0, 3)
    across = width
    if palette:
        colours = sorted(set(px.tolist()))
        if len(colours) > 256:
            raise ValueError("more than 256 colours")
        _put_palette(out, colours)
        index, across = _packed(np.searchsorted(np.array(colours, np.uint32), px), width, len(colours))
        px = (index << np.uint32(8)) | np.uint32(BLACK)
    if mode is not None:
        _put_predictor(out, mode, across, height)
        v = px.tolist()
        minus = lambda a, b: _join((x - y) & 255 for x, y in zip(_split(a), _split(b), strict=True))
        px = np.array([minus(x, predicted(mode, v, i, across)) for i, x in enumerate(v)], np.uint32)
    if cross is not None:
        out.put(1 | CROSS_COLOR << 1 | 7 << 3, 6)
        w = (across + 511) >> 9
        e = np.full(w * ((height + 511) >> 9), BLACK | (cross[0] & 255) << 16 | (cross[1] & 255) << 8 | cross[2] & 255, np.uint32)
        _put_pixels(out, e.tolist(), w, False)
        px = _undo_cross(px, across, 9, e, w, -1)
    if green:
        out.put(1 | SUBTRACT_GREEN << 1, 3)
        g = (px >> np.uint32(8)) & np.uint32(255)
        px = (px & np.uint32(0xFF00FF00)) | ((((px >> np.uint32(16)) - g) & np.uint32(255)) << np.uint32(16)) | ((px - g) & np.uint32(255))
    out.put(0, 1)
    _put_pixels(out, px.tolist(), across, True, cache_bits, matches, groups)
    return _wrapped(out.value.to_bytes((out.n + 7) // 8, "little"))


# Grey pictures, in whole arrays. Red and blue are 0 behind subtract-green or a palette, so one value a pixel is left.


def _tokens(v: np.ndarray) -> tuple[np.ndarray, ...]:
    """Literals only: green symbols; and of the copies among them, none, the place, length and distance."""
    none = np.empty(0, np.int64)
    return v.astype(np.int64), none, none, none


def _repeats(v: np.ndarray) -> np.ndarray:
    """By place: where the three samples from there on came last, or -1."""
    key = np.ndarray(len(v) - 2, "<u4", v.tobytes() + bytes(1), strides=(1,)).astype(np.int64)
    key &= 0xFFFFFF
    key <<= 20
    key |= np.arange(len(key))
    key.sort()
    same = ((key[1:] ^ key[:-1]) < 1 << 20).nonzero()[0]
    key &= (1 << 20) - 1
    before = np.full(len(v), -1, np.int64)
    before[key[1:].take(same)] = key.take(same)
    if len(v) > FARTHEST:
        before[np.arange(len(v)) - before > FARTHEST] = -1
    return before


def _matching(v: np.ndarray, before: np.ndarray) -> Generator:
    """The tokens that _put_pixels() makes with matches: the longest copy from where three samples came last, else a literal."""
    n = len(v)
    # neighbours with one distance have one end, so the last of them alone is compared with what came before
    back = np.arange(n)
    back -= before
    back *= before >= 0
    last = back > 0
    last[:-1] &= back[1:] != back[:-1]
    ends = last.nonzero()[0]
    if not len(ends):
        return _tokens(v)
    key = back.take(ends)
    key <<= 20
    key |= ends
    key.sort()
    by, at = key >> 20, key & ((1 << 20) - 1)
    # a copy that gets as far as the next one with its distance has that one's end
    following = np.full(len(at), n)
    following[:-1] += (at[1:] - n) * (by[1:] == by[:-1])
    words = np.ndarray(n + 1, "<u8", v.tobytes() + bytes(8), strides=(1,)).copy()
    yield
    here, live, end = at + 3, np.arange(len(at)), np.empty(len(at), np.int64)
    while True:
        differs = words.take(here) ^ words.take(here - by.take(live))
        here += np.bitwise_count(~differs & (differs - np.uint64(1))) >> 3
        end[live] = here
        left = (differs == 0).nonzero()[0]
        if not len(left):
            break
        live, here = live.take(left), here.take(left)
        left = ((here < following.take(live)) & (here - at.take(live) < MAX_COPY)).nonzero()[0]
        live, here = live.take(left), here.take(left)
    yield
    linked = (end >= following) & (following < n)
    if linked.any():
        own = np.where(linked, len(at), np.arange(len(at)))
        end = end.take(np.minimum.accumulate(own[::-1])[::-1])
    reach = np.zeros(n, np.int64)
    reach[at] = np.minimum(end, n)
    group = last.astype(np.int64)  # how many groups of places with one distance end before
    np.cumsum(group, out=group)
    group -= last
    size = np.append(reach.take(ends), 0).take(group)
    to = np.arange(n + 1)
    size -= to[:n]
    np.minimum(size, MAX_COPY, out=size)
    size -= 1
    size *= back > 0
    size += 1
    to[:n] += size
    yield
    p = _walk(to, 0)
    far = back.take(p)
    c = far.nonzero()[0]
    at = p.take(c)
    return v.take(p).astype(np.int64), c, to.take(at) - at, far.take(c)


def _matched(v: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
    return _at_once(_matching(v, before))


_CACHE_BITS = 4
#: By grey value behind subtract-green: its place in the colour cache.
_SLOT = (((np.arange(256, dtype=np.uint64) << np.uint64(8) | np.uint64(BLACK)) * np.uint64(_HASH) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - _CACHE_BITS)).astype(np.int64)

_SLOT_FIRST = (_SLOT << 20).astype(np.int32)


def _cache_hits(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of samples by slot of the colour cache; whether it holds each when it comes, as the last one in its slot
    was the same; and how many of each value it holds."""
    at = _SLOT_FIRST.take(v)
    at |= np.arange(len(v), dtype=np.int32)
    at.sort()
    at &= (1 << 20) - 1
    by_slot = v.take(at).astype(np.int64)
    hit = np.zeros(len(v), bool)
    np.equal(by_slot[1:], by_slot[:-1], out=hit[1:])
    by_slot *= hit  # in place of those that it does not hold: 0, taken away below
    held = np.bincount(by_slot)
    held[0] -= len(v) - np.count_nonzero(hit)
    return at, hit, held


def _differences(v: np.ndarray, width: int, mode: int) -> np.ndarray:
    """What predictors 1 (left) and 11 (left or top) leave of grey samples."""
    guess = np.zeros_like(v)
    guess[1:] = v[:-1]
    if mode == 11:
        left, top, corner = v[width:-1], v[1:-width], v[: -width - 1]
        by_left = np.maximum(top, corner) - np.minimum(top, corner)
        by_top = np.maximum(left, corner) - np.minimum(left, corner)
        guess[width + 1 :] ^= (left ^ top) & -(by_left >= by_top).view(np.uint8)
    guess[width::width] = v[:-width:width]
    return v - guess


def _log_prefix(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_prefix() of many values: the codes, and the extra bits."""
    kind = _KIND.take(v - 1).astype(np.int64)
    return kind, v - _LEAST.take(kind)


@functools.cache
def _lone_codes(alpha: int) -> tuple[int, int]:
    """The codes of red, blue and alpha."""
    out = _Out()
    for s in (0, 0, alpha):
        _put_code(out, [0] * s + [1])
    return out.value, out.n


class _Picture:
    """A grey picture up to its tokens: out ends with the five prefix codes, and bits is the size of the whole."""

    def __init__(self, out: _Out, tokens: tuple[np.ndarray, ...], width: int, alpha: int = 255, cache_bits: int = 0):
        _at_once(self.begin(out, tokens, width, alpha, cache_bits))

    @classmethod
    def beginning(cls, *args) -> Generator:
        """The picture, for in_step()."""
        own = cls.__new__(cls)
        yield from own.begin(*args)
        return own

    def begin(self, out: _Out, tokens: tuple[np.ndarray, ...], width: int, alpha: int = 255, cache_bits: int = 0) -> Generator:
        self.out = out
        green, self.c, size, far = tokens
        if cache_bits:
            out.put(1 | cache_bits << 1, 5)
        else:
            out.put(0, 1)
        out.put(0, 1)
        self.green, self.far = green, far
        if len(self.c):
            kind, self.more = _log_prefix(size)
            self.more_bits = _EXTRA.take(kind)
            self.green = green.copy()
            self.green[self.c] = 256 + kind
            short = _short(width)
            code = short.take(far, mode="clip")
            self.far, self.far_more = _log_prefix(np.where(code > 0, code, far + len(NEAR)))
        at = out.n
        self.code, self.bits = yield from self._put(self.green)
        self.green_head = out.n - at
        out.put(*_lone_codes(alpha))
        if len(self.c):
            self.far_code, bits = yield from self._put(self.far)
            self.bits += bits + int(self.more_bits.sum() + _EXTRA.take(self.far).sum())
        else:
            _put_sizes(out, [0], [1])
        self.bits += out.n

    def _put(self, symbols: np.ndarray) -> Generator:
        """Writes the code of symbols: those used and their lengths; and how many bits all symbols take."""
        counts = np.bincount(symbols)
        used = counts.nonzero()[0]
        counts = counts.take(used).tolist()
        yield
        sizes = _code_sizes(counts)
        yield
        _put_sizes(self.out, used.tolist(), sizes)
        return (used, np.array(sizes)), sum(map(operator.mul, counts, sizes)) if len(sizes) > 1 else 0

    def __len__(self) -> int:
        return _file_size(self.bits)

    def write(self) -> bytes:
        values, sizes = _codes_of(self.green, *self.code)
        if len(self.c):
            far, far_sizes = _codes_of(self.far, *self.far_code)
            far |= self.far_more << far_sizes
            far_sizes += _EXTRA.take(self.far)
            values[self.c] |= self.more << sizes.take(self.c)
            sizes[self.c] += self.more_bits + far_sizes
        ends = sizes.cumsum()
        ends += self.out.n & 31
        total = int(ends[-1])
        at = ends - sizes
        if len(self.c):
            at, values = np.concatenate([at, ends.take(self.c) - far_sizes]), np.concatenate([values, far])
        # words of 32 bits: at most 33 bits are moved by 31, and no two tokens share a bit
        moved = values.astype(np.uint64) << (at & 31).astype(np.uint64)
        first = at >> 5
        body = np.zeros((total >> 5) + 3, np.uint64)
        for k, half in enumerate((moved & np.uint64(0xFFFFFFFF), moved >> np.uint64(32))):
            part = np.bincount(first, half)
            body[k : k + len(part)] += part.astype(np.uint64)
        whole = self.out.n >> 5 << 2
        head = self.out.value.to_bytes(whole + 4, "little")
        body[0] += int.from_bytes(head[whole:], "little")
        return _wrapped(head[:whole] + body.astype("<u4").tobytes()[: (total + 7) // 8])


def _file_size(bits: float) -> int:
    n = (int(bits) + 7) // 8
    return 20 + n + (n & 1)


def _codes_of(symbols: np.ndarray, used: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits and sizes of the codes of symbols, by the lengths of those used; a lone symbol takes none."""
    if len(used) == 1:
        return np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64)
    order = sizes.argsort(kind="stable")
    bits_of, size_of = np.zeros(used[-1] + 1, np.int64), np.zeros(used[-1] + 1, np.int64)
    size_of[used] = sizes
    used, sizes = used.take(order), sizes.take(order)
    width = int(sizes[-1])
    spread = 1 << (width - sizes)
    bits_of[used] = _reversed_bits(width).take(spread.cumsum() - spread)
    return bits_of.take(symbols), size_of.take(symbols)


def _grey(samples: np.ndarray, width: int) -> _Picture:
    out = _Out()
    out.put(0x2F | (width - 1) << 8 | (len(samples) // width - 1) << 22, 40)
    out.put(1 | SUBTRACT_GREEN << 1, 3)
    out.put(0, 1)
    return _Picture(out, _tokens(samples), width)


def encode_samples(samples: np.ndarray, width: int) -> bytes:
    """A grey picture of 8-bit samples, row by row: subtract-green leaves them in the green channel alone."""
    return _grey(samples, width).write()


def _least(counts: np.ndarray) -> float:
    """Bits that no prefix code of symbols with these counts gets below, and that its lengths take."""
    used = counts.nonzero()[0]
    if len(used) <= 2:
        return 0.0
    c = counts.take(used)
    gaps = used[-1] >= len(used)  # two kinds of runs at least, so a bit for each symbol's length
    return _entropy(c) + _HEAD_OF_CODE + (len(used) if gaps else 0)


def _entropy(counts: np.ndarray) -> float:
    """Bits that no prefix code of symbols with these counts, all above 0, gets below."""
    total = int(counts.sum())
    return total * (math.log2(total) - 1e-6) - float(counts @ np.log2(counts)) if total else 0.0


def _far_bits(far: np.ndarray, width: int) -> float:
    """Bits that these distances take at least; those that may have a short code count as nothing."""
    kinds = np.bincount(_log_prefix(far[far > _near(width).max()] + len(NEAR))[0])
    return _entropy(kinds[kinds > 0]) + int(kinds @ _EXTRA[: len(kinds)])


def _alone(v: np.ndarray, before: np.ndarray, width: int, enough: float) -> float:
    """Bits that these tokens take at least, whatever follows: samples that no copy reaches, and copies that begin
    where none before them reaches. Copies count as one symbol; other symbols may fill the gaps between them all.
    Distances are left out if the rest is more than `enough`.
    """
    n = len(v) - 2  # the last two samples may begin copies of what follows
    new = before[:n] < 0
    lone = new.copy()
    lone[1:] &= new[:-1]
    begins = (lone[:-1] & ~new[1:]).nonzero()[0] + 1
    lone[2:] &= new[:-2]
    counts = np.bincount(v[:n].compress(lone), minlength=257)
    counts[256] = len(begins)
    bits = _least(np.sort(counts[counts > 0])[::-1])
    return bits if bits > enough else bits + _far_bits(begins - before.take(begins), width)


def _of_tokens(n: int, tokens: tuple[np.ndarray, ...], width: int) -> float:
    """Bits that these tokens of the first n samples take at least, whatever follows; copies count as one symbol."""
    green, c, size, far = tokens
    many = np.ones(len(green), np.int64)
    many[c] = size
    kinds = green.copy()
    kinds[c] = 256
    sure = kinds[: np.searchsorted(many.cumsum() - many, n - 2)]  # the last two samples may begin copies of what follows
    return _least(np.bincount(sure)) + _far_bits(far[c < len(sure)], width)


# Bits that a form takes at least: header, no transform, no cache, one group, codes of one symbol; and a code's lengths.
_HEAD, _HEAD_OF_CODE = 87, 23

#: The forms that encode_smallest() chooses from, as encode() takes them; the first is encode_samples().
FORMS = (
    None,
    {"palette": True},
    {"palette": True, "matches": True},
    {"green": True, "matches": True},
    {"green": True, "cache_bits": 4},
    {"mode": 1, "green": True},
    {"mode": 11, "green": True, "matches": True},
    {"cross": (32, 32, 0), "matches": True},
)


def encode_smallest(samples: np.ndarray, width: int) -> bytes:
    return _at_once(encoding_smallest(samples, width))


def encoding_smallest(samples: np.ndarray, width: int) -> Generator:
    """The smallest of FORMS for a grey picture of any size, the first of equals, without writing the others.

    A form is left out only if a bound on its size, by the entropy of symbols that it must have, is no better than what
    is there already. The cross-colour form never wins: it has the copies of subtract-green with matches, and red and
    blue codes that are no smaller than the single symbols there.
    """
    height = len(samples) // width

    def start(mode: int | None = None, colours: np.ndarray | None = None, green: bool = True) -> _Out:
        out = _Out()
        out.put(0x2F | (width - 1) << 8 | (height - 1) << 22, 36)
        out.put(1, 4)
        if colours is not None:
            _put_palette(out, [BLACK | v << 16 | v << 8 | v for v in colours.tolist()])
        if mode is not None:
            _put_predictor(out, mode, width, height)
        if green:
            out.put(1 | SUBTRACT_GREEN << 1, 3)
        out.put(0, 1)
        return out

    counts = np.bincount(samples)
    colours = counts.nonzero()[0]
    before = _repeats(samples)
    yield
    tokens = yield from _matching(samples, before)
    yield
    copied = yield from _Picture.beginning(start(), tokens, width)
    yield
    best = (len(copied), 3, copied)

    def better(form: int, bits: float) -> bool:
        return (_file_size(bits), form) < best[:2]

    def offer(form: int, picture: _Picture) -> None:
        nonlocal best
        if (len(picture), form) < best[:2]:
            best = (len(picture), form, picture)

    plain = better(0, _HEAD + _least(counts))
    if plain:
        offer(0, _grey(samples, width))
    if len(colours) <= 16:
        index, across = _packed(np.searchsorted(colours, samples), width, len(colours))
        index = index.astype(np.uint8)
        offer(1, _Picture(start(colours=colours, green=False), _tokens(index), across))
        offer(2, _Picture(start(colours=colours, green=False), _matched(index, _repeats(index)), across))
    else:  # indices are in the order of the samples, so codes and copies have the same lengths
        palette = 14 + len(colours) + 3 * _least(np.bincount(colours[1:] - colours[:-1]))
        if better(2, copied.bits - copied.green_head - 3 + _HEAD_OF_CODE + palette):
            index = np.searchsorted(colours, samples).astype(np.uint8)
            offer(2, _Picture(start(colours=colours, green=False), _matched(index, before), width))
        if plain and better(1, _HEAD + _least(counts[colours]) + palette):
            index = np.searchsorted(colours, samples).astype(np.uint8)
            offer(1, _Picture(start(colours=colours, green=False), _tokens(index), width))
    yield
    places, hit, held = _cache_hits(samples)
    missed = counts.copy()
    missed[: len(held)] -= held
    if better(4, _HEAD + _least(np.concatenate([missed, np.bincount(_SLOT[: len(held)], held).astype(np.int64)]))):
        hits = places[hit]
        tokens = _tokens(samples)
        tokens[0][hits] = 280 + _SLOT[samples[hits]]
        offer(4, _Picture(start(), tokens, width, cache_bits=_CACHE_BITS))
    steps = _differences(samples, width, 1)
    if better(5, _HEAD + _least(np.bincount(steps))):
        offer(5, _Picture(start(mode=1), _tokens(steps), width, alpha=0))
    yield
    steps = _differences(samples, width, 11)
    yield
    # over five bits a sample are usual, so a part mostly shows that the whole is larger
    for n in sorted({min(len(steps), max(64, best[0] * 7 // 4)), len(steps)}):
        before = _repeats(steps[:n])
        if not better(6, _HEAD + _alone(steps[:n], before, width, 8 * best[0])):
            break
        tokens = _matched(steps[:n], before)
        if not better(6, _HEAD + _of_tokens(n, tokens, width)):
            break
    else:
        offer(6, _Picture(start(mode=11), tokens, width, alpha=0))
    yield
    return best[2].write()
