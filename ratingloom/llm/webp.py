"""Lossless WebP (VP8L) as a media column: payload bytes are stored as grey images and read back as pixel arrays.

The decoder reads any VP8L stream: simple and normal prefix codes, meta prefix codes, back-references with the plane-distance
map, the colour cache, and the predictor, cross-colour, subtract-green and palette transforms. Streams with one prefix group,
constant red, blue and alpha and no cache are decoded from tables over all bit positions at once; all others pixel by pixel.

The encoder writes a payload as grey samples (rows of 64, wider beyond 16384 rows, then the last row is padded) and takes the
shortest of three forms: a palette with packed pixels (16 different values or fewer), green subtracted so that only one channel
remains, or the differences from the pixel to the left or above after that. Symbols go by length-limited prefix codes; runs of one
byte are back-references.

Edge cases: a null text is stored like an empty one, as 64 zero bytes; a payload beyond 2**28 bytes raises ``ValueError``, as does
a file that isn't a lossless WebP; repeated rows are stored once each; extra columns are kept, same-named replaced.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

MAX_SIDE = 16384
MAX_BITS = 15
#: Fixed values of the format: the order in which the code lengths of the code-length code are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: The nearest 120 pixels above or to the left, by distance; the format numbers them in this order.
PLANE = sorted(
    ((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0),
    key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]),
)
ALPHABETS = (280, 256, 256, 256, 40)  # green and lengths, red, blue, alpha, distances
CACHE_MULTIPLIER = 0x1E35A7BD


# --- prefix codes -----------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Prefix code lengths of the symbols that occur; counts are flattened until the longest code fits."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    weight = counts[used].tolist()
    while True:
        heap = [(w, i) for i, w in enumerate(weight)]
        heapq.heapify(heap)
        up = [0] * (2 * len(weight) - 1)
        for node in range(len(weight), len(up)):
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            up[a[1]] = up[b[1]] = node
            heapq.heappush(heap, (a[0] + b[0], node))
        depth = [0] * len(up)
        for node in range(len(up) - 2, -1, -1):
            depth[node] = depth[up[node]] + 1
        if max(depth[: len(weight)]) <= limit:
            out[used] = depth[: len(weight)]
            return out
        weight = [w // 2 + 1 for w in weight]


#: Every number below 2**15 with its bits in reverse order.
REVERSED = np.zeros(1, np.int64)
for _k in range(MAX_BITS):
    REVERSED = np.concatenate([REVERSED * 2, REVERSED * 2 + 1])


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes with their bits reversed, as they stand in the stream."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    share = 1 << (MAX_BITS - lengths[order])
    codes = np.zeros(len(lengths), np.int64)
    codes[order] = REVERSED[np.cumsum(share) - share]
    return codes


class Prefix:
    """Decoding table over the next ``bits`` bits: symbol * 16 + code length. A single symbol takes no bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) < 2:
            self.bits, self.only = 0, int(used[0]) if len(used) else 0
            self.table = np.array([self.only * 16], np.int64)
        else:
            order = used[np.argsort(lengths[used], kind="stable")]
            own = lengths[order]
            self.only, self.bits = None, int(own[-1])
            straight = np.repeat(order * 16 + own, 1 << (self.bits - own))
            if len(straight) != 1 << self.bits:
                raise ValueError("a prefix code is incomplete or over-full")
            self.table = straight[REVERSED[np.arange(1 << self.bits) << (MAX_BITS - self.bits)]]
        self.list: list[int] | None = None

    def read(self, r: Bits) -> int:
        if not self.bits:
            return self.only
        if self.list is None:
            self.list = self.table.tolist()
        x = self.list[r.peek(self.bits)]
        r.at += x & 15
        return x >> 4


class Bits:
    """Little-endian bit reader; bits beyond the end are zero."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def peek(self, n: int) -> int:
        b = self.at >> 3
        return (int.from_bytes(self.data[b : b + 8], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def take(self, n: int) -> int:
        x = self.peek(n)
        self.at += n
        return x


def read_prefix(r: Bits, size: int) -> Prefix:
    lengths = np.zeros(size, np.int64)
    if r.take(1):
        two = r.take(1)
        first = r.take(8 if r.take(1) else 1)
        symbols = [first, r.take(8)] if two else [first]
        for s in symbols:
            lengths[s] = 1
        return Prefix(lengths)
    own = np.zeros(19, np.int64)
    for k in range(4 + r.take(4)):
        own[LENGTH_ORDER[k]] = r.take(3)
    code = Prefix(own)
    left = 2 + r.take(2 + 2 * r.take(3)) if r.take(1) else size
    at, previous = 0, 8
    while at < size and left:
        left -= 1
        s = code.read(r)
        if s < 16:
            lengths[at] = s
            previous = s or previous
            at += 1
            continue
        n, value = (3 + r.take(2), previous) if s == 16 else (3 + r.take(3), 0) if s == 17 else (11 + r.take(7), 0)
        if at + n > size:
            raise ValueError("code lengths run over the alphabet")
        lengths[at : at + n] = value
        at += n
    return Prefix(lengths)


def extra(prefix: int) -> tuple[int, int]:
    """(base, number of extra bits) of a length or distance prefix."""
    if prefix < 4:
        return prefix + 1, 0
    n = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << n) + 1, n


def distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = PLANE[code - 1]
    return max(1, x + y * width)


# --- decoding ---------------------------------------------------------------------------------------------------------


def read_image(r: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """ARGB pixels of an entropy-coded image, a flat uint32 array."""
    cache_bits = r.take(4) if r.take(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    block, groups_of, n_groups = 0, None, 1
    if main and r.take(1):
        block = r.take(3) + 2
        w, h = -(-width >> block), -(-height >> block)
        groups_of = (read_image(r, w, h, False) >> 8) & 0xFFFF
        n_groups = int(groups_of.max()) + 1
    cache = 1 << cache_bits if cache_bits else 0
    groups = [[read_prefix(r, n + (cache if k == 0 else 0)) for k, n in enumerate(ALPHABETS)] for _ in range(n_groups)]
    if n_groups == 1 and not cache and not any(p.bits for p in groups[0][1:4]):
        return _one_channel(r, width * height, width, groups[0])
    return _any_pixels(r, width, height, groups, groups_of, block, cache_bits)


def _one_channel(r: Bits, total: int, width: int, codes: list[Prefix]) -> np.ndarray:
    """Pixels of which only green varies: symbols and successors of all bit positions by table, then one walk."""
    green, dist = codes[0], codes[4]
    fixed = codes[1].only << 16 | codes[2].only | codes[3].only << 24
    if not green.bits:
        if green.only >= 256:
            raise ValueError("a reference before any pixel")
        return np.full(total, fixed | green.only << 8, np.uint32)
    start = r.at >> 3
    data = np.frombuffer(r.data[start:] + b"\0" * 4, np.uint8).astype(np.uint32)
    word = data[:-3] | data[1:-2] << 8 | data[2:-1] << 16
    window = (word[:, None] >> np.arange(8, dtype=np.uint32)) & np.uint32((1 << green.bits) - 1)
    entry = green.table.astype(np.int32)[window.ravel()]
    symbol = entry >> 4
    # a position that isn't a literal follows itself, so that walks stop there; so does the end of the stream
    limit = len(entry)
    after = np.arange(limit + 1, dtype=np.int32)
    literal = symbol < 256
    after[:limit] += np.where(literal, entry & 15, 0)
    np.minimum(after, limit, out=after)
    leap = after
    for _ in range(3):
        leap = leap[leap]
    walk = memoryview(leap)
    out = np.zeros(total, np.uint8)
    at, p = 0, r.at - 8 * start
    while at < total:
        anchors = [p]
        put = anchors.append
        for _ in range((total - at) >> 3):
            q = walk[p]
            if q == p:
                break
            put(q)
            p = q
        steps = [np.array(anchors, np.int32)]
        for _ in range(7):
            steps.append(after[steps[-1]])
        seen = np.stack(steps, axis=1).ravel()
        stop = np.flatnonzero(after[seen] == seen)
        seen = seen[: min(int(stop[0]) if len(stop) else len(seen), total - at)]
        out[at : at + len(seen)] = symbol[seen]
        at += len(seen)
        p = int(after[seen[-1]]) if len(seen) else p
        if p >= limit and at < total:
            raise ValueError("the stream ends early")
        if at < total:  # a back-reference
            r.at = 8 * start + p + int(entry[p] & 15)
            base, n = extra(int(symbol[p]) - 256)
            length = base + r.take(n)
            base, n = extra(dist.read(r))
            back = distance(base + r.take(n), width)
            if back > at or at + length > total:
                raise ValueError("a reference out of the image")
            if back >= length:
                out[at : at + length] = out[at - back : at - back + length]
            else:
                out[at : at + length] = np.resize(out[at - back : at], length)
            at += length
            p = r.at - 8 * start
    r.at = 8 * start + p
    return out.astype(np.uint32) << 8 | np.uint32(fixed)


def _any_pixels(r: Bits, width: int, height: int, groups, groups_of, block: int, cache_bits: int) -> np.ndarray:
    total, at = width * height, 0
    out = [0] * total
    cache, cached = [0] * (1 << cache_bits), 0
    across = -(-width >> block) if groups_of is not None else 0
    group = groups[0]
    while at < total:
        if groups_of is not None:
            y, x = divmod(at, width)
            group = groups[int(groups_of[(y >> block) * across + (x >> block)])]
        s = group[0].read(r)
        if s < 256:
            red = group[1].read(r)
            blue = group[2].read(r)
            out[at] = group[3].read(r) << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            base, n = extra(s - 256)
            length = base + r.take(n)
            base, n = extra(group[4].read(r))
            back = distance(base + r.take(n), width)
            if back > at or at + length > total:
                raise ValueError("a reference out of the image")
            for _ in range(length):
                out[at] = out[at - back]
                at += 1
        else:
            while cached < at:  # the cache takes in pixels only before it is asked
                cache[(out[cached] * CACHE_MULTIPLIER & 0xFFFFFFFF) >> (32 - cache_bits)] = out[cached]
                cached += 1
            out[at] = cache[s - 280]
            at += 1
        if r.at > 8 * len(r.data):
            raise ValueError("the stream ends early")
    return np.array(out, np.uint32)


def channels(pixels: np.ndarray) -> np.ndarray:
    """(n, 4) of alpha, red, green, blue as int32."""
    return np.stack([(pixels >> s & 0xFF).astype(np.int32) for s in (24, 16, 8, 0)], axis=-1)


def packed(c: np.ndarray) -> np.ndarray:
    c = (c & 0xFF).astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _select(left, top, corner):
    p = left + top - corner
    return np.where((np.abs(p - left).sum(-1) < np.abs(p - top).sum(-1))[..., None], left, top)


#: The format's predictors from the pixels left, top, top right and top left.
PREDICTORS = (
    lambda l, t, tr, tl: np.array([255, 0, 0, 0]) + 0 * t,
    lambda l, t, tr, tl: l,
    lambda l, t, tr, tl: t,
    lambda l, t, tr, tl: tr,
    lambda l, t, tr, tl: tl,
    lambda l, t, tr, tl: (((l + tr) >> 1) + t) >> 1,
    lambda l, t, tr, tl: (l + tl) >> 1,
    lambda l, t, tr, tl: (l + t) >> 1,
    lambda l, t, tr, tl: (tl + t) >> 1,
    lambda l, t, tr, tl: (t + tr) >> 1,
    lambda l, t, tr, tl: (((l + tl) >> 1) + ((t + tr) >> 1)) >> 1,
    lambda l, t, tr, tl: _select(l, t, tl),
    lambda l, t, tr, tl: np.clip(l + t - tl, 0, 255),
    lambda l, t, tr, tl: np.clip((a := (l + t) >> 1) + np.trunc((a - tl) / 2).astype(np.int32), 0, 255),
)
#: Those that don't ask the left pixel: a whole run of a row at once.
ROWWISE = (0, 2, 3, 4, 8, 9)


def unpredict(pixels: np.ndarray, width: int, height: int, modes: np.ndarray, block: int) -> np.ndarray:
    c = channels(pixels).reshape(height, width, 4)
    mode = (modes >> 8 & 15).astype(int).reshape(-(-height >> block), -1)
    c[0, 0] = (c[0, 0] + (255, 0, 0, 0)) & 255
    c[0, :] = np.cumsum(c[0, :], axis=0) & 255
    for y in range(1, height):
        above, row = c[y - 1], c[y]
        row[0] = (row[0] + above[0]) & 255
        right = np.concatenate([above[1:], row[:1]])  # beyond the last column stands the first pixel of this row
        x = 1
        while x < width:
            m = int(mode[y >> block, x >> block])
            end = min(width, ((x >> block) + 1) << block)
            if m == 1:
                row[x:end] = (row[x - 1] + np.cumsum(row[x:end], axis=0)) & 255
            elif m in ROWWISE:
                row[x:end] = (row[x:end] + PREDICTORS[m](None, above[x:end], right[x:end], above[x - 1 : end - 1])) & 255
            else:
                f = PREDICTORS[m] if m < 14 else PREDICTORS[0]
                for k in range(x, end):
                    row[k] = (row[k] + f(row[k - 1], above[k], right[k], above[k - 1])) & 255
            x = end
    return packed(c.reshape(-1, 4))


def uncross(pixels: np.ndarray, width: int, height: int, elements: np.ndarray, block: int) -> np.ndarray:
    c = channels(pixels).reshape(height, width, 4)
    e = channels(elements).reshape(-(-height >> block), -1, 4).astype(np.int8).astype(np.int32)
    e = e.repeat(1 << block, axis=0)[:height].repeat(1 << block, axis=1)[:, :width]
    signed = lambda x: (x & 0xFF).astype(np.uint8).view(np.int8).astype(np.int32)
    green = signed(c[..., 2])
    c[..., 1] += (e[..., 3] * green) >> 5
    c[..., 3] += ((e[..., 2] * green) >> 5) + ((e[..., 1] * signed(c[..., 1])) >> 5)
    return packed(c.reshape(-1, 4))


def decode(data: bytes) -> np.ndarray:
    """Pixels of a lossless WebP file: (height, width, 4) uint8 of alpha, red, green, blue."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":  # other chunks may stand before it
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        at += 8 + size + (size & 1)
        if at + 8 >= len(data):
            raise ValueError("no lossless image")
    body = data[at + 8 : at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")]
    if body[:1] != b"\x2f":
        raise ValueError("no lossless signature")
    r = Bits(body)
    r.at = 8
    width, height = r.take(14) + 1, r.take(14) + 1
    r.take(1)
    if r.take(3):
        raise ValueError("unknown version")
    todo: list = []
    coded = width
    while r.take(1):
        kind = r.take(2)
        if any(t[0] == kind for t in todo):
            raise ValueError("a transform stands twice")
        if kind < 2:
            block = r.take(3) + 2
            todo.append((kind, coded, block, read_image(r, -(-coded >> block), -(-height >> block), False)))
        elif kind == 2:
            todo.append((kind,))
        else:
            size = r.take(8) + 1
            palette = packed(np.cumsum(channels(read_image(r, size, 1, False)), axis=0))
            bits = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            todo.append((kind, coded, bits, palette))
            coded = -(-coded >> bits)
    pixels = read_image(r, coded, height, True)
    for t in reversed(todo):
        if t[0] == 0:
            pixels = unpredict(pixels, t[1], height, t[3], t[2])
        elif t[0] == 1:
            pixels = uncross(pixels, t[1], height, t[3], t[2])
        elif t[0] == 2:
            green = pixels >> 8 & 0xFF
            pixels = (pixels & np.uint32(0xFF00FF00)) | ((pixels & 0x00FF00FF) + (green << 16 | green)) & np.uint32(0x00FF00FF)
        else:
            _, wide, bits, palette = t
            index = (pixels >> 8 & 0xFF).reshape(height, -1)
            if bits:
                each = 8 >> bits
                index = (index[:, :, None] >> (np.arange(1 << bits, dtype=np.uint32) * each) & ((1 << each) - 1)).reshape(height, -1)[:, :wide]
            table = np.zeros(256, np.uint32)
            table[: len(palette)] = palette
            pixels = table[index.ravel()]
    return np.stack([(pixels >> s & 0xFF).astype(np.uint8) for s in (24, 16, 8, 0)], axis=-1).reshape(height, width, 4)


# --- encoding ---------------------------------------------------------------------------------------------------------


class BitsOut:
    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


#: A complete code for the 19 symbols that describe code lengths: 13 of 4 bits and 6 of 5.
LENGTH_BITS = [4] * 13 + [5] * 6
LENGTH_CODES = canonical(np.array(LENGTH_BITS)).tolist()


def write_prefix(w: BitsOut, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 1 and (not used or used[0] < 256):
        s = used[0] if used else 0
        w.put(0b001 if s < 2 else 0b101, 3)  # simple, one symbol, of 1 or 8 bits
        w.put(s, 1 if s < 2 else 8)
        return
    if len(used) == 2 and used[1] < 256:
        w.put(0b111, 3)
        w.put(used[0], 8)
        w.put(used[1], 8)
        return
    w.put(0, 1)
    w.put(15, 4)
    for k in LENGTH_ORDER:
        w.put(LENGTH_BITS[k], 3)
    w.put(0, 1)
    codes, bits = LENGTH_CODES, LENGTH_BITS
    at = 0
    for s in [*used, len(lengths)]:
        gap = s - at
        while gap >= 3:
            n = min(gap, 138)
            k = 18 if n >= 11 else 17
            n = n if k == 18 else min(n, 10)
            w.put(codes[k], bits[k])
            w.put(n - (11 if k == 18 else 3), 7 if k == 18 else 3)
            gap -= n
        for _ in range(gap):
            w.put(codes[0], bits[0])
        if s < len(lengths):
            w.put(codes[int(lengths[s])], bits[int(lengths[s])])
        at = s + 1


def runs(data: np.ndarray, least: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the repeats of the byte before, of ``least`` bytes or more."""
    same = np.concatenate([[False], data[1:] == data[:-1], [False]])
    edge = np.flatnonzero(same[1:] != same[:-1])
    start, stop = edge[::2] + 1, edge[1::2] + 1
    keep = stop - start >= least
    return start[keep], (stop - start)[keep]


def length_prefix(n: int) -> tuple[int, int, int]:
    """(prefix, extra bits' value, their number) of a length or distance."""
    if n <= 4:
        return n - 1, 0, 0
    x = n - 1
    high = x.bit_length() - 1
    second = x >> (high - 1) & 1
    return 2 * high + second, x & ((1 << (high - 1)) - 1), high - 1


def put_body(w: BitsOut, data: np.ndarray, alpha: int) -> bytes:
    """The stream of ``w`` and, after it, an image of which only green varies: prefix codes, symbols and run references."""
    start, length = runs(data)
    # symbols of the green alphabet in stream order, with the extra bits that follow each
    literal = np.ones(len(data), bool)
    copies: list[tuple[int, int, int, int]] = []
    for s, n in zip(start.tolist(), length.tolist()):
        literal[s : s + n] = False
        for k in range(s, s + n, 4096):
            copies.append((k, *length_prefix(min(4096, s + n - k))))
    order = np.flatnonzero(literal)
    symbol = data[order].astype(np.int64)
    more, more_bits = np.zeros(len(symbol), np.int64), np.zeros(len(symbol), np.int64)
    if copies:
        c = np.array(copies, np.int64)
        where = np.searchsorted(order, c[:, 0])
        symbol = np.insert(symbol, where, c[:, 1] + 256)
        more, more_bits = np.insert(more, where, c[:, 2]), np.insert(more_bits, where, c[:, 3])
    counts = np.bincount(symbol, minlength=ALPHABETS[0])
    lengths = code_lengths(counts)
    if len(np.flatnonzero(counts)) == 1 and int(symbol[0]) < 256:
        lengths = (counts > 0).astype(np.int64)
    w.put(0, 2)  # no colour cache, no meta codes
    write_prefix(w, lengths)
    for s in (0, 0, alpha, 1):  # red, blue, alpha; distance 1 is number 2 of the plane map, of prefix 1
        write_prefix(w, single_code(s))
    single = np.count_nonzero(lengths) == 1
    n_bits = (np.zeros_like(symbol) if single else lengths[symbol]) + more_bits
    value = (np.zeros_like(symbol) if single else canonical(lengths)[symbol] | more << lengths[symbol])
    head = w.n & 7
    at = np.cumsum(n_bits) - n_bits + head
    size = (int(at[-1] + n_bits[-1]) + 7 >> 3) + 4
    value = value << (at & 7)
    first = at >> 3
    body = np.bincount(first, value & 255, size) + np.bincount(first + 1, value >> 8 & 255, size) + np.bincount(first + 2, value >> 16 & 255, size) + np.bincount(first + 3, value >> 24, size)
    body = body.astype(np.uint8)[: size - 4]
    prefix = w.value.to_bytes((w.n + 7) // 8, "little")
    if head and len(body):
        body[0] |= prefix[-1]
        prefix = prefix[:-1]
    return prefix + body.tobytes()


def single_code(symbol: int, size: int = 256) -> np.ndarray:
    """Code lengths of an alphabet of which one symbol occurs."""
    out = np.zeros(size, np.int64)
    out[symbol] = 1
    return out


def put_head(width: int, height: int) -> BitsOut:
    if max(width, height) > MAX_SIDE:
        raise ValueError(f"{width} x {height} pixels: a side has {MAX_SIDE} at most")
    w = BitsOut()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 4)  # no alpha, version 0
    return w


def palette_stream(data: np.ndarray, width: int, height: int) -> bytes:
    """The image as a palette and pixels packed into the green channel: 8, 4 or 2 of them a sample."""
    values, index = np.unique(data, return_inverse=True)
    bits = 3 if len(values) <= 2 else 2 if len(values) <= 4 else 1
    w = put_head(width, height)
    w.put(0b111, 3)  # a transform: palette
    w.put(len(values) - 1, 8)
    steps = np.diff(values, prepend=0).astype(np.int64) & 255  # every channel has the same differences; alpha 255 and then 0
    colour = code_lengths(np.bincount(steps, minlength=256))
    alpha = single_code(255)
    alpha[0] = len(values) > 1
    w.put(0, 1)
    for code in (np.append(colour, np.zeros(ALPHABETS[0] - 256, np.int64)), colour, colour, alpha, single_code(0)):
        write_prefix(w, code)
    canon, alphas, several = canonical(colour), canonical(alpha), np.count_nonzero(colour) > 1
    for k, s in enumerate(steps.tolist()):
        for _ in range(3):
            w.put(int(canon[s]) if several else 0, int(colour[s]) if several else 0)
        if len(values) > 1:
            w.put(int(alphas[0 if k else 255]), 1)
    w.put(0, 1)  # no further transform
    each, across = 8 >> bits, -(-width >> bits)
    rows = np.zeros((height, across << bits), np.int64)
    rows[:, :width] = index.reshape(height, width)
    packed_ = (rows.reshape(height, across, 1 << bits) << (np.arange(1 << bits) * each)).sum(axis=2)
    return put_body(w, packed_.ravel().astype(np.uint8), 255)


def residuals(data: np.ndarray, width: int, height: int, mode: int) -> np.ndarray:
    """Differences of one channel from the pixel to the left (1) or above (2); the first row takes the left, the first column the upper."""
    x = data.reshape(height, width)
    out = x.copy()
    if mode == 1:
        out[:, 1:] -= x[:, :-1]
        out[1:, 0] -= x[:-1, 0]
    else:
        out[1:] -= x[:-1]
        out[0, 1:] -= x[0, :-1]
    return out.ravel()


def entropy(data: np.ndarray) -> float:
    p = np.bincount(data, minlength=256) / len(data)
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum())


def encode_grey(samples: bytes, width: int, height: int) -> bytes:
    """A lossless WebP file of ``width * height`` grey samples."""
    data = np.frombuffer(samples, np.uint8)
    w = put_head(width, height)
    w.put(0b101, 3)  # a transform: subtract green
    forms = [(entropy(data), 0, data), *((entropy(r), mode, r) for mode in (1, 2) for r in [residuals(data, width, height, mode)])]
    _, mode, body = min(forms, key=lambda f: f[:2])
    if mode:
        w.put(0b001, 3)  # a further transform: predictor
        w.put(7, 3)  # blocks of 512 pixels a side, all of one mode
        w.put(0, 1)
        for s, size in ((mode, ALPHABETS[0]), (0, 256), (0, 256), (255, 256), (0, ALPHABETS[4])):
            write_prefix(w, single_code(s, size))
    w.put(0, 1)  # no further transform
    streams = [put_body(w, body, 0 if mode else 255)]
    if len(np.unique(data)) <= 16:
        streams.append(palette_stream(data, width, height))
    stream = min(streams, key=len)
    stream += b"\0" * (len(stream) & 1 == 1)
    return b"RIFF" + (12 + len(stream)).to_bytes(4, "little") + b"WEBPVP8L" + len(stream).to_bytes(4, "little") + stream


def payload(text: str | None, unit: int = 64) -> tuple[bytes, int]:
    """(bytes padded to a positive multiple of ``unit``, bytes before that)."""
    raw = (text or "").encode()
    return raw + b"\0" * (-len(raw) % unit if raw else unit), len(raw)


def store(data: bytes) -> bytes:
    """A file of a payload whose length is a multiple of 64."""
    if len(data) > MAX_SIDE**2:
        raise ValueError(f"{len(data)} bytes: an image has {MAX_SIDE**2} pixels at most")
    width = 64 if len(data) <= 64 * MAX_SIDE else MAX_SIDE
    height = -(-len(data) // width)
    return encode_grey(data + b"\0" * (width * height - len(data)), width, height)


def to_media(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes``, ``payload_bytes`` and ``media``, the WebP file of the text."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("n_bytes long, payload_bytes long, media binary")
    def stored(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            data, n = payload(t)
            rows.append((n, len(data), store(data)))
        return pd.DataFrame(rows, columns=["n_bytes", "payload_bytes", "media"])

    keep = [c for c in docs.columns if c not in ("n_bytes", "payload_bytes", "media")]
    return docs.withColumn("_m", stored.asNondeterministic()(F.col(text_col))).select(*keep, "_m.*")


READ = ("width", "height", "channels", "pixels", "media_bytes", "media_sha256", "feature")


def read_media(media: DataFrame) -> DataFrame:
    """The pixel arrays of ``media`` beside its columns: ``width``, ``height``, ``channels`` (1: grey; 4: alpha, red, green, blue),
    ``pixels`` (bytes, row by row), and length, digest and a feature of the file."""

    @F.pandas_udf("width int, height int, channels int, pixels binary, media_bytes long, media_sha256 string, feature string")
    def opened(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for files in batches:
            rows = []
            for f in files:
                argb = decode(f)
                grey = np.ascontiguousarray(argb[:, :, 2])
                plain = all((argb[:, :, c] == grey).all() for c in (1, 3)) and (argb[:, :, 0] == 255).all()
                text = f"{argb.shape[1]}x{argb.shape[0]} levels={len(np.unique(grey))} mean={grey.mean():.4f} entropy={entropy(grey.ravel()):.4f}"
                rows.append((argb.shape[1], argb.shape[0], 1 if plain else 4, (grey if plain else argb).tobytes(), len(f), hashlib.sha256(f).hexdigest(), text))
            yield pd.DataFrame(rows, columns=list(READ))

    return media.withColumn("_r", opened.asNondeterministic()("media")).select(*(c for c in media.columns if c not in READ), "_r.*")


def write_pixels(media: DataFrame, path: str) -> None:
    """The pixel arrays of ``media`` as a table, without the files."""
    read_media(media).drop("media").write.parquet(path)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores all texts as a table of WebP files in the shared folder, reads it back and digests the pixel arrays."""
    files = cut(to_media(docs.select(id_col, F.col(text_col).alias("_text")), "_text").select(id_col, "n_bytes", "payload_bytes", "media"))
    read = read_media(files)
    data = F.substring("pixels", F.lit(1), F.col("payload_bytes").cast("int"))
    tail = F.substring("pixels", (F.col("payload_bytes") - 63).cast("int"), F.lit(64))
    return read.select(id_col, "n_bytes", "payload_bytes", F.sha2(data, 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), "media_bytes", "media_sha256", "feature", "width", "height")
