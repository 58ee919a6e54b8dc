"""Lossless WebP (VP8L): a full decoder, and an encoder, in numpy and Python.

The decoder reads prefix codes (simple and normal, with meta prefix groups), literals, back-references and colour
cache codes, and inverts the predictor, cross-colour, subtract-green and colour-indexing transforms. Where only the
green code takes bits (one group of codes, no cache, as in grey images) it looks up what a code at each bit of a
stretch would mean, then walks from code to code and copies the back-references; otherwise it goes code by code. Both
give the same pixels.

Pixels are uint8 arrays [height, width, 4] in the order alpha, red, green, blue. Broken input raises ValueError.
"""

from __future__ import annotations

import struct
from functools import lru_cache
from itertools import groupby

import numpy as np

# Fixed values of the format
LENGTH_CODE_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, COLOUR_INDEXING = 0, 1, 2, 3
MAX_SIDE = 16_384
CACHE_FACTOR = 0x1E35A7BD
SIGNATURE = 0x2F


@lru_cache(1)
def near_offsets() -> list[tuple[int, int]]:
    """(dx, dy) of the 120 short distance codes: by distance, then by |dx|, the positive side first."""
    every = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return sorted(every, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))


# --- decoding ---------------------------------------------------------------------------------------------


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + b"\0" * 8, 0, 8 * len(data)

    def peek(self, n: int) -> int:
        p = self.at >> 3
        return int.from_bytes(self.data[p : p + 8], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        out = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise ValueError("the stream ends early")
        return out


class _Code:
    """Canonical prefix code; table: what the next `bits` bits mean, as (symbol, length)."""

    def __init__(self, lengths: np.ndarray):
        used = lengths.nonzero()[0]
        if not len(used):
            raise ValueError("a prefix code has no symbols")
        self.lengths = lengths
        self.used = used
        self.flat: int | None = 0
        self.bits = 0
        if len(used) > 1:
            sizes = lengths[used]
            self.bits = int(sizes.max())
            self.flat = self.bits if int(sizes.min()) == self.bits else None
            if int((1 << (self.bits - sizes)).sum()) != 1 << self.bits:
                raise ValueError("a prefix code is not complete")
        self._table: list[tuple[int, int]] | None = None

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and length by the next `bits` bits."""
        if not self.bits:
            return self.used.astype(np.int16), np.zeros(1, np.int64)
        symbols, lengths, step = canonical(self.lengths)
        turned = backwards(self.bits)
        return np.repeat(symbols.astype(np.int16), step)[turned], np.repeat(lengths, step)[turned]

    def table(self) -> list[tuple[int, int]]:
        if self._table is None:
            self._table = list(zip(*(x.tolist() for x in self.arrays()), strict=True))
        return self._table

    def read(self, bits: _Bits) -> int:
        symbol, length = self.table()[bits.peek(self.bits)]
        bits.at += length
        if bits.at > bits.end:
            raise ValueError("the stream ends early")
        return symbol


@lru_cache(16)
def backwards(n: int) -> np.ndarray:
    """The numbers of n bits, each with its bits in reverse."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The used symbols in the order of their codes, their lengths, and how many codes of the greatest length each takes."""
    used = lengths.nonzero()[0]
    symbols = used[lengths[used].argsort(kind="stable")]
    sizes = lengths[symbols]
    return symbols, sizes, 1 << (sizes[-1:] - sizes)


def prefix_codes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code (its first bit lowest) and length of each symbol; the only symbol of a code takes no bits."""
    value, size = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    symbols, sizes, step = canonical(lengths)
    if len(symbols) > 1:
        value[symbols], size[symbols] = backwards(int(sizes[-1]))[np.cumsum(step) - step], sizes
    return value, size


@lru_cache(1024)
def _only(symbol: int, size: int) -> _Code:
    """The code of one symbol."""
    lengths = np.zeros(size, dtype=np.int64)
    lengths[symbol] = 1
    return _Code(lengths)


def _read_code(bits: _Bits, size: int) -> _Code:
    lengths = np.zeros(size, dtype=np.int64)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        if max(symbols) >= size:
            raise ValueError("a symbol is out of range")
        if len(set(symbols)) == 1:
            return _only(symbols[0], size)
        lengths[symbols] = 1
        return _Code(lengths)
    of_lengths = np.zeros(19, dtype=np.int64)
    for i in LENGTH_CODE_ORDER[: 4 + bits.read(4)]:
        of_lengths[i] = bits.read(3)
    code = _Code(of_lengths)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    # what is left of the lengths takes under 14 bits a symbol
    ahead = int.from_bytes(bits.data[bits.at >> 3 : (bits.at >> 3) + 2 * size + 8], "little") >> (bits.at & 7)
    table, mask = code.table(), (1 << code.bits) - 1
    found, last, taken = [], 8, 0
    while len(found) < size and left:
        left -= 1
        s, n = table[ahead & mask]
        ahead >>= n
        if s < 16:
            found.append(s)
            last = s or last
        else:
            value, least, extra = (last, 3, 2) if s == 16 else (0, 3, 3) if s == 17 else (0, 11, 7)
            found += [value] * (least + (ahead & ((1 << extra) - 1)))
            ahead >>= extra
            n += extra
        taken += n
    if len(found) > size:
        raise ValueError("code lengths run over")
    bits.at += taken
    if bits.at > bits.end:
        raise ValueError("the stream ends early")
    lengths[: len(found)] = found
    return _Code(lengths)


def _prefixed(symbol: int, bits: _Bits) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _read_image(bits: _Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Pixels as uint32 [height * width] of an entropy-coded image."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups, group_of, tile = 1, None, 0
    if main and bits.read(1):
        tile = bits.read(3) + 2
        across = (width + (1 << tile) - 1) >> tile
        down = (height + (1 << tile) - 1) >> tile
        group_of = ((_read_image(bits, across, down, False) >> 8) & 0xFFFF).astype(np.int64).reshape(down, across)
        groups = int(group_of.max()) + 1
    sizes = [280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40]
    codes = [[_read_code(bits, n) for n in sizes] for _ in range(groups)]
    flats = [c.flat for c in codes[0][:4]]
    if groups == 1 and not cache_bits and None not in flats and codes[0][0].used[-1] < 256:
        return _flat_pixels(bits, codes[0], flats, width * height)
    if groups == 1 and not cache_bits and codes[0][0].bits and not any(c.bits for c in codes[0][1:4]):
        return _grey_pixels(bits, codes[0], width, width * height)
    return _coded_pixels(bits, codes, group_of, tile, cache_bits, width, height)


#: Bytes of the stream whose bits are looked up at once.
STRETCH = 1 << 13
LEAP_BITS = 4


@lru_cache(64)
def _near(width: int) -> np.ndarray:
    """Distances of the 120 short distance codes."""
    return np.array([max(1, dx + dy * width) for dx, dy in near_offsets()], np.int64)


@lru_cache(64)
def _near_codes(width: int) -> np.ndarray:
    """The least short distance code of each distance, 0 where there is none."""
    out = np.zeros(8 * width + 9, np.int64)
    out[_near(width)[::-1]] = np.arange(120, 0, -1)
    return out


def _values(symbol: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths or distance codes of prefix symbols, and their numbers of extra bits, the extra bits being the next of
    window."""
    extra = np.where(symbol < 4, 0, (symbol - 2) >> 1).astype(np.int32)
    more = (window & ((np.uint32(1) << extra.astype(np.uint32)) - np.uint32(1))).astype(np.int32)
    return np.where(symbol < 4, symbol + 1, ((2 + (symbol & 1)) << extra) + more + 1).astype(np.int32), extra


def _grey_pixels(bits: _Bits, codes: list[_Code], width: int, total: int) -> np.ndarray:
    """Pixels of an image whose red, blue and alpha take no bits."""
    symbols, sizes = codes[0].arrays()
    far, far_sizes = codes[4].arrays()
    data = np.frombuffer(bits.data, np.uint8)
    near = _near(width)
    table = symbols.astype(np.int64) << 8 | sizes  # symbol and length in one number
    found: list[tuple[np.ndarray, ...]] = []
    at, have = bits.at, 0
    while have < total:
        if at >= bits.end:
            raise ValueError("the stream ends early")
        first = at >> 3
        raw = data[first : first + STRETCH + 16].astype(np.uint32)
        words = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
        window = (words[:, None] >> np.arange(8, dtype=np.uint32)).ravel()
        n = len(window)
        to = min(n, 8 * STRETCH, bits.end - 8 * first)
        entry = table.take((window[:to] & np.uint32((1 << codes[0].bits) - 1)).astype(np.int64))
        following = np.arange(to + 128)  # bits behind the stretch stay where they are
        following[:to] += entry & 255
        ref = (entry >= 256 << 8).nonzero()[0]
        ahead = lambda q: window[np.minimum(q, n - 1)]  # noqa: E731  behind the stream's end anything will do
        q = following[ref]
        length, extra = _values((entry[ref] >> 8) - 256, ahead(q))
        q = q + extra
        head = ahead(q) & np.uint32((1 << codes[4].bits) - 1)
        q = q + far_sizes[head]
        distance, extra = _values(far[head].astype(np.int32), ahead(q))
        following[ref] = q + extra
        far_on = following
        for _ in range(LEAP_BITS):  # from each bit, 2 ** LEAP_BITS codes on
            far_on = far_on.take(far_on)
        here, view, p = [], memoryview(far_on), at & 7
        while p < to:
            here.append(p)
            p = view[p]
        tokens = np.empty((1 << LEAP_BITS, len(here)), np.int64)
        tokens[0] = here
        for i in range(1, 1 << LEAP_BITS):
            following.take(tokens[i - 1], out=tokens[i], mode="clip")
        token = tokens.T.ravel()
        token = token[token < to]
        symbol = entry[token] >> 8
        is_ref = symbol >= 256
        of = np.searchsorted(ref, token[is_ref])
        run = np.ones(len(token), np.int64)
        run[is_ref] = length[of]
        code = np.zeros(len(token), np.int64)
        code[is_ref] = distance[of]
        ends = have + np.cumsum(run)
        used = int(np.searchsorted(ends, total)) + 1
        found.append((symbol[:used], run[:used], code[:used]))
        have = int(ends[min(used, len(ends)) - 1])
        at = 8 * first + (following[token[used - 1]] if used <= len(token) else p)
    if at > bits.end:
        raise ValueError("the stream ends early")
    bits.at = int(at)
    symbol, run, code = (np.concatenate(x) for x in zip(*found, strict=True))
    if have != total:
        raise ValueError("a back-reference leaves the image")
    start = np.cumsum(run) - run
    is_ref = symbol >= 256
    pixels = np.zeros(total, np.uint8)
    pixels[start[~is_ref]] = symbol[~is_ref]
    code = code[is_ref]
    distance = np.where(code > 120, code - 120, near[np.minimum(code, 120) - 1])
    if (distance > start[is_ref]).any():
        raise ValueError("a back-reference leaves the image")
    out = bytearray(pixels.tobytes())
    for a, n, d in zip(start[is_ref].tolist(), run[is_ref].tolist(), distance.tolist(), strict=True):
        if d >= n:
            out[a : a + n] = out[a - d : a - d + n]
        else:
            out[a : a + n] = (out[a - d : a] * (n // d + 1))[:n]
    red, blue, alpha = (int(c.used[0]) for c in codes[1:4])
    return np.frombuffer(bytes(out), np.uint8).astype(np.uint32) << np.uint32(8) | np.uint32(alpha << 24 | red << 16 | blue)


def _flat_pixels(bits: _Bits, codes: list[_Code], flats: list[int], n: int) -> np.ndarray:
    each = sum(flats)
    if bits.at + each * n > bits.end:
        raise ValueError("the stream ends early")
    out = np.zeros(n, dtype=np.uint32)
    raw = None
    if each:
        first = bits.at >> 3
        flat = np.unpackbits(np.frombuffer(bits.data, np.uint8, (bits.at + each * n + 7) // 8 - first, first), bitorder="little")
        raw = flat[bits.at & 7 :][: each * n].reshape(n, each)
    at = 0
    for code, width, shift in zip(codes, flats, (8, 16, 0, 24), strict=False):
        if width:
            value = raw[:, at].astype(np.uint8) if width <= 8 else raw[:, at].astype(np.uint16)
            for k in range(at + 1, at + width):
                value = (value << 1) | raw[:, k]
            out |= code.used.astype(np.uint32)[value] << np.uint32(shift)
        else:
            out |= np.uint32(int(code.used[0]) << shift)
        at += width
    bits.at += each * n
    return out


def _coded_pixels(bits: _Bits, codes: list[list[_Code]], group_of: np.ndarray | None, tile: int, cache_bits: int, width: int, height: int) -> np.ndarray:
    total, out = width * height, []
    cache, shift = [0] * (1 << cache_bits), 32 - cache_bits
    cached = 0  # pixels up to here are in the cache
    while len(out) < total:
        at = len(out)
        group = codes[0 if group_of is None else group_of[(at // width) >> tile, (at % width) >> tile]]
        s = group[0].read(bits)
        if s < 256:
            red, blue, alpha = (group[i].read(bits) for i in (1, 2, 3))
            out.append(alpha << 24 | red << 16 | s << 8 | blue)
        elif s < 280:
            length = _prefixed(s - 256, bits)
            code = _prefixed(group[4].read(bits), bits)
            if code > 120:
                distance = code - 120
            else:
                dx, dy = near_offsets()[code - 1]
                distance = max(1, dx + dy * width)
            if distance > at or at + length > total:
                raise ValueError("a back-reference leaves the image")
            for i in range(at - distance, at - distance + length):
                out.append(out[i])
        else:
            for p in out[cached:]:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> shift] = p
            cached = len(out)
            out.append(cache[s - 280])
        if cache_bits and len(out) - cached > 4096:
            for p in out[cached:]:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> shift] = p
            cached = len(out)
    return np.array(out, dtype=np.uint32)


def _channels(pixels: np.ndarray) -> np.ndarray:
    """[n] uint32 to [n, 4] uint8: alpha, red, green, blue."""
    return pixels.astype(">u4").view(np.uint8).reshape(-1, 4)


def _packed(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels, dtype=np.uint8).reshape(-1, 4).view(">u4").ravel().astype(np.uint32)


def _predict(mode: int, left, top, top_left, top_right):
    """One pixel's (or a row's) prediction, int16 channel arrays."""
    half = lambda a, b: (a + b) >> 1
    if mode == 5:
        return half(half(left, top_right), top)
    if mode == 6:
        return half(left, top_left)
    if mode == 7:
        return half(left, top)
    if mode == 8:
        return half(top_left, top)
    if mode == 9:
        return half(top, top_right)
    if mode == 10:
        return half(half(left, top_left), half(top, top_right))
    if mode == 11:
        near_left = np.abs(top - top_left).sum()  # distance of the estimate left + top - top_left from left
        near_top = np.abs(left - top_left).sum()
        return left if near_left < near_top else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        average = half(left, top)
        difference = average - top_left
        return np.clip(average + (np.sign(difference) * (np.abs(difference) >> 1)), 0, 255)
    return {1: left, 2: top, 3: top_right, 4: top_left}.get(mode, np.array([255, 0, 0, 0], np.int16))


def _predictions(image: np.ndarray, modes: np.ndarray, size_bits: int, residual: np.ndarray | None) -> np.ndarray:
    """Walks the image in order. residual given: fills image with residual + prediction (decoding). None: image
    is full, and the residuals are returned (encoding)."""
    height, width, _ = image.shape
    decode = residual is not None
    result = image if decode else np.zeros_like(image)
    black = np.array([255, 0, 0, 0], np.int16)
    for y in range(height):
        row_modes = modes[y >> size_bits]
        if y and decode and all(m in (0, 2, 4, 8) for m in row_modes):
            above = image[y - 1]
            before = np.vstack([above[:1], above[:-1]])
            m = row_modes[np.arange(width) >> size_bits][:, None]
            p = np.where(m == 0, black, np.where(m == 2, above, np.where(m == 4, before, (before + above) >> 1)))
            p[0] = above[0]
            image[y] = (residual[y] + p) & 255
            continue
        if decode and (y == 0 or (row_modes[: ((width - 1) >> size_bits) + 1] == 1).all()):  # each pixel after its left one
            first = residual[y].astype(np.int64)
            first[0] += image[y - 1, 0] if y else black
            image[y] = np.cumsum(first, axis=0) & 255
            continue
        for x in range(width):
            if y == 0:
                p = black if x == 0 else image[y, x - 1]
            elif x == 0:
                p = image[y - 1, 0]
            else:
                corner = image[y - 1, x + 1] if x + 1 < width else image[y, 0]
                p = _predict(int(row_modes[x >> size_bits]), image[y, x - 1], image[y - 1, x], image[y - 1, x - 1], corner)
            if decode:
                image[y, x] = (residual[y, x] + p) & 255
            else:
                result[y, x] = (image[y, x] - p) & 255
    return result


def _cross(image: np.ndarray, elements: np.ndarray, size_bits: int, sign: int) -> np.ndarray:
    """Adds (sign 1, decoding) or takes away (-1) the colour deltas; elements [tiles down, across, 4]."""
    height, width, _ = image.shape
    e = elements[np.arange(height)[:, None] >> size_bits, np.arange(width)[None, :] >> size_bits].astype(np.uint8).view(np.int8).astype(np.int32)
    signed = lambda c: c.astype(np.uint8).view(np.int8).astype(np.int32)
    out = image.astype(np.int32)
    green = signed(image[..., 2])
    old_red = image[..., 1]
    red = (out[..., 1] + sign * ((e[..., 3] * green) >> 5)) & 255
    full_red = red if sign > 0 else old_red
    blue = out[..., 3] + sign * ((e[..., 2] * green) >> 5) + sign * ((e[..., 1] * signed(full_red)) >> 5)
    out[..., 1], out[..., 3] = red, blue & 255
    return out.astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """Pixels [height, width, 4] of one WebP file with a VP8L chunk."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        if name == b"VP8L":
            return decode_stream(data[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    raise ValueError("no VP8L chunk")


def decode_stream(stream: bytes) -> np.ndarray:
    bits = _Bits(stream)
    if bits.read(8) != SIGNATURE:
        raise ValueError("not a VP8L stream")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, seen, now = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size_bits = bits.read(3) + 2
            across, down = (now + (1 << size_bits) - 1) >> size_bits, (height + (1 << size_bits) - 1) >> size_bits
            undo.append((kind, now, size_bits, _channels(_read_image(bits, across, down, False)).reshape(down, across, 4)))
        elif kind == COLOUR_INDEXING:
            n = bits.read(8) + 1
            table = np.cumsum(_channels(_read_image(bits, n, 1, False)), axis=0, dtype=np.uint8)
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, now, pack, table))
            now = (now + (1 << pack) - 1) >> pack
        else:
            undo.append((kind, now, 0, None))
    image = _channels(_read_image(bits, now, height, True)).reshape(height, now, 4)
    for kind, wide, number, extra in reversed(undo):
        if kind == SUBTRACT_GREEN:
            image = image.copy()
            image[..., 1] += image[..., 2]
            image[..., 3] += image[..., 2]
        elif kind == COLOUR_INDEXING:
            index = image[..., 2]
            if number:
                per, width_each = 1 << number, 8 >> number
                shifts = (np.arange(per, dtype=np.uint8) * width_each).astype(np.uint8)
                index = ((index[..., None] >> shifts) & ((1 << width_each) - 1)).reshape(height, -1)[:, :wide]
            full = np.zeros((256, 4), np.uint8)
            full[: len(extra)] = extra
            image = full[index]
        elif kind == CROSS_COLOUR:
            image = _cross(image, extra, number, 1)
        else:
            image = _predictions(np.zeros((height, wide, 4), np.int16), extra[..., 2] & 15, number, image.astype(np.int16)).astype(np.uint8)
    return image


# --- encoding ---------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Huffman code lengths of at most `most` bits; one used symbol has length 1."""
    out, used = np.zeros(len(counts), dtype=np.int64), counts.nonzero()[0]
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    weights = counts[used].astype(np.int64)
    while True:
        order = np.argsort(weights, kind="stable")
        leaves = weights[order].tolist()
        # two queues: leaves by weight, and inner nodes, which are made in order of weight
        inner: list[int] = []
        parent = [0] * (2 * n - 1)
        i = j = 0
        for node in range(n, 2 * n - 1):
            total = 0
            for _ in range(2):
                if j >= len(inner) or (i < n and leaves[i] <= inner[j]):
                    total, child, i = total + leaves[i], i, i + 1
                else:
                    total, child, j = total + inner[j], n + j, j + 1
                parent[child] = node
            inner.append(total)
        depth = [0] * (2 * n - 1)
        for node in range(2 * n - 3, -1, -1):
            depth[node] = depth[parent[node]] + 1
        out[used[order]] = depth[:n]
        if out.max() <= most:
            return out
        weights = (weights + 1) // 2


class _Writer:
    """Bits, least significant first."""

    def __init__(self):
        self.held, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.held |= value << self.n
        self.n += n

    def all(self, value: np.ndarray, size: np.ndarray) -> None:
        """One value after another, each of at most 32 bits."""
        ends = np.cumsum(size)
        at = ends - size
        total = int(ends[-1]) if len(ends) else 0
        wide = value << (at & 31)
        # no two values share a bit, so sums (exact below 2 ** 53) are unions
        words = np.bincount(at >> 5, wide & 0xFFFFFFFF, total // 32 + 2) + np.bincount((at >> 5) + 1, wide >> 32, total // 32 + 2)
        self.put(int.from_bytes(words.astype("<u4").tobytes(), "little"), total)

    def data(self) -> bytes:
        return self.held.to_bytes(-(-self.n // 8), "little")


def _runs(lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """Code lengths as (symbol, extra bits, extra value)."""
    out, last = [], 8
    for value, same in groupby(lengths.tolist()):
        run = len(list(same))
        while run:
            if value == 0 and run >= 3:
                k = min(run, 138)
                out.append((18, 7, k - 11) if k > 10 else (17, 3, k - 3))
            elif value and value == last and run >= 3:
                k = min(run, 6)
                out.append((16, 2, k - 3))
            else:
                k = 1
                out.append((value, 0, 0))
                last = value or last
            run -= k
    return out


def _write_code(w: _Writer, lengths: np.ndarray) -> None:
    used = lengths.nonzero()[0]
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        symbols = [int(s) for s in used] or [0]
        w.put(1, 1)
        w.put(len(symbols) - 1, 1)
        w.put(1, 1)
        for s in symbols:
            w.put(s, 8)
        return
    runs = _runs(lengths)
    of_runs = code_lengths(np.bincount([r[0] for r in runs], minlength=19), 7)
    kept = max(4, 1 + max(i for i, s in enumerate(LENGTH_CODE_ORDER) if of_runs[s]))
    w.put(0, 1)
    w.put(kept - 4, 4)
    for s in LENGTH_CODE_ORDER[:kept]:
        w.put(int(of_runs[s]), 3)
    w.put(0, 1)
    value, size = (x.tolist() for x in prefix_codes(of_runs))
    for s, extra, rest in runs:
        w.put(value[s] | rest << size[s], size[s] + extra)


def _to_prefix(value: int) -> tuple[int, int, int]:
    """(symbol, extra bits, extra value) of a length or distance code."""
    if value <= 4:
        return value - 1, 0, 0
    value -= 1
    top = value.bit_length() - 1
    second = value >> (top - 1) & 1
    return 2 * top + second, top - 1, value - ((2 + second) << (top - 1))


def _write_image(w: _Writer, pixels: np.ndarray, width: int, main: bool, *, references: bool = False, cache_bits: int = 0) -> None:
    """An entropy-coded image of uint32 pixels with one group of codes."""
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(0, 1)
    tokens: list[tuple[int, ...]] = []
    seen: dict[tuple[int, ...], int] = {}
    values = [int(p) for p in pixels]
    cache = [None] * (1 << cache_bits) if cache_bits else []
    near = {max(1, dx + dy * width): i + 1 for i, (dx, dy) in reversed(list(enumerate(near_offsets())))}
    at = 0
    while at < len(values):
        length, key = 0, tuple(values[at : at + 3])
        if references and len(key) == 3 and key in seen:
            start = seen[key]
            while at + length < len(values) and length < 4096 and values[start + length] == values[at + length]:
                length += 1
        slot = (CACHE_FACTOR * values[at] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if length >= 3:
            d = at - start
            tokens.append((-1, length, near.get(d, d + 120)))
        elif cache_bits and cache[slot] == values[at]:
            tokens.append((-2, slot))
            length = 1
        else:
            tokens.append((values[at],))
            length = 1
        for i in range(at, at + length):
            if len(values) - i >= 3:
                seen[tuple(values[i : i + 3])] = i
            if cache_bits:
                cache[(CACHE_FACTOR * values[i] & 0xFFFFFFFF) >> (32 - cache_bits)] = values[i]
        at += length
    counts = [np.zeros(n, dtype=np.int64) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)]
    for t in tokens:
        if t[0] == -1:
            counts[0][256 + _to_prefix(t[1])[0]] += 1
            counts[4][_to_prefix(t[2])[0]] += 1
        elif t[0] == -2:
            counts[0][280 + t[1]] += 1
        else:
            for c, shift in enumerate((8, 16, 0, 24)):
                counts[c][t[0] >> shift & 255] += 1
    lengths = [code_lengths(c, 15) for c in counts]
    codes = []
    for n in lengths:
        _write_code(w, n)
        codes.append(list(zip(*(x.tolist() for x in prefix_codes(n)), strict=True)))
    for t in tokens:
        if t[0] == -1:
            for group, value, base in ((0, t[1], 256), (4, t[2], 0)):
                symbol, extra, rest = _to_prefix(value)
                w.put(*codes[group][base + symbol])
                w.put(rest, extra)
        elif t[0] == -2:
            w.put(*codes[0][280 + t[1]])
        else:
            for c, shift in enumerate((8, 16, 0, 24)):
                w.put(*codes[c][t[0] >> shift & 255])


def _container(stream: bytes) -> bytes:
    body = b"WEBP" + b"VP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _start(w: _Writer, width: int, height: int) -> None:
    if not (1 <= width <= MAX_SIDE and 1 <= height <= MAX_SIDE):
        raise ValueError("a side is out of range")
    for value, n in ((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(value, n)


def encode(pixels: np.ndarray, *, predictor: int | None = None, cross: tuple[int, int, int] | None = None, subtract_green: bool = False, palette: bool = False, references: bool = True, cache_bits: int = 0, size_bits: int = 3) -> bytes:
    """A WebP file of pixels [height, width, 4], with Huffman codes and the transforms asked for.

    predictor: one of the 14 modes for all tiles; cross: (red to blue, green to blue, green to red).
    """
    height, width, _ = pixels.shape
    image, w = np.ascontiguousarray(pixels, dtype=np.uint8), _Writer()
    _start(w, width, height)

    def tiles(values: tuple[int, int, int, int]) -> None:
        w.put(size_bits - 2, 3)
        across, down = (image.shape[1] + (1 << size_bits) - 1) >> size_bits, (height + (1 << size_bits) - 1) >> size_bits
        _write_image(w, _packed(np.tile(np.array(values, np.uint8), (across * down, 1))), across, False)

    if palette:
        table, index = np.unique(_packed(image), return_inverse=True)
        if len(table) > 256:
            raise ValueError("a palette holds 256 colours at most")
        w.put(1, 1)
        w.put(COLOUR_INDEXING, 2)
        w.put(len(table) - 1, 8)
        c = _channels(table)
        _write_image(w, _packed(np.diff(c, axis=0, prepend=np.zeros((1, 4), np.uint8))), len(table), False)
        image = _bundled(index.reshape(height, width), len(table))
    if predictor is not None:
        w.put(1, 1)
        w.put(PREDICTOR, 2)
        tiles((255, 0, predictor, 0))
        modes = np.full(((height >> size_bits) + 1, (image.shape[1] >> size_bits) + 1), predictor)
        image = _predictions(image.astype(np.int16), modes, size_bits, None).astype(np.uint8)
    if cross is not None:
        w.put(1, 1)
        w.put(CROSS_COLOUR, 2)
        values = (255, *(v & 255 for v in cross))
        tiles(values)
        image = _cross(image, np.tile(np.array(values, np.uint8), ((height >> size_bits) + 1, (image.shape[1] >> size_bits) + 1, 1)), size_bits, -1)
    if subtract_green:
        w.put(1, 1)
        w.put(SUBTRACT_GREEN, 2)
        image = image.copy()
        image[..., 1] -= image[..., 2]
        image[..., 3] -= image[..., 2]
    w.put(0, 1)
    _write_image(w, _packed(image), image.shape[1], True, references=references, cache_bits=cache_bits)
    return _container(w.data())


def _bundled(index: np.ndarray, colours: int) -> np.ndarray:
    """Palette indexes [height, width] as pixels whose green holds one or more of them."""
    pack = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    per, each = 1 << pack, 8 >> pack
    wide = -(-index.shape[1] // per)
    full = np.zeros((index.shape[0], wide * per), dtype=np.int64)
    full[:, : index.shape[1]] = index
    green = (full.reshape(index.shape[0], wide, per) << (np.arange(per) * each)).sum(axis=2)
    out = np.zeros((*green.shape, 4), np.uint8)
    out[..., 0], out[..., 2] = 255, green
    return out


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, numbers of extra bits and extra bits of lengths or distance codes."""
    less = np.maximum(values - 1, 0)
    top = np.frexp(np.maximum(less, 1).astype(np.float64))[1].astype(np.int64) - 1
    second = (less >> np.maximum(top - 1, 0)) & 1
    extra = np.where(values <= 4, 0, top - 1)
    return np.where(values <= 4, less, 2 * top + second), extra, np.where(values <= 4, 0, less - ((2 + second) << np.maximum(top - 1, 0)))


def _entropy(*images: np.ndarray) -> list[float]:
    """Bits of a value of each image; all are of one size."""
    n = np.bincount(np.concatenate([x.ravel() + np.int64(256 * i) for i, x in enumerate(images)]), minlength=256 * len(images))
    share = np.maximum(n, 1) / images[0].size
    return (-(n / images[0].size * np.log2(share)).reshape(len(images), 256).sum(axis=1)).tolist()


def back_references(flat: np.ndarray, literal_bits: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, distance) of references that do not overlap, in order: at each place the last one before it with
    the same four samples is looked at, and taken if it saves bits."""
    none = np.zeros(0, np.int64)
    n = len(flat) - 3
    if n < 2:
        return none, none, none
    x = flat.astype(np.uint32)
    key = x[:-3] | x[1:-2] << 8 | x[2:-1] << 16 | x[3:] << 24
    placed = key.astype(np.uint64) << np.uint64(32) | np.arange(n, dtype=np.uint64)  # sorted by key, then place
    placed.sort()
    order, key = (placed & np.uint64(0xFFFFFFFF)).astype(np.int64), placed >> np.uint64(32)
    back = np.zeros(n, np.int64)
    back[order[1:]] = np.where(key[1:] == key[:-1], order[1:] - order[:-1], 0)
    edge = np.append(True, back[1:] != back[:-1])
    ends = np.append(edge.nonzero()[0][1:], n)
    length = np.minimum(ends[np.cumsum(edge) - 1] - np.arange(n) + 3, 4096)
    good = ((back > 0) & (back < (1 << 20) - 120)).nonzero()[0]
    good = good[length[good] * literal_bits > 12 + np.log2(back[good])]
    after, chosen, k = np.searchsorted(good, good + length[good]).tolist(), [], 0
    while k < len(good):
        chosen.append(k)
        k = after[k]
    start = good[chosen]
    return start, length[start], back[start]


def _write_grey(w: _Writer, green: np.ndarray, width: int, alpha: int) -> None:
    """The main image, of pixels whose green alone differs: Huffman codes and back-references, one group of codes."""
    start, length, distance = back_references(green, max(_entropy(green)[0], 0.5))
    symbol = green.astype(np.int16)
    inside = np.bincount(start, minlength=len(green) + 1) - np.bincount(start + length, minlength=len(green) + 1)
    covered = np.cumsum(inside[:-1]) > 0
    near = _near_codes(width)
    code = np.where(distance < len(near), near[np.minimum(distance, len(near) - 1)], 0)
    code = np.where(code > 0, code, distance + 120)
    (run, far), (run_n, far_n), (run_extra, far_extra) = (x.reshape(2, -1) for x in _prefixes(np.concatenate([length, code])))
    symbol[start] = 256 + run
    covered[start] = False
    token = (~covered).nonzero()[0]
    symbol = symbol[token]
    ref = np.searchsorted(token, start)
    lengths = [code_lengths(np.bincount(symbol, minlength=280), 12), code_lengths(np.bincount(far, minlength=40), 12)]
    w.put(0, 2)  # no colour cache, which would only rename greens; one group of codes
    _write_code(w, lengths[0])
    for value in (0, 0, alpha):  # red, blue, alpha
        w.put(0b101 | value << 3, 11)
    _write_code(w, lengths[1])
    codes = [prefix_codes(n) for n in lengths]
    for low in range(0, len(token), 1 << 18):  # a bounded stretch of bits at a time
        high = min(low + (1 << 18), len(token))
        a, b = np.searchsorted(ref, (low, high))
        value, size = np.zeros((high - low, 2), np.int64), np.zeros((high - low, 2), np.int64)
        value[:, 0], size[:, 0] = codes[0][0][symbol[low:high]], codes[0][1][symbol[low:high]]
        at = ref[a:b] - low
        value[at, 0] |= run_extra[a:b] << size[at, 0]  # 22 bits at most
        size[at, 0] += run_n[a:b]
        head = codes[1][1][far[a:b]]
        value[at, 1], size[at, 1] = codes[1][0][far[a:b]] | far_extra[a:b] << head, head + far_n[a:b]  # 30 at most
        w.all(value.ravel(), size.ravel())


def encode_grey(samples: np.ndarray) -> bytes:
    """A WebP file of grey samples [height, width] uint8: Huffman codes and back-references.

    Up to 16 different samples are put in a palette and bundled; otherwise red and blue are taken off by the
    subtract-green transform, and the left or the upper sample is predicted if its differences take fewer bits. The
    cross-colour transform has nothing to do where red and blue are 0, and a colour cache would only rename greens.
    """
    height, width = samples.shape
    w = _Writer()
    _start(w, width, height)
    table = np.bincount(samples.ravel(), minlength=256).nonzero()[0]
    w.put(1, 1)
    if len(table) <= 16:
        w.put(COLOUR_INDEXING, 2)
        w.put(len(table) - 1, 8)
        grey = np.column_stack([np.full(len(table), 255), table, table, table]).astype(np.uint8)
        _write_image(w, _packed(np.diff(grey, axis=0, prepend=np.zeros((1, 4), np.uint8))), len(table), False)
        place = np.zeros(256, dtype=np.int64)
        place[table] = np.arange(len(table))
        green = _bundled(place[samples], len(table))[..., 2]
    else:
        w.put(SUBTRACT_GREEN, 2)
        left, above = np.diff(samples, axis=1, prepend=samples[:, :1]), np.diff(samples, axis=0, prepend=samples[:1])
        # the first row is always told from the left, the first column from above
        left[1:, 0], left[0, 0] = np.diff(samples[:, 0]), samples[0, 0]
        above[0] = left[0]
        bits = _entropy(samples, left, above)
        mode = int(np.argmin(bits))
        if mode and (bits[0] - bits[mode]) * samples.size > 256:
            w.put(1, 1)
            w.put(PREDICTOR, 2)
            w.put(7, 3)  # tiles of 512 samples
            tiles = -(-width // 512) * -(-height // 512)
            _write_image(w, _packed(np.tile(np.array((255, 0, mode, 0), np.uint8), (tiles, 1))), -(-width // 512), False)
            samples = (left, above)[mode - 1]
            alpha = True
        else:
            alpha = False
        green = samples
    w.put(0, 1)  # no more transforms
    _write_grey(w, np.ascontiguousarray(green).ravel(), green.shape[1], 0 if len(table) > 16 and alpha else 255)
    return _container(w.data())
