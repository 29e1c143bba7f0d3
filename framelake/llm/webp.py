"""Lossless WebP (VP8L, RFC 9649) in Python and numpy.

``decode`` reads any conforming image: prefix codes, meta prefix codes, back-references, colour cache, and the predictor,
cross-colour, subtract-green and palette transforms.  ``decode_gray_many`` reads many images at once, one lane each, where
only the green and distance codes carry information; all others go through ``decode``.
``encode_gray`` writes 8-bit samples as grey pixels in the smallest of the forms it knows: subtract-green, a predictor after
it, or a palette, each with back-references and a colour cache where they save bits.  Cross-colour is read, not written: on
grey pixels it removes what subtract-green removes and needs an image of its own for that.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

import numpy as np

SIGNATURE, LITERALS, LENGTH_CODES, DISTANCE_CODES = 0x2F, 256, 24, 40
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
BLACK = 0xFF000000
# fixed values of the format
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_MULTIPLIER = 0x1E35A7BD
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


class FormatError(ValueError):
    """The bytes are no conforming lossless WebP image."""


class Bits:
    """Bits of a stream, lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def read(self, n: int) -> int:
        at = self.at
        self.at = at + n
        if self.at > self.end:
            raise FormatError("the stream ends early")
        return int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7) & ((1 << n) - 1)


_FLIPPED = [int(f"{k:015b}"[::-1], 2) for k in range(1 << 15)]


def canonical(lengths: list[int]) -> list[int]:
    """Codes of the given lengths, reversed so that the lowest bit comes first."""
    out, code, last = [0] * len(lengths), 0, 0
    for n, symbol in sorted((n, symbol) for symbol, n in enumerate(lengths) if n):
        code, last = code << (n - last), n
        out[symbol] = _FLIPPED[code] >> (15 - n)
        code += 1
    return out


class PrefixCode:
    """Symbols by (length, code); a code with one symbol takes no bits."""

    def __init__(self, lengths: list[int]):
        used = [s for s, n in enumerate(lengths) if n]
        self.lengths, self.only = lengths, used[0] if len(used) == 1 else None
        if not used:
            self.only = 0
        self.used, self.sizes = used, sorted({lengths[s] for s in used})
        self.table: dict[tuple[int, int], int] = {}
        if self.only is None and sum(1 << (15 - lengths[s]) for s in used) != 1 << 15:
            raise FormatError("a prefix code is not complete")

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        if not self.table:
            codes = canonical(self.lengths)
            self.table = {(self.lengths[s], codes[s]): s for s in self.used}
        data, at = bits.data, bits.at
        window = int.from_bytes(data[at >> 3 : (at >> 3) + 3], "little") >> (at & 7)
        for n in self.sizes:
            symbol = self.table.get((n, window & ((1 << n) - 1)))
            if symbol is not None:
                bits.at = at + n
                if bits.at > bits.end:
                    raise FormatError("the stream ends early")
                return symbol
        raise FormatError("no such code")


@lru_cache(maxsize=64)
def _step_code(steps: tuple[int, ...]) -> list[tuple[int, int]]:
    """(bits, symbol) for every window of seven bits, the longest code of a code length."""
    code = PrefixCode(list(steps))
    if code.only is not None:
        return [(0, code.only)] * 128
    codes, out = canonical(code.lengths), [(0, 0)] * 128
    for s in code.used:
        n = code.lengths[s]
        for w in range(codes[s], 128, 1 << n):
            out[w] = n, s
    return out


def read_code(bits: Bits, alphabet: int) -> PrefixCode:
    lengths = [0] * alphabet
    if bits.read(1):  # one or two symbols stated outright
        two, wide = bits.read(1), bits.read(1)
        found = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        for s in found:
            if s >= alphabet:
                raise FormatError("a symbol is beyond the alphabet")
            lengths[s] = 1
        return PrefixCode(lengths)
    steps = [0] * 19
    for k in range(4 + bits.read(4)):
        steps[CODE_LENGTH_ORDER[k]] = bits.read(3)
    code, most = _step_code(tuple(steps)), alphabet
    if bits.read(1):
        most = 2 + bits.read(2 + 2 * bits.read(3))
        if most > alphabet:
            raise FormatError("more lengths than symbols")
    at, last = 0, 8
    for _ in range(most):
        if at >= alphabet:
            break
        place = bits.at
        used, step = code[int.from_bytes(bits.data[place >> 3 : (place >> 3) + 2], "little") >> (place & 7) & 127]
        bits.at = place + used
        if bits.at > bits.end:
            raise FormatError("the stream ends early")
        if step < 16:
            lengths[at] = step
            last, at = step or last, at + 1
            continue
        n, value = (3 + bits.read(2), last) if step == 16 else (3 + bits.read(3), 0) if step == 17 else (11 + bits.read(7), 0)
        if at + n > alphabet:
            raise FormatError("a run of lengths is too long")
        lengths[at : at + n] = [value] * n
        at += n
    return PrefixCode(lengths)


def _extended(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _blocks(n: int, size_bits: int) -> int:
    return (n + (1 << size_bits) - 1) >> size_bits


def read_groups(bits: Bits, width: int, height: int, top: bool) -> tuple[int, int, list[int] | None, list[list[PrefixCode]]]:
    """(cache bits, block bits, group of each block or None, the five codes of each group)."""
    cache = bits.read(4) if bits.read(1) else 0
    if cache > 11:
        raise FormatError("the colour cache is too large")
    size_bits, owner, n = 0, None, 1
    if top and bits.read(1):
        size_bits = bits.read(3) + 2
        owner = [p >> 8 & 0xFFFF for p in read_image(bits, _blocks(width, size_bits), _blocks(height, size_bits), False)]
        n = max(owner) + 1
    sizes = (LITERALS + LENGTH_CODES + (1 << cache if cache else 0), 256, 256, 256, DISTANCE_CODES)
    return cache, size_bits, owner, [[read_code(bits, a) for a in sizes] for _ in range(n)]


def read_image(bits: Bits, width: int, height: int, top: bool) -> list[int]:
    """The ARGB pixels of an entropy-coded image, row by row."""
    return read_pixels(bits, width, height, *read_groups(bits, width, height, top))


def read_pixels(bits: Bits, width: int, height: int, cache: int, size_bits: int, owner: list[int] | None, groups: list[list[PrefixCode]]) -> list[int]:
    total, pixels, recent = width * height, [], [0] * (1 << cache)
    across, codes, kept = _blocks(width, size_bits), groups[0], 0
    while (at := len(pixels)) < total:
        if owner is not None:
            codes = groups[owner[(at // width >> size_bits) * across + (at % width >> size_bits)]]
        symbol = codes[0].read(bits)
        if symbol < LITERALS:
            red, blue, alpha = codes[1].read(bits), codes[2].read(bits), codes[3].read(bits)
            pixels.append(alpha << 24 | red << 16 | symbol << 8 | blue)
        elif symbol < LITERALS + LENGTH_CODES:
            n = _extended(bits, symbol - LITERALS)
            code = _extended(bits, codes[4].read(bits))
            back = code - len(NEAR)
            if back < 1:
                dx, dy = NEAR[code - 1]
                back = max(1, dx + dy * width)
            if back > at or at + n > total:
                raise FormatError("a reference leaves the image")
            if back >= n:
                pixels += pixels[at - back : at - back + n]
            else:
                pixels += (pixels[at - back :] * (n // back + 1))[:n]
        else:
            while kept < at:
                recent[(CACHE_MULTIPLIER * pixels[kept] & 0xFFFFFFFF) >> (32 - cache)] = pixels[kept]
                kept += 1
            pixels.append(recent[symbol - LITERALS - LENGTH_CODES])
    return pixels


def _channels(pixels: np.ndarray) -> np.ndarray:
    """uint32 ARGB to int32 with a last axis of alpha, red, green, blue."""
    return np.stack([(pixels >> np.uint32(s) & np.uint32(255)).astype(np.int32) for s in (24, 16, 8, 0)], axis=-1)


def _packed(channels: np.ndarray) -> np.ndarray:
    c = (channels & 255).astype(np.uint32)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def _predict(mode: int, left: list[int], up: list[int], right: list[int], corner: list[int]) -> list[int]:
    """A pixel's prediction from its neighbours: left, top, top-right and top-left."""
    half = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    clamp = lambda x: 0 if x < 0 else 255 if x > 255 else x
    if mode in (1, 2, 3, 4):
        return (left, up, right, corner)[mode - 1]
    if mode == 5:
        return half(half(left, right), up)
    if mode in (6, 7, 8, 9):
        return half(*((left, corner), (left, up), (corner, up), (up, right))[mode - 6])
    if mode == 10:
        return half(half(left, corner), half(up, right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(up, corner, strict=True))
        to_up = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if to_left < to_up else up
    if mode == 12:
        return [clamp(a + b - c) for a, b, c in zip(left, up, corner, strict=True)]
    if mode == 13:
        return [clamp(a + int((a - c) / 2)) for a, c in zip(half(left, up), corner, strict=True)]
    return [255, 0, 0, 0]


def invert_predictor(pixels: np.ndarray, modes: np.ndarray, size_bits: int) -> np.ndarray:
    height, width = pixels.shape
    rest, out = _channels(pixels).tolist(), []
    for y in range(height):
        row: list[list[int]] = []
        above = out[y - 1] if y else None
        for x in range(width):
            if above is None:
                guess = row[x - 1] if x else [255, 0, 0, 0]
            elif not x:
                guess = above[0]
            else:  # right of the last column stands the first pixel of the row itself
                guess = _predict(int(modes[y >> size_bits, x >> size_bits]), row[x - 1], above[x], above[x + 1] if x + 1 < width else row[0], above[x - 1])
            row.append([(a + b) & 255 for a, b in zip(rest[y][x], guess, strict=True)])
        out.append(row)
    return _packed(np.array(out, dtype=np.int32))


def invert_cross_colour(pixels: np.ndarray, elements: np.ndarray, size_bits: int) -> np.ndarray:
    height, width = pixels.shape
    signed = lambda a: ((a & 255) ^ 128) - 128
    e = signed(_channels(elements))[np.arange(height)[:, None] >> size_bits, np.arange(width)[None, :] >> size_bits]
    c = _channels(pixels)
    green = signed(c[..., 2])
    c[..., 1] = c[..., 1] + (e[..., 3] * green >> 5) & 255
    c[..., 3] = c[..., 3] + (e[..., 2] * green >> 5) + (e[..., 1] * signed(c[..., 1]) >> 5) & 255
    return _packed(c)


def invert_subtract_green(pixels: np.ndarray) -> np.ndarray:
    c = _channels(pixels)
    c[..., 1] += c[..., 2]
    c[..., 3] += c[..., 2]
    return _packed(c)


def invert_palette(pixels: np.ndarray, table: np.ndarray, width: int, width_bits: int) -> np.ndarray:
    green = (pixels >> np.uint32(8) & np.uint32(255)).astype(np.int64)
    per, depth = 1 << width_bits, 8 >> width_bits
    if width_bits:
        green = (green[:, :, None] >> (np.arange(per) * depth) & ((1 << depth) - 1)).reshape(len(green), -1)[:, :width]
    padded = np.zeros(256, dtype=np.uint32)  # indices beyond the table are transparent black
    padded[: len(table)] = table
    return padded[green]


def vp8l_data(data: bytes) -> bytes:
    """The image chunk of a RIFF file."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise FormatError("no simple lossless WebP file")
    size = int.from_bytes(data[16:20], "little")
    if len(data) < 20 + size:
        raise FormatError("the file ends early")
    return data[20 : 20 + size]


def _header(bits: Bits) -> tuple[int, int, int, list[tuple]]:
    """(width, height, coded width, transforms); ``bits`` stands before the main image afterwards."""
    if bits.read(8) != SIGNATURE:
        raise FormatError("the signature is missing")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise FormatError("unknown version")
    coded, transforms = width, []
    while bits.read(1):
        kind = bits.read(2)
        if kind in {t[0] for t in transforms}:
            raise FormatError("a transform comes twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            size_bits = bits.read(3) + 2
            w, h = _blocks(coded, size_bits), _blocks(height, size_bits)
            transforms.append((kind, np.array(read_image(bits, w, h, False), dtype=np.uint32).reshape(h, w), size_bits))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            steps = _channels(np.array(read_image(bits, n, 1, False), dtype=np.uint32))
            width_bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, _packed(np.cumsum(steps, axis=0)), coded, width_bits))
            coded = _blocks(coded, width_bits)
        else:
            transforms.append((kind,))
    return width, height, coded, transforms


def decode(data: bytes) -> np.ndarray:
    """The image of a lossless WebP file as uint32 ARGB, (height, width)."""
    bits = Bits(vp8l_data(data))
    _, height, coded, transforms = _header(bits)
    pixels = np.array(read_image(bits, coded, height, True), dtype=np.uint32).reshape(height, coded)
    return _restore(pixels, transforms)


def _restore(pixels: np.ndarray, transforms: list[tuple]) -> np.ndarray:
    for kind, *rest in reversed(transforms):
        if kind == PREDICTOR:
            pixels = invert_predictor(pixels, rest[0] >> np.uint32(8) & np.uint32(255), rest[1])
        elif kind == CROSS_COLOUR:
            pixels = invert_cross_colour(pixels, *rest)
        elif kind == PALETTE:
            pixels = invert_palette(pixels, *rest)
        else:
            pixels = invert_subtract_green(pixels)
    return pixels


# --- many grey images at once ---------------------------------------------------------------------------------------

LANE_BITS, DISTANCE_BITS = 11, 7  # codes up to these lengths are looked up in one step
LANE_PIXELS, ROUND = 1 << 23, 32  # pixels decoded at once; steps after which finished lanes drop out
LENGTHS_MOST, COPY = 4096, 1 << 24  # the longest copy; what marks a copy in a lane's table
# of each prefix of a length or distance the value it starts from, its extra bits and their mask
_EXTRA = np.array([max(0, p - 2) >> 1 for p in range(DISTANCE_CODES)])
_BASE = np.array([p + 1 if p < 4 else ((2 + (p & 1)) << (p - 2 >> 1)) + 1 for p in range(DISTANCE_CODES)])
_MASK = (1 << _EXTRA) - 1


def _reversal(bits: int) -> np.ndarray:
    out = np.zeros(1, dtype=np.int64)
    for k in range(bits):
        out = np.concatenate((out, out + (1 << (bits - 1 - k))))
    return out


_REVERSED = {n: _reversal(n) for n in (LANE_BITS, DISTANCE_BITS)}


def _lane_table(code: PrefixCode, bits: int) -> np.ndarray:
    """length << 16 | symbol for every window of ``bits`` bits."""
    if code.only is not None:
        return np.full(1 << bits, code.only, dtype=np.int32)
    n = np.array(code.lengths)
    used = np.flatnonzero(n)
    used = used[np.argsort(n[used], kind="stable")]
    entries = np.where(used < LITERALS, used, used - LITERALS | COPY) if bits == LANE_BITS else used
    return np.repeat((n[used] << 16 | entries).astype(np.int32), 1 << (bits - n[used]))[_REVERSED[bits]]


@lru_cache(maxsize=8)
def _near_backs(width: int) -> np.ndarray:
    return np.array([max(1, dx + dy * width) for dx, dy in NEAR], dtype=np.int64)


def decode_gray_many(files: list[bytes], lanes: int = 4096) -> list[np.ndarray]:
    """The green samples of each file, flat.  Lanes advance by one symbol a step; copies are resolved when all are read."""
    out: list[np.ndarray | None] = [None] * len(files)
    ready = []
    for k, data in enumerate(files):
        bits = Bits(vp8l_data(data))
        _, height, coded, transforms = _header(bits)
        groups = read_groups(bits, coded, height, True)
        green, *others, distance = groups[3][0]
        plain = groups[0] == 0 and groups[2] is None and all(t == (SUBTRACT_GREEN,) for t in transforms) and all(c.only is not None for c in others)
        if plain and green.only is not None and green.only < LITERALS:
            out[k] = np.full(coded * height, green.only, dtype=np.uint8)
        elif plain and green.only is None and max(green.lengths) <= LANE_BITS and max(distance.lengths) <= DISTANCE_BITS:
            ready.append((coded, coded * height, k, bits.data, bits.at, green, distance))
        else:
            pixels = np.array(read_pixels(bits, coded, height, *groups), dtype=np.uint32).reshape(height, coded)
            out[k] = (_restore(pixels, transforms) >> np.uint32(8)).astype(np.uint8).ravel()
    ready.sort(key=lambda r: (r[0], -r[1]))
    first = 0
    while first < len(ready):
        last, held = first, 0
        while last < len(ready) and last - first < lanes and ready[last][0] == ready[first][0] and (last == first or held + ready[last][1] <= LANE_PIXELS):
            held += ready[last][1]
            last += 1
        part, first = ready[first:last], last
        for r, samples in zip(part, _decode_lanes(part), strict=True):
            out[r[2]] = samples
    return out


def _decode_lanes(part: list[tuple]) -> list[np.ndarray]:
    """The samples of files of one width."""
    near, sizes = _near_backs(part[0][0]), np.array([r[1] for r in part])
    greens = np.concatenate([_lane_table(r[5], LANE_BITS) for r in part])
    distances = np.concatenate([_lane_table(r[6], DISTANCE_BITS) for r in part])
    # 49 bits at least from any place: a copy's codes and extra bits; the zeros are for what a broken lane reads in a round
    stream = np.frombuffer(b"".join(r[3] for r in part) + bytes(8 * ROUND), dtype=np.uint8).astype(np.int64)
    windows = sum(stream[k : len(stream) - 6 + k] << 8 * k for k in range(7))
    ends = np.cumsum([len(r[3]) for r in part])
    at = (ends - [len(r[3]) for r in part]) * 8 + [r[4] for r in part]
    # a place behind each lane's pixels takes what finished lanes write until they drop out
    ends, begin, lane = ends * 8, np.cumsum(sizes + 1) - sizes - 1, np.arange(len(part))
    to, stop = begin.copy(), begin + sizes
    literal = np.empty(int(stop[-1]) + LENGTHS_MOST, dtype=np.uint8)  # room for a copy that leaves the image
    back = np.full(len(literal), -1, dtype=np.int32)  # of the first pixel of each symbol; 0: a literal
    table, table2 = lane << LANE_BITS, lane << DISTANCE_BITS
    while len(at):
        for _ in range(ROUND):
            going = to < stop
            window = windows[at >> 3] >> (at & 7)
            entry = greens[table + (window & ((1 << LANE_BITS) - 1))]
            literal[to] = entry
            back[to] = 0
            at += (entry >> 16 & 255) * going
            c = np.flatnonzero(entry >= COPY)
            if len(c) and len(c := c[going[c]]):
                e, here = entry[c], to[c]
                prefix, rest = e & 255, window[c] >> (e >> 16 & 255)
                n, used = _BASE[prefix] + (rest & _MASK[prefix]), _EXTRA[prefix]
                rest >>= used
                e = distances[table2[c] + (rest & ((1 << DISTANCE_BITS) - 1))]
                prefix, rest = e & 255, rest >> (e >> 16)
                far = _BASE[prefix] + (rest & _MASK[prefix]) - len(NEAR)
                far = np.where(far > 0, far, near[np.minimum(far, 0) - 1])  # codes up to 120 count from the end of the table
                back[here] = far
                at[c] += used + (e >> 16) + _EXTRA[prefix]
                to[c] += n - 1
            to += going
        if np.any(at > ends):
            raise FormatError("the stream ends early")
        if np.any(to > stop):
            raise FormatError("a reference leaves the image")
        keep = to < stop
        if not keep.all():
            at, to, stop, ends, table, table2 = (x[keep] for x in (at, to, stop, ends, table, table2))
    back[begin + sizes] = 0  # so that the last symbol of a lane ends before it
    heads = np.flatnonzero(back >= 0)
    if np.any(heads - back[heads] < begin[np.searchsorted(begin, heads, side="right") - 1]):
        raise FormatError("a reference leaves the image")
    source = np.arange(len(back), dtype=np.int32) - np.repeat(back[heads], np.diff(heads, append=len(back)))
    while True:  # copies of copies, in as many rounds as the chain's length has bits
        further = source[source]
        if np.array_equal(further, source):
            break
        source = further
    samples = literal[source]
    return [samples[a : a + n] for a, n in zip(begin, sizes, strict=True)]


# --- writing --------------------------------------------------------------------------------------------------------

# a complete code for the code lengths themselves: 13 symbols of four bits, six of five
STEP_LENGTHS = [4, 5, 5, *[4] * 10, 5, 5, 5, 5, 4, 4]
STEP_CODES = canonical(STEP_LENGTHS)


def code_lengths(counts: np.ndarray, most: int = LANE_BITS) -> list[int]:
    """Huffman code lengths of at most ``most`` bits; counts are flattened until the longest code fits."""
    counts = counts.tolist()
    lengths = [0] * len(counts)
    order = sorted((k for k, n in enumerate(counts) if n), key=counts.__getitem__)
    weights, m = [counts[k] for k in order], len(order)
    if m == 1:
        lengths[order[0]] = 1
        return lengths
    while True:
        # leaves and joined nodes are both in order of weight, so the least is the head of one of them
        nodes, parent, leaf, joined = weights[:], [0] * (2 * m - 1), 0, m
        for new in range(m, 2 * m - 1):
            weight = 0
            for _ in range(2):
                if leaf < m and (joined == new or nodes[leaf] <= nodes[joined]):
                    weight += nodes[leaf]
                    parent[leaf] = new
                    leaf += 1
                else:
                    weight += nodes[joined]
                    parent[joined] = new
                    joined += 1
            nodes.append(weight)
        depth = [0] * (2 * m - 1)
        for node in range(2 * m - 3, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth[:m]) <= most:
            for k, n in zip(order, depth, strict=False):
                lengths[k] = n
            return lengths
        weights = [(n + 1) // 2 for n in weights]


def write_lengths(lengths: list[int], alphabet: int) -> tuple[int, int]:
    """(value, bits) of a prefix code's description."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and used[-1] < 256:
        value, bits = 1 | (len(used) - 1) << 1 | 1 << 2 | used[0] << 3, 11
        return (value | used[1] << 11, 19) if len(used) == 2 else (value, bits)
    value, bits = 15 << 1, 5
    for k in CODE_LENGTH_ORDER:
        value |= STEP_LENGTHS[k] << bits
        bits += 3
    bits += 1  # all symbols of the alphabet are described
    at, padded = 0, lengths + [0] * (alphabet - len(lengths))
    while at < alphabet:
        n = padded[at]
        run = 1
        if not n:
            while at + run < alphabet and not padded[at + run] and run < 138:
                run += 1
        step, extra, width = (n, 0, 0) if run < 3 else (17, run - 3, 3) if run < 11 else (18, run - 11, 7)
        value |= (STEP_CODES[step] | extra << STEP_LENGTHS[step]) << bits
        bits += STEP_LENGTHS[step] + width
        at += run if step > 16 else 1
    return value, bits


def riff(stream: bytes) -> bytes:
    padded = stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + (12 + len(padded)).to_bytes(4, "little") + b"WEBPVP8L" + len(stream).to_bytes(4, "little") + padded


LEAST_SAVING = 32  # a cache or a predictor is used if it saves one bit of so many
PREDICTORS = (1, 2, 7)  # left, top and their mean
ALPHA = {False: 255, True: 0}  # what all alphas are, of pixels and of differences to a prediction


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix codes, extra bits, their values) of lengths or distances."""
    v = values - 1
    top = np.frexp(v.astype(np.float64))[1] - 1  # place of the highest bit
    extra = np.where(v < 4, 0, top - 1)
    return np.where(v < 4, v, 2 * extra + (v >> extra)), extra, np.where(v < 4, 0, v & ((1 << extra) - 1))


@lru_cache(maxsize=8)
def _near_codes(width: int) -> np.ndarray:
    """The code of each distance up to the largest of a near pixel; one more beyond."""
    backs = _near_backs(width)
    out = np.arange(backs.max() + 2) + len(NEAR)
    for k in range(len(NEAR) - 1, -1, -1):
        out[backs[k]] = k + 1
    return out


def _entropy(counts: np.ndarray) -> float:
    """Bits of so many symbols, one each at least, and about what their code's description takes."""
    c = counts[counts > 0].astype(np.float64)
    n = float(c.sum())
    return max(n, n * float(np.log2(n)) - float(c @ np.log2(c))) + 5 * len(c) if len(c) > 1 else 11.0


def _references(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, distances) of symbols: a literal has length 1 and distance 0, else four values or more occurred before."""
    n = len(values)
    if n < 8:
        return np.arange(n), np.ones(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    grams = np.ndarray((n - 3,), dtype="<u4", buffer=np.ascontiguousarray(values), strides=(1,))
    key = grams.astype(np.uint64)
    key <<= np.uint64(28)
    key |= np.arange(n - 3, dtype=np.uint64)
    key.sort()
    place = key.view(np.int64) & ((1 << 28) - 1)
    key >>= np.uint64(28)
    again = np.flatnonzero(key[1:] == key[:-1])
    d, places = np.zeros(n - 3, dtype=np.int64), place[again + 1]
    d[places] = places - place[again]
    d[d > (1 << 20) - len(NEAR)] = 0
    ends = np.append(np.flatnonzero(d[1:] != d[:-1]) + 1, n - 3)
    length = np.repeat(ends + 3, np.diff(ends, prepend=0))  # ends of matches: equal distances in a row are one
    good = np.flatnonzero(d)
    length = np.minimum(length[good] - good, LENGTHS_MOST)
    far = d[good]
    chosen = np.flatnonzero(length >= 4 + (far > 128) + (far > 2048))
    good, length, far = good[chosen], length[chosen], far[chosen]
    places, jumps, taken, k, m = good.tolist(), length.tolist(), [], 0, len(good)
    while k < m:  # the first match at or behind the end of the last
        taken.append(k)
        k = bisect_left(places, places[k] + jumps[k], k)
    at, n_copied = good[taken], length[taken]
    begun = np.zeros(n + 1, dtype=np.int64)
    begun[at + 1] += 1
    begun[at + n_copied] -= 1
    starts = np.flatnonzero(np.cumsum(begun[:n]) == 0)
    lengths, distances = np.ones(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    lengths[at], distances[at] = n_copied, far[taken]
    return starts, lengths[starts], distances[starts]


class _Form:
    """Green symbols of an image, with references where these take fewer bits, and the bits in all."""

    def __init__(self, values: np.ndarray, width: int, alpha: int = 255):
        self.values, self.cache = values, 0
        plain = _entropy(np.bincount(values, minlength=LITERALS))
        starts, lengths, distances = _references(values)
        copies = np.flatnonzero(distances)
        near, far = _near_codes(width), distances[copies]
        codes = np.where(far < len(near), near[np.minimum(far, len(near) - 1)], far + len(NEAR))
        length, distance = _prefixes(lengths[copies]), _prefixes(codes)
        symbols = values[starts].astype(np.int64)
        symbols[copies] = LITERALS + length[0]
        self.bits = _entropy(np.bincount(symbols)) + _entropy(np.bincount(distance[0])) + float(length[1].sum() + distance[1].sum()) if len(copies) else plain
        if plain <= self.bits:
            starts, copies, symbols, self.bits = np.arange(len(values)), copies[:0], values.astype(np.int64), plain
            length = distance = (copies, copies, copies)
        self.starts, self.copies, self.symbols, self.length, self.distance = starts, copies, symbols, length, distance
        self._take_cache(alpha)

    def _take_cache(self, alpha: int) -> None:
        """Takes a colour cache if most pixels are literals and those that it holds are written in clearly fewer bits."""
        if 4 * (len(self.symbols) - len(self.copies)) < 3 * len(self.values):
            return
        taken = np.ones(len(self.symbols), dtype=bool)
        taken[self.copies] = False
        bits = 4
        slot = ((CACHE_MULTIPLIER * (alpha << 24 | np.arange(256) << 8) & 0xFFFFFFFF) >> (32 - bits)).astype(np.uint8)[self.values]
        order = np.argsort(slot, kind="stable")
        hit = np.zeros(len(self.values), dtype=bool)  # the last pixel of this slot was of this colour
        hit[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (self.values[order[1:]] == self.values[order[:-1]])
        taken &= hit[self.starts]
        if 2 * np.count_nonzero(taken) < len(taken):
            return
        symbols = np.where(taken, LITERALS + LENGTH_CODES + slot[self.starts].astype(np.int64), self.symbols)
        saved = _entropy(np.bincount(self.symbols)) - _entropy(np.bincount(symbols))
        if saved > self.bits / LEAST_SAVING:
            self.symbols, self.cache, self.bits = symbols, bits, self.bits - saved


def _smooth(samples: np.ndarray, width: int, plain: float) -> bool:
    """Whether neighbours differ by so little that differences may take fewer bits than the samples."""
    s = samples.astype(np.int16)
    steps = [np.abs(s[k:] - s[:-k]).mean() for k in (1, width) if len(s) > k]
    return bool(steps) and float(np.log2(2 * np.e * min(steps) + 1)) * len(s) < plain


def _residuals(samples: np.ndarray, width: int, mode: int) -> np.ndarray:
    """Samples less what the mode predicts; the first row is predicted from the left, the first column from above."""
    s = samples.reshape(-1, width).astype(np.int16)
    guess = np.zeros_like(s)
    guess[0, 1:], guess[1:, 0] = s[0, :-1], s[:-1, 0]
    left, top = s[1:, :-1], s[:-1, 1:]
    guess[1:, 1:] = left if mode == 1 else top if mode == 2 else (left + top) >> 1
    return (s - guess).astype(np.uint8).ravel()


class _Stream:
    def __init__(self):
        self.value = self.bits = 0

    def put(self, *fields: tuple[int, int]) -> None:
        for value, bits in fields:
            self.value |= value << self.bits
            self.bits += bits

    def put_many(self, values: np.ndarray, widths: np.ndarray) -> None:
        """Fields of at most 32 bits."""
        used = widths > 0
        if not used.any():
            return
        values, widths = values[used], widths[used]
        at = self.bits + np.cumsum(widths) - widths
        code = values.astype(np.uint64) << (at & 31).astype(np.uint64)
        words = int(at[-1] >> 5) + 2
        low = np.bincount(at >> 5, (code & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
        high = np.bincount((at >> 5) + 1, (code >> np.uint64(32)).astype(np.float64), words)
        self.value |= int.from_bytes((low + high).astype("<u4").tobytes(), "little")
        self.bits = int(at[-1] + widths[-1])


ONLY_ZERO = (0b0001, 4)


def _only(symbol: int) -> tuple[int, int]:
    return 0b101 | symbol << 3, 11


def _coded(symbols: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, widths) of the symbols; a code of one symbol takes no bits."""
    n = np.array(lengths) if sum(map(bool, lengths)) > 1 else np.zeros(len(lengths), dtype=np.int64)
    return np.array(canonical(lengths), dtype=np.int64)[symbols], n[symbols]


def _put_palette(out: _Stream, shades: np.ndarray) -> None:
    steps = np.diff(shades.astype(np.int64), prepend=0) & 255
    alphas = np.array([255] + [0] * (len(shades) - 1))
    out.put((1 | PALETTE << 1, 3), (len(shades) - 1, 8), (0, 1))
    fields = []
    for symbols, alphabet in ((steps, LITERALS + LENGTH_CODES), (steps, 256), (steps, 256), (alphas, 256)):
        lengths = code_lengths(np.bincount(symbols, minlength=256))
        out.put(write_lengths(lengths, alphabet))
        fields.append(_coded(symbols, lengths))
    out.put(ONLY_ZERO)
    out.put_many(*(np.stack([f[k] for f in fields], axis=1).ravel() for k in (0, 1)))


def encode_gray(samples: np.ndarray, width: int) -> bytes:
    """A lossless WebP file of grey pixels; the number of samples is a multiple of ``width``."""
    height = len(samples) // width
    counts = np.bincount(samples, minlength=256)
    form, kind, extra = _Form(samples, width), SUBTRACT_GREEN, 0
    shades = np.flatnonzero(counts)
    if 1 < len(shades) <= 16:
        width_bits = 3 if len(shades) <= 2 else 2 if len(shades) <= 4 else 1
        per, coded = 1 << width_bits, _blocks(width, width_bits)
        index = np.zeros((height, coded * per), dtype=np.uint8)
        index[:, :width] = np.searchsorted(shades, samples).reshape(height, width)
        packed = (index.reshape(height, coded, per) << (np.arange(per, dtype=np.uint8) * (8 >> width_bits))).sum(axis=2).astype(np.uint8).ravel()
        other = _Form(packed, coded)
        if other.bits + 60 + 16 * len(shades) < form.bits:
            form, kind = other, PALETTE
    plain = _entropy(counts)
    for mode in PREDICTORS if _smooth(samples, width, plain) else ():
        rest = _residuals(samples, width, mode)
        if _entropy(np.bincount(rest, minlength=256)) < plain:
            other = _Form(rest, width, ALPHA[True])
            if other.bits + 40 < form.bits * (1 - 1 / LEAST_SAVING):
                form, kind, extra = other, PREDICTOR, mode

    out = _Stream()
    out.put((SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (0, 1), (0, 3))
    if kind == PALETTE:
        _put_palette(out, shades)
    else:
        out.put((1 | SUBTRACT_GREEN << 1, 3))
    if kind == PREDICTOR:  # one mode in blocks of the largest size
        out.put((1 | PREDICTOR << 1, 3), (7, 3), (0, 1), _only(extra), ONLY_ZERO, ONLY_ZERO, _only(255), ONLY_ZERO)
    out.put((0, 1), (1 | form.cache << 1, 5) if form.cache else (0, 1), (0, 1))  # no further transform, the cache, one group of codes
    alphabet = LITERALS + LENGTH_CODES + (1 << form.cache if form.cache else 0)
    lengths = code_lengths(np.bincount(form.symbols, minlength=256))
    far = code_lengths(np.bincount(form.distance[0]), DISTANCE_BITS) if len(form.copies) else []
    out.put(write_lengths(lengths, alphabet), ONLY_ZERO, ONLY_ZERO, _only(ALPHA[kind == PREDICTOR]), write_lengths(far, DISTANCE_CODES) if far else ONLY_ZERO)
    # of each symbol its code, then of a copy the rest of the length, the distance's code and its rest
    values, widths = np.zeros((2, len(form.symbols), 4), dtype=np.int64)
    values[:, 0], widths[:, 0] = _coded(form.symbols, lengths)
    if far:
        values[form.copies, 1], widths[form.copies, 1] = form.length[2], form.length[1]
        values[form.copies, 2], widths[form.copies, 2] = _coded(form.distance[0], far)
        values[form.copies, 3], widths[form.copies, 3] = form.distance[2], form.distance[1]
    out.put_many(values.ravel(), widths.ravel())
    return riff(out.value.to_bytes((out.bits + 7) // 8, "little"))
