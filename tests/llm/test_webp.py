"""The lossless WebP decoder against streams with every feature, written here."""

import random

import numpy as np
import pytest

from framelake.llm import webp


class Writer:
    def __init__(self):
        self.value = self.bits = 0

    def put(self, value, bits):
        self.value |= value << self.bits
        self.bits += bits

    def done(self):
        return self.value.to_bytes((self.bits + 7) // 8, "little")


def prefix(value):
    """(prefix code, extra bits, extra value) of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    extra = (value - 1).bit_length() - 2
    half = (value - 1) >> extra
    return 2 * extra + half, extra, (value - 1) & ((1 << extra) - 1)


def tokens(pixels, width, cache):
    out, recent, k = [], {}, 0
    slot = lambda p: (webp.CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> (32 - cache)
    while k < len(pixels):
        best = (0, 0)
        for back in {1, 2, width, width + 1, 3 * width} | ({130} if k >= 130 else set()):
            n = 0
            while back <= k and k + n < len(pixels) and n < 300 and pixels[k + n] == pixels[k + n - back]:
                n += 1
            best = max(best, (n, back))
        if best[0] >= 3:
            n, back = best
            out.append(("copy", n, back))
        elif cache and recent.get(slot(pixels[k])) == pixels[k]:
            n = 1
            out.append(("cache", slot(pixels[k]), 0))
        else:
            n = 1
            out.append(("pixel", pixels[k], 0))
        if cache:
            for p in pixels[k : k + n]:
                recent[slot(p)] = p
        k += n
    return out


def distance_code(back, width):
    near = [max(1, dx + dy * width) for dx, dy in webp.NEAR]
    return near.index(back) + 1 if back in near else back + 120


def image(w, pixels, width, cache, top):
    w.put(1 if cache else 0, 1)
    if cache:
        w.put(cache, 4)
    if top:
        w.put(0, 1)
    toks = tokens(pixels, width, cache)
    counts = [np.zeros(n, dtype=np.int64) for n in (256 + 24 + (1 << cache if cache else 0), 256, 256, 256, 40)]
    plan = []
    for kind, a, b in toks:
        if kind == "pixel":
            step = [(0, a >> 8 & 255), (1, a >> 16 & 255), (2, a & 255), (3, a >> 24)]
            extra = [(0, 0)] * 4
        elif kind == "cache":
            step, extra = [(0, 280 + a)], [(0, 0)]
        else:
            (c1, n1, v1), (c2, n2, v2) = prefix(a), prefix(distance_code(b, width))
            step, extra = [(0, 256 + c1), (4, c2)], [(v1, n1), (v2, n2)]
        for code, symbol in step:
            counts[code][symbol] += 1
        plan.append((step, extra))
    lengths = []
    for c in counts:
        if not c.any():
            c[0] = 1
        n = webp.code_lengths(c, 15)
        lengths.append(n)
        w.put(*webp.write_lengths(n, len(n)))
    codes = [webp.canonical(n) for n in lengths]
    single = [sum(map(bool, n)) == 1 for n in lengths]
    for step, extra in plan:
        for (code, symbol), (v, n) in zip(step, extra, strict=True):
            if not single[code]:
                w.put(codes[code][symbol], lengths[code][symbol])
            w.put(v, n)


def write(pixels, transforms=(), cache=0):
    """``transforms`` in the order of the stream; each is (kind, how to apply it)."""
    height, width = pixels.shape
    w = Writer()
    w.put(webp.SIGNATURE, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    data = pixels.copy()
    for kind, arg in transforms:
        w.put(1, 1)
        w.put(kind, 2)
        if kind == webp.PREDICTOR:
            size = 2
            w.put(size - 2, 3)
            rows, cols = -(-data.shape[0] // 4), -(-data.shape[1] // 4)
            modes = np.array([[(r * cols + c + arg) % 14 for c in range(cols)] for r in range(rows)])
            image(w, [int(m) << 8 for m in modes.ravel()], cols, 0, False)
            zero = webp.invert_predictor(np.zeros((1, 1), np.uint32), modes[:1, :1], size)
            assert int(zero[0, 0]) == 0xFF000000
            data = residuals(data, modes)
        elif kind == webp.CROSS_COLOUR:
            w.put(0, 3)
            rows, cols = -(-data.shape[0] // 4), -(-data.shape[1] // 4)
            rng = random.Random(arg)
            e = np.array([[rng.getrandbits(24) | 0xFF000000 for _ in range(cols)] for _ in range(rows)], dtype=np.uint32)
            image(w, [int(x) for x in e.ravel()], cols, 0, False)
            data = cross(data, e)
        elif kind == webp.SUBTRACT_GREEN:
            c = webp._channels(data)
            c[..., 1] -= c[..., 2]
            c[..., 3] -= c[..., 2]
            data = webp._packed(c)
        else:
            table = np.unique(data)
            w.put(len(table) - 1, 8)
            c = webp._channels(table)
            image(w, [int(x) for x in webp._packed(np.diff(c, axis=0, prepend=0))], len(table), 0, False)
            index = np.searchsorted(table, data)
            bits = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
            per = 1 << bits
            packed = np.zeros((len(data), -(-data.shape[1] // per)), dtype=np.int64)
            for x in range(data.shape[1]):
                packed[:, x // per] |= index[:, x] << (x % per * (8 >> bits))
            data = (packed << 8).astype(np.uint32)
    w.put(0, 1)
    image(w, [int(p) for p in data.ravel()], data.shape[1], cache, True)
    return webp.riff(w.done())


def residuals(data, modes):
    c = webp._channels(data).tolist()
    out = np.zeros((*data.shape, 4), dtype=np.int32)
    for y in range(data.shape[0]):
        for x in range(data.shape[1]):
            if y == 0:
                guess = c[0][x - 1] if x else [255, 0, 0, 0]
            elif x == 0:
                guess = c[y - 1][0]
            else:
                right = c[y - 1][x + 1] if x + 1 < data.shape[1] else c[y][0]
                guess = webp._predict(int(modes[y >> 2, x >> 2]), c[y][x - 1], c[y - 1][x], right, c[y - 1][x - 1])
            out[y, x] = [a - b for a, b in zip(c[y][x], guess, strict=True)]
    return webp._packed(out)


def cross(data, e):
    signed = lambda v: (int(v) & 255 ^ 128) - 128
    c, out = webp._channels(data), webp._channels(data)
    k = webp._channels(e)
    for y in range(data.shape[0]):
        for x in range(data.shape[1]):
            _, rb, gb, gr = k[y >> 2, x >> 2]
            green = signed(c[y, x, 2])
            out[y, x, 1] -= signed(gr) * green >> 5
            out[y, x, 3] -= (signed(gb) * green >> 5) + (signed(rb) * signed(c[y, x, 1]) >> 5)
    return webp._packed(out)


def noise(seed, height, width, colours=None):
    rng = random.Random(seed)
    pool = [rng.getrandbits(32) for _ in range(colours)] if colours else None
    rows = [[rng.choice(pool) if pool else (rng.getrandbits(8) * 0x010101 | 0xFF000000) for _ in range(width)] for _ in range(height)]
    rows[height // 2] = rows[0][:]
    return np.array(rows, dtype=np.uint32)


@pytest.mark.parametrize("cache", [0, 1, 5, 11])
def test_copies_and_cache(cache):
    for seed in range(3):
        p = noise(seed, 9, 13, 6)
        assert np.array_equal(webp.decode(write(p, cache=cache)), p)


@pytest.mark.parametrize("transforms", [
    [(webp.PREDICTOR, 0)], [(webp.PREDICTOR, 5)], [(webp.CROSS_COLOUR, 1)], [(webp.SUBTRACT_GREEN, 0)],
    [(webp.PREDICTOR, 3), (webp.CROSS_COLOUR, 2), (webp.SUBTRACT_GREEN, 0)], [(webp.SUBTRACT_GREEN, 0), (webp.PREDICTOR, 7)],
])
def test_transforms(transforms):
    for seed in range(3):
        p = noise(seed, 11, 15)
        assert np.array_equal(webp.decode(write(p, transforms, cache=4)), p)


@pytest.mark.parametrize("colours", [1, 2, 4, 16, 40])
def test_palettes(colours):
    p = noise(colours, 7, 21, colours)
    assert np.array_equal(webp.decode(write(p, [(webp.PALETTE, 0)])), p)


def test_predictor_modes_literally():
    left, up, right, corner = [255, 10, 20, 30], [255, 40, 50, 60], [255, 70, 80, 90], [255, 15, 45, 200]
    want = {0: [255, 0, 0, 0], 1: left, 2: up, 3: right, 4: corner, 5: [255, 40, 50, 60], 6: [255, 12, 32, 115], 7: [255, 25, 35, 45], 8: [255, 27, 47, 130], 9: [255, 55, 65, 75], 10: [255, 33, 48, 95], 12: [255, 35, 25, 0], 13: [255, 30, 30, 0]}
    for mode, guess in want.items():
        assert webp._predict(mode, left, up, right, corner) == guess


def test_lanes_and_whole_decoder_agree():
    rng = np.random.default_rng(1)
    files = [webp.encode_gray(rng.integers(0, rng.integers(1, 256), 64 * int(rng.integers(1, 40)), dtype=np.uint8), 64) for _ in range(60)]
    files.append(write(noise(1, 5, 8), [(webp.PREDICTOR, 2)], cache=3))
    for f, lane in zip(files, webp.decode_gray_many(files, lanes=16), strict=True):
        whole = webp.decode(f)
        assert np.array_equal((whole >> 8).astype(np.uint8).ravel(), lane)
    grey = webp.decode(files[0])
    assert np.array_equal(grey >> 16 & 255, grey & 255)


def steps_of(data):
    """Transforms, whether there is a cache, and whether pixels are copied."""
    bits = webp.Bits(webp.vp8l_data(data))
    _, height, coded, transforms = webp._header(bits)
    cache, _, _, groups = webp.read_groups(bits, coded, height, True)
    return [t[0] for t in transforms], cache > 0, any(groups[0][0].lengths[256:280])


def test_the_writer_takes_every_step_where_it_saves_bits():
    rng = np.random.default_rng(5)
    text = (" ".join(f"the {w} of the {w}" for w in rng.integers(0, 900, 200))).encode()[: 64 * 30]
    slot = np.array([(webp.CACHE_MULTIPLIER * (0xFF000000 | g << 8) & 0xFFFFFFFF) >> 28 for g in range(256)])
    pools = [[int(np.flatnonzero(slot == k)[turn]) for k in np.unique(slot) if (slot == k).sum() > 5] for turn in range(6)]
    made = {
        "copies": np.frombuffer(text, dtype=np.uint8),
        "predictor": (np.cumsum(rng.integers(-2, 3, 64 * 60)) + 100 & 255).astype(np.uint8),
        "palette": (rng.random(64 * 60) < 0.1).astype(np.uint8) * 9 + 65,
        "cache": np.concatenate([rng.choice(p, 64 * 20) for p in pools]).astype(np.uint8),
    }
    files = {k: webp.encode_gray(v, 64) for k, v in made.items()}
    for (k, v), lane in zip(made.items(), webp.decode_gray_many(list(files.values())), strict=True):
        assert np.array_equal(lane, v), k
        whole = webp.decode(files[k])
        assert np.array_equal(whole.ravel(), 0xFF000000 | v.astype(np.uint32) * 0x010101), k
    assert steps_of(files["copies"])[2]
    assert webp.PREDICTOR in steps_of(files["predictor"])[0]
    assert steps_of(files["palette"])[0] == [webp.PALETTE]
    assert steps_of(files["cache"])[1]


@pytest.mark.parametrize("width", [1, 5, 64, 200])
def test_written_images_of_all_widths_come_back(width):
    rng = np.random.default_rng(width)
    for height in (1, 2, 9, 300):
        for colours in (1, 2, 4, 16, 17, 256):
            a = rng.integers(0, colours, width * height, dtype=np.uint8) * (255 // colours)
            a[len(a) // 2 :] = a[: len(a) - len(a) // 2]
            f = webp.encode_gray(a, width)
            assert np.array_equal(webp.decode_gray_many([f])[0], a) and np.array_equal((webp.decode(f) & 255).ravel(), a)


def test_broken_copies_are_no_image():
    text = np.frombuffer((b"abcdefgh" * 40 + b"ijkl" * 16)[:320], dtype=np.uint8)
    f = webp.encode_gray(text, 64)
    assert steps_of(f)[2]
    short = webp.riff(webp.vp8l_data(f)[:-2])
    with pytest.raises(webp.FormatError):
        webp.decode_gray_many([short, webp.encode_gray(np.tile(text, 9), 64)])


def test_broken_files():
    f = webp.encode_gray(np.arange(64, dtype=np.uint8), 64)
    for bad in (b"", f[:30], b"RIFX" + f[4:], f[:20] + b"\0" + f[21:]):
        with pytest.raises(webp.FormatError):
            webp.decode(bad)
