"""Lossless WebP: a decoder of the whole bitstream format for single images, in Python and NumPy.

decode() reads prefix codes (simple and normal), meta prefix groups, back-references, the colour cache, and inverts the
predictor, cross-colour, subtract-green and palette transforms. webp_encoder writes images, webp_lanes decodes many of
them together.

Pixels are arrays (height, width, 4) of red, green, blue, alpha.
"""

from __future__ import annotations

import numpy as np

LARGEST = 1 << 14
#: The order of code length codes, and the (x, y) of the 120 short distances.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
LENGTHS, DISTANCES = 24, 40
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
CACHE_HASH = 0x1E35A7BD


class BadStream(ValueError):
    """The bytes are no lossless WebP image."""


class Bits:
    """Reads bits, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def peek(self, n: int) -> int:
        return int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 8], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise BadStream("the stream ends early")
        return value


class Code:
    """A canonical prefix code, by its code lengths; the table to read by is made when it is first needed."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if not len(used):
            raise BadStream("a prefix code without symbols")
        own = lengths[used]
        self.used, self.own = used, own
        self.depth = int(own.max()) if len(used) > 1 else 0
        if len(used) > 1 and int((1 << (self.depth - own.astype(np.int64))).sum()) != 1 << self.depth:
            raise BadStream("an incomplete prefix code")
        self.table: list[tuple[int, int]] = []

    def _fill(self) -> None:
        if not self.depth:
            self.table = [(0, int(self.used[0]))]
            return
        code, before, self.table = 0, 0, [(0, 0)] * (1 << self.depth)
        for n, symbol in sorted(zip(self.own.tolist(), self.used.tolist(), strict=True)):
            code <<= n - before
            before = n
            low = int(f"{code:0{n}b}"[::-1], 2)
            self.table[low :: 1 << n] = [(n, symbol)] * (1 << (self.depth - n))
            code += 1

    def read(self, bits: Bits) -> int:
        if not self.table:
            self._fill()
        n, symbol = self.table[bits.peek(self.depth)]
        bits.at += n
        if bits.at > bits.end:
            raise BadStream("the stream ends early")
        return symbol


def _read_code(bits: Bits, size: int) -> Code:
    lengths = np.zeros(size, np.uint8)
    if bits.read(1):  # simple
        two = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    own = np.zeros(len(LENGTH_ORDER), np.uint8)
    for i in range(4 + bits.read(4)):
        own[LENGTH_ORDER[i]] = bits.read(3)
    code = Code(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, previous = 0, 8
    while at < size and left:
        left -= 1
        n = code.read(bits)
        if n < 16:
            lengths[at] = n
            at += 1
            previous = n or previous
            continue
        times = 3 + bits.read(2) if n == 16 else 3 + bits.read(3) if n == 17 else 11 + bits.read(7)
        if at + times > size:
            raise BadStream("too many code lengths")
        if n == 16:
            lengths[at : at + times] = previous
        at += times
    return Code(lengths)


def _value(bits: Bits, symbol: int) -> int:
    """A length or distance from its prefix symbol."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as flat ARGB numbers."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise BadStream("a colour cache of that size")
    meta, shift, across = None, 0, 0
    if main and bits.read(1):
        shift = bits.read(3) + 2
        across = -(-width >> shift)
        meta = (_read_image(bits, across, -(-height >> shift), False) >> 8 & 0xFFFF).tolist()
    cache_size = 1 << cache_bits if cache_bits else 0
    groups = [[_read_code(bits, n) for n in (256 + LENGTHS + cache_size, 256, 256, 256, DISTANCES)] for _ in range(max(meta) + 1 if meta else 1)]
    total, out, x, y = width * height, [], 0, 0
    cache = [0] * cache_size
    green, red, blue, alpha, distance = groups[0]
    while len(out) < total:
        if meta is not None:
            y, x = divmod(len(out), width)
            green, red, blue, alpha, distance = groups[meta[(y >> shift) * across + (x >> shift)]]
        symbol = green.read(bits)
        if symbol < 256:
            r, b = red.read(bits), blue.read(bits)
            new = [alpha.read(bits) << 24 | r << 16 | symbol << 8 | b]
        elif symbol < 256 + LENGTHS:
            length = _value(bits, symbol - 256)
            back = _value(bits, distance.read(bits))
            if back > 120:
                back -= 120
            else:
                dx, dy = NEAR[back - 1]
                back = max(1, dx + dy * width)
            if back > len(out) or len(out) + length > total:
                raise BadStream("a reference outside the image")
            start = len(out) - back
            new = [out[start + k % back] for k in range(length)]
        else:
            new = [cache[symbol - 256 - LENGTHS]]
        out += new
        if cache_size:
            for p in new:
                cache[(CACHE_HASH * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
    return np.array(out, np.uint32)


def turned(n: int) -> np.ndarray:
    """The numbers below 2**n with their n bits in reverse."""
    out = np.zeros(1, np.uint32)
    for _ in range(n):
        out = np.concatenate((out << 1, out << 1 | 1))
    return out


def channels(argb: np.ndarray) -> np.ndarray:
    """Alpha, red, green, blue of each number."""
    return argb.astype(">u4").view(np.uint8).reshape(-1, 4)


def numbers(pixels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(pixels, np.uint8).view(">u4").reshape(-1).astype(np.uint32)


def _average(a, b):
    return tuple((x + y) >> 1 for x, y in zip(a, b, strict=True))


def _predict(mode: int, left, top, right, corner):
    """The prediction of a pixel by its neighbours: left, above, above right, above left."""
    match mode:
        case 1:
            return left
        case 2:
            return top
        case 3:
            return right
        case 4:
            return corner
        case 5:
            return _average(_average(left, right), top)
        case 6:
            return _average(left, corner)
        case 7:
            return _average(left, top)
        case 8:
            return _average(corner, top)
        case 9:
            return _average(top, right)
        case 10:
            return _average(_average(left, corner), _average(top, right))
        case 11:
            # The one nearer to left + top - corner is the one whose opposite differs more from the corner.
            near_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
            near_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
            return left if near_left < near_top else top
        case 12:
            return tuple(min(255, max(0, x + t - c)) for x, t, c in zip(left, top, corner, strict=True))
        case 13:
            return tuple(min(255, max(0, a + int((a - c) / 2))) for a, c in zip(_average(left, top), corner, strict=True))
    return (255, 0, 0, 0)


def invert_predictor(argb: np.ndarray, width: int, height: int, modes: np.ndarray, shift: int) -> np.ndarray:
    rows = channels(argb).reshape(height, width, 4).tolist()
    across = -(-width >> shift)
    kinds = (modes >> 8 & 15).tolist()
    above: list = []
    for y, row in enumerate(rows):
        for x in range(width):
            if y == 0:
                guess = row[x - 1] if x else (255, 0, 0, 0)
            elif x == 0:
                guess = above[0]
            else:
                right = above[x + 1] if x + 1 < width else row[0]
                guess = _predict(kinds[(y >> shift) * across + (x >> shift)], row[x - 1], above[x], right, above[x - 1])
            row[x] = tuple((a + b) & 255 for a, b in zip(row[x], guess, strict=True))
        above = row
    return numbers(np.array(rows, np.uint8))


def invert_cross_colour(argb: np.ndarray, width: int, height: int, elements: np.ndarray, shift: int) -> np.ndarray:
    across = -(-width >> shift)
    y, x = np.divmod(np.arange(width * height), width)
    own = channels(elements)[(y >> shift) * across + (x >> shift)].view(np.int8).astype(np.int32)
    pixels = channels(argb).copy()
    delta = lambda factor, channel: factor * channel.view(np.int8).astype(np.int32) >> 5
    green = pixels[:, 2].copy()
    pixels[:, 1] = pixels[:, 1] + delta(own[:, 3], green) & 255
    red = pixels[:, 1].copy()
    pixels[:, 3] = pixels[:, 3] + delta(own[:, 2], green) + delta(own[:, 1], red) & 255
    return numbers(pixels)


def invert_subtract_green(argb: np.ndarray) -> np.ndarray:
    pixels = channels(argb).copy()
    pixels[:, 1] += pixels[:, 2]
    pixels[:, 3] += pixels[:, 2]
    return numbers(pixels)


def subtract_green(argb: np.ndarray) -> np.ndarray:
    pixels = channels(argb).copy()
    pixels[:, 1] -= pixels[:, 2]
    pixels[:, 3] -= pixels[:, 2]
    return numbers(pixels)


def packing(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def invert_palette(argb: np.ndarray, width: int, height: int, table: np.ndarray) -> np.ndarray:
    shift = packing(len(table))
    index = (argb >> 8 & 255).reshape(height, -1)
    if shift:
        each = 8 >> shift
        index = (index[:, :, None] >> (np.arange(1 << shift, dtype=np.uint32) * each) & ((1 << each) - 1)).reshape(height, -1)[:, :width]
    colours = np.zeros(256, np.uint32)
    colours[: len(table)] = table
    return colours[index.reshape(-1)]


def palette(differences: np.ndarray) -> np.ndarray:
    """The colours of a palette's image."""
    return numbers(np.cumsum(channels(differences), axis=0, dtype=np.uint8))


def pack_palette(index: np.ndarray, width: int, height: int, colours: int) -> tuple[np.ndarray, int]:
    """The image of packed indices, and its width."""
    shift = packing(colours)
    each, packed = 8 >> shift, -(-width >> shift)
    rows = np.zeros((height, packed << shift), np.uint32)
    rows[:, :width] = index.reshape(height, width)
    together = (rows.reshape(height, packed, 1 << shift) << (np.arange(1 << shift, dtype=np.uint32) * each)).sum(2, dtype=np.uint32)
    return (np.uint32(0xFF000000) | together << np.uint32(8)).reshape(-1), packed


def stream_of(data: bytes) -> bytes:
    """The stream in a file's container."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise BadStream("not a lossless WebP file")
    size = int.from_bytes(data[16:20], "little")
    if len(data) < 20 + size:
        raise BadStream("the file ends early")
    return data[20 : 20 + size]


def read_header(bits: Bits) -> tuple[int, int]:
    """An image's width and height."""
    if bits.read(8) != 0x2F:
        raise BadStream("wrong signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise BadStream("unknown version")
    return width, height


def finish(argb: np.ndarray, steps: list[tuple], height: int) -> np.ndarray:
    """Invert transforms (kind, width, image, shift), last first; red, green, blue, alpha of each pixel."""
    for kind, own, more, shift in reversed(steps):
        if kind == PREDICTOR:
            argb = invert_predictor(argb, own, height, more, shift)
        elif kind == CROSS_COLOUR:
            argb = invert_cross_colour(argb, own, height, more, shift)
        elif kind == PALETTE:
            argb = invert_palette(argb, own, height, more)
        else:
            argb = invert_subtract_green(argb)
    return channels(argb)[:, [1, 2, 3, 0]]


def decode(data: bytes) -> np.ndarray:
    """The pixels of one lossless WebP file."""
    bits = Bits(stream_of(data))
    width, height = read_header(bits)
    steps, own = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in [s[0] for s in steps]:
            raise BadStream("a transform twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            shift = bits.read(3) + 2
            steps.append((kind, own, _read_image(bits, -(-own >> shift), -(-height >> shift), False), shift))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            steps.append((kind, own, palette(_read_image(bits, n, 1, False)), 0))
            own = -(-own >> packing(n))
        else:
            steps.append((kind, own, None, 0))
    return finish(_read_image(bits, own, height, True), steps, height).reshape(height, width, 4)


def wrap(stream: bytes) -> bytes:
    """A stream in its container."""
    body = b"WEBPVP8L" + len(stream).to_bytes(4, "little") + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + len(body).to_bytes(4, "little") + body
