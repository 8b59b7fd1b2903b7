"""Decoding many lossless WebP images side by side: each step takes one pixel of every image.

A lane is an image's entropy-coded stream. Lanes read their prefix codes, literals, back-references and colour cache in
lockstep, as NumPy operations over all lanes that still have pixels; they are ordered by size, so those are the first
ones. Transforms' own images (palettes, predictor modes, colour elements) are rounds of lanes before the main ones.
Streams with several groups of prefix codes go to the decoder of single images.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from pagemill.llm import webp
from pagemill.llm.webp import BadStream

#: Pixels of one round: steps times lanes.
TOGETHER = 1 << 21
TURNED = webp.turned(15).astype(np.int64)
_LOW = (1 << 15) - 1


class Words:
    """A buffer in which up to 57 bits can be looked at from any bit on."""

    def __init__(self, parts: Sequence[bytes]):
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.first = (np.cumsum(sizes) - sizes) * 8
        self.end = self.first + sizes * 8
        data = b"".join(parts) + bytes(64)
        self.limit = 8 * (len(data) - 16)
        self.at_byte = np.ndarray((len(data) - 8,), "<i8", data, strides=(1,))

    def look(self, at: np.ndarray) -> np.ndarray:
        return self.at_byte[at >> 3] >> (at & 7)


class Table:
    """The prefix codes of several lanes: entries symbol << 4 | length, ordered by code, one stretch a lane."""

    def __init__(self, lengths: np.ndarray):
        lane, symbol = np.nonzero(lengths)
        n = lengths[lane, symbol].astype(np.int64)
        each = np.bincount(lane, minlength=len(lengths))
        if not each.all():
            raise BadStream("a prefix code without symbols")
        depth = np.where(each > 1, lengths.max(1), 0).astype(np.int64)
        n = np.where(each[lane] > 1, n, 0)
        order = np.argsort(lane * 16 + n, kind="stable")
        share = 1 << (depth[lane] - n)
        if (np.bincount(lane, share, len(lengths)) != 1 << depth).any():
            raise BadStream("an incomplete prefix code")
        self.entry = np.repeat((symbol << 4 | n)[order], share[order])
        self.first = np.cumsum(1 << depth) - (1 << depth)
        self.drop = 15 - depth

    def read(self, bits: np.ndarray, lanes: np.ndarray | slice) -> np.ndarray:
        return self.entry[self.first[lanes] + (TURNED[bits & _LOW] >> self.drop[lanes])]


def _codes(words: Words, at: np.ndarray, size: np.ndarray) -> Table:
    """The next prefix code of each lane, over alphabets of the given sizes; at moves on."""
    lengths = np.zeros((len(at), int(size.max())), np.uint8)
    look = words.look(at)
    simple = np.flatnonzero(look & 1)
    if len(simple):
        v = look[simple]
        two, wide = v >> 1 & 1, v >> 2 & 1
        first = np.where(wide, v >> 3 & 255, v >> 3 & 1)
        rest = v >> np.where(wide, 11, 4)
        lengths[simple, first] = 1
        pair = two > 0
        lengths[simple[pair], rest[pair] & 255] = 1
        at[simple] += np.where(wide, 11, 4) + 8 * two
    normal = np.flatnonzero(look & 1 == 0)
    if not len(normal):
        return Table(lengths)
    count = 4 + (look[normal] >> 1 & 15)
    at[normal] += 5
    look = words.look(at[normal])
    own = np.zeros((len(normal), 19), np.uint8)
    for i, s in enumerate(webp.LENGTH_ORDER):
        own[:, s] = np.where(i < count, look >> 3 * i & 7, 0)
    at[normal] += 3 * count
    table = Table(own)
    look = words.look(at[normal])
    some = look & 1
    bits = 2 + 2 * (look >> 1 & 7)
    left = np.where(some, 2 + (look >> 4 & ((1 << bits) - 1)), size[normal])
    at[normal] += np.where(some, 4 + bits, 1)
    # The lengths, one item of each lane at a time.
    open_ = np.arange(len(normal))
    place, before, here, most = np.zeros(len(normal), np.int64), np.full(len(normal), 8), at[normal], size[normal]
    while True:
        open_ = open_[(place[open_] < most[open_]) & (left[open_] > 0)]
        if not len(open_):
            break
        here_ = here[open_]
        look = words.look(np.minimum(here_, words.limit))
        entry = table.read(look, open_)
        n, kind = entry & 15, entry >> 4
        look >>= n
        times = np.where(kind < 16, 1, np.where(kind == 18, 11 + (look & 127), 3 + (look & np.where(kind == 16, 3, 7))))
        here[open_] = here_ + n + np.where(kind < 16, 0, np.where(kind == 16, 2, np.where(kind == 17, 3, 7)))
        value = np.where(kind < 16, kind, np.where(kind == 16, before[open_], 0))
        if (place[open_] + times > most[open_]).any():
            raise BadStream("too many code lengths")
        fill = np.flatnonzero(value > 0)
        if len(fill):
            k = times[fill]
            row = np.repeat(fill, k)
            lengths[normal[open_[row]], place[open_[row]] + np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)] = value[row]
            literal = fill[kind[fill] < 16]
            before[open_[literal]] = value[literal]
        place[open_] += times
        left[open_] -= 1
    at[normal] = here
    return Table(lengths)


def _values(words: Words, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Lengths or distances from prefix symbols; at moves on."""
    n = np.where(symbol < 4, 0, (symbol - 2) >> 1)
    extra = words.look(at) & ((1 << n) - 1)
    at += n
    return np.where(symbol < 4, symbol + 1, ((2 + (symbol & 1)) << n) + extra + 1)


_NEAR_X, _NEAR_Y = np.array(webp.NEAR).T


def read_images(words: Words, at: np.ndarray, width: np.ndarray, height: np.ndarray, end: np.ndarray, main: bool) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each lane's pixels as ARGB numbers, where its bits end, and which lanes have several groups of codes (no pixels)."""
    order = np.argsort(-(width * height), kind="stable")
    at, width, total, end = at[order].copy(), width[order], (width * height)[order], end[order]
    look = words.look(at)
    cache_bits = np.where(look & 1, look >> 1 & 15, 0)
    if (cache_bits > 11).any() or (look & 31 == 1).any():
        raise BadStream("a colour cache of that size")
    at += 1 + 4 * (look & 1)
    several = np.zeros(len(at), bool)
    if main:
        several = (words.look(at) & 1).astype(bool)
        at += 1
    mine = np.flatnonzero(~several)
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(at)
    begin = 0
    while begin < len(mine):
        lanes = mine[begin : begin + max(1, TOGETHER // int(total[mine[begin]]))]
        found, at[lanes] = _read(words, at[lanes], width[lanes], total[lanes], cache_bits[lanes])
        for lane, pixels in zip(lanes.tolist(), found, strict=True):
            out[order[lane]] = pixels
        begin += len(lanes)
    if (at > end).any():
        raise BadStream("the stream ends early")
    ends, group = np.empty_like(at), np.empty_like(several)
    ends[order], group[order] = at, several
    return out, ends, group


def _read(words: Words, at: np.ndarray, width: np.ndarray, total: np.ndarray, cache_bits: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    lanes = len(at)
    at = at.copy()
    caches = np.where(cache_bits > 0, 1 << cache_bits, 0)
    green, red, blue, alpha, distance = (_codes(words, at, size) for size in (256 + webp.LENGTHS + caches, *(np.full(lanes, n) for n in (256, 256, 256, webp.DISTANCES))))
    wide = (60 - green.drop - red.drop - blue.drop - alpha.drop).max() > 57  # one look isn't enough for a pixel
    steps = int(total[0])
    pixels = np.zeros((steps, lanes), np.int64)
    flat = pixels.reshape(-1)
    active = lanes - np.searchsorted(total[::-1], np.arange(steps), side="right")
    left, back = np.zeros(lanes, np.int64), np.ones(lanes, np.int64)
    most = int(caches.max())
    cache, cache_first, cache_drop = np.zeros(max(1, most) * lanes, np.int64), np.arange(lanes) * most, 32 - cache_bits
    each = np.arange(lanes)
    for step in range(steps):
        n = int(active[step])
        now = slice(0, n)
        at_ = at[now]
        look = words.look(at_)
        entry = green.read(look, now)
        used, symbol = entry & 15, entry >> 4
        rest = look >> used
        entry = red.read(rest, now)
        value = symbol << 8 | entry >> 4 << 16
        more = entry & 15
        rest >>= more
        entry = blue.read(rest, now)
        value |= entry >> 4
        last = entry & 15
        if wide:
            rest = words.look(at_ + used + more + last)
        else:
            rest >>= last
        entry = alpha.read(rest, now)
        value |= entry >> 4 << 24
        size = used + more + last + (entry & 15)
        copying = left[now] > 0
        odd = np.flatnonzero((symbol > 255) & ~copying)
        if len(odd):
            kind = symbol[odd]
            size[odd] = used[odd]
            held = kind >= 256 + webp.LENGTHS
            hit = odd[held]
            if len(hit):
                value[hit] = cache[cache_first[hit] + kind[held] - 256 - webp.LENGTHS]
            new = odd[~held]
            if len(new):
                here = at_[new] + used[new]
                length = _values(words, here, kind[~held] - 256)
                entry = distance.read(words.look(here), new)
                here += entry & 15
                far = _values(words, here, entry >> 4)
                near = np.minimum(far, 120) - 1
                far = np.where(far > 120, far - 120, np.maximum(1, _NEAR_X[near] + _NEAR_Y[near] * width[new]))
                if (far > step).any() or (length > total[new] - step).any():
                    raise BadStream("a reference outside the image")
                left[new], back[new] = length, far
                size[new] = here - at_[new]
                copying[new] = True
                still = copying.copy()
                still[new] = False
                size[still] = 0
            else:
                size[copying] = 0
        else:
            size[copying] = 0
        again = np.flatnonzero(copying)
        if len(again):
            value[again] = flat[(step - back[again]) * lanes + again]
            left[again] -= 1
        at_ += size
        pixels[step, now] = value
        if most:
            key = (value * webp.CACHE_HASH & 0xFFFFFFFF) >> cache_drop[now]
            cache[cache_first[now] + key if caches[now].all() else np.where(caches[now] > 0, cache_first[now] + key, 0)] = value
        if not step & 63 and int(at_.max()) > words.limit:
            raise BadStream("the stream ends early")
    return [pixels[:n, i].astype(np.uint32) for i, n in zip(each.tolist(), total.tolist(), strict=True)], at


class _Image:
    """One image on its way: its transforms so far, and where its bits go on."""

    def __init__(self, data: bytes, number: int):
        self.data, self.number, self.bits = data, number, webp.Bits(data)
        self.width, self.height = webp.read_header(self.bits)
        self.own, self.steps, self.waits = self.width, [], None

    def advance(self) -> bool:
        """Read transforms up to one that has an image (width, height in waits), or all; whether one waits."""
        while self.bits.read(1):
            kind = self.bits.read(2)
            if kind in [s[0] for s in self.steps]:
                raise BadStream("a transform twice")
            if kind in (webp.PREDICTOR, webp.CROSS_COLOUR):
                shift = self.bits.read(3) + 2
                self.waits = (kind, shift, -(-self.own >> shift), -(-self.height >> shift))
                return True
            if kind == webp.PALETTE:
                self.waits = (kind, 0, self.bits.read(8) + 1, 1)
                return True
            self.steps.append((kind, self.own, None, 0))
        self.waits = None
        return False

    def take(self, pixels: np.ndarray) -> None:
        """The waiting transform's image."""
        kind, shift, n, _ = self.waits
        if kind == webp.PALETTE:
            pixels = webp.palette(pixels)
        self.steps.append((kind, self.own, pixels, shift))
        if kind == webp.PALETTE:
            self.own = -(-self.own >> webp.packing(n))


def decode_many(files: Sequence[bytes]) -> list[np.ndarray]:
    """The pixels of each lossless WebP file."""
    streams = [webp.stream_of(f) for f in files]
    images = [_Image(s, i) for i, s in enumerate(streams)]
    if not images:
        return []
    words = Words(streams)

    def rounds(waiting: list[_Image], sizes: list[tuple[int, int]], main: bool):
        numbers = np.array([x.number for x in waiting])
        at = words.first[numbers] + np.array([x.bits.at for x in waiting])
        width, height = np.array(sizes, np.int64).T
        found, ends, several = read_images(words, at, width, height, words.end[numbers], main)
        for x, pixels, end in zip(waiting, found, (ends - words.first[numbers]).tolist(), strict=True):
            x.bits.at = end
            yield x, pixels
        several_of.update(numbers[several].tolist())

    several_of: set[int] = set()
    waiting = [x for x in images if x.advance()]
    while waiting:
        for x, pixels in rounds(waiting, [x.waits[2:] for x in waiting], False):
            x.take(pixels)
        waiting = [x for x in waiting if x.advance()]
    out: list[np.ndarray] = [np.zeros(0)] * len(images)
    for x, pixels in rounds(images, [(x.own, x.height) for x in images], True):
        out[x.number] = pixels
    for x in images:
        if x.number in several_of:
            out[x.number] = webp.decode(files[x.number])
        else:
            out[x.number] = webp.finish(out[x.number], x.steps, x.height).reshape(x.height, x.width, 4)
    return out
