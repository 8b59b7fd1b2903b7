"""A lossless WebP encoder in NumPy, for many small images at once.

Each image becomes entropy-coded streams: where it has at most 16 colours, a palette and an image of packed indices;
else its pixels, with green subtracted where that shortens the codes by estimate. In a stream, stretches of pixels that
repeat earlier ones (three at least) are back-references, pixels that the colour cache holds are cache indices, and all
others are four symbols; each of the five alphabets has a Huffman code of its own. All steps run over the pixels,
symbols and codes of all streams together: there is no loop over pixels or images but for palettes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from pagemill.llm import webp

#: Pixels that may be encoded together; more go in several rounds.
TOGETHER = 1 << 19
LONGEST_COPY = 4096
ALPHABETS = (256 + webp.LENGTHS + 1024, 256, 256, 256, webp.DISTANCES)
_FIRST = np.cumsum((0, *ALPHABETS))[:-1]
_ALL = sum(ALPHABETS)
#: The 15-bit numbers with their bits in reverse.
TURNED = webp.turned(15).astype(np.int64)


def _grouped(order: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each element, the one before it of equal key, or -1; order sorts the keys and keeps ties in place."""
    before = np.full(len(key), -1, np.int64)
    same = key[order[1:]] == key[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    return before


def _sorted32(key: np.ndarray) -> np.ndarray:
    """A stable order of 32-bit keys, by two rounds of 16 bits."""
    order = np.argsort((key & 0xFFFF).astype(np.uint16), kind="stable")
    return order[np.argsort((key >> 16).astype(np.uint16)[order], kind="stable")]


def huffman(counts: np.ndarray, rows: np.ndarray, limit: int) -> np.ndarray:
    """Code lengths of symbols by their counts (1 at least); rows says, in ascending order, which code each is of.

    Each row's two-queue merge takes one step at a time, together with those of all other rows. Where a code is longer
    than limit, the row's counts are halved until it isn't. A row of one symbol gets length 0.
    """
    out = np.zeros(len(counts), np.int64)
    todo = np.arange(len(counts))
    counts = counts.astype(np.int64)
    while len(todo):
        order = todo[np.lexsort((counts[todo], rows[todo]))]
        of, n = np.unique(rows[order], return_counts=True)
        most = int(n.max())
        by_size = np.argsort(-n, kind="stable")  # large rows first, so that those with steps left come first
        rank = np.empty(len(of), np.int64)
        rank[by_size] = np.arange(len(of))
        row = np.repeat(rank, n)
        column = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
        n = n[by_size]
        never = 1 << 60
        leaves = np.full((len(of), most + 1), never, np.int64)
        leaves[row, column] = counts[order]
        sums = np.full((len(of), most + 1), never, np.int64)
        parent_of_leaf = np.zeros((len(of), most + 1), np.int64)
        parent_of_sum = np.zeros((len(of), most + 1), np.int64)
        leaf, node = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
        active = len(of) - np.searchsorted(n[::-1], np.arange(most + 1), side="right")  # rows of more than k symbols
        each = np.arange(len(of))
        for step in range(most - 1):
            a = int(active[step + 1])
            r, total = each[:a], np.zeros(a, np.int64)
            for _ in range(2):
                one, other = leaves[r, leaf[:a]], sums[r, node[:a]]
                take = one <= other
                total += np.where(take, one, other)
                x, y = r[take], r[~take]
                parent_of_leaf[x, leaf[x]] = step
                parent_of_sum[y, node[y]] = step
                leaf[:a] += take
                node[:a] += ~take
            sums[r, step] = total
        depth = np.zeros((len(of), most + 1), np.int64)
        for step in range(most - 3, -1, -1):
            r = each[: int(active[step + 2])]  # rows in which this sum isn't the root
            depth[r, step] = depth[r, parent_of_sum[r, step]] + 1
        lengths = np.where(n[row] > 1, depth[row, parent_of_leaf[row, column]] + 1, 0)
        out[order] = lengths
        deep = np.zeros(int(rows.max()) + 1, bool)
        deep[rows[order[lengths > limit]]] = True
        todo = todo[deep[rows[todo]]]
        counts[todo] = (counts[todo] + 1) >> 1
    return out


def canonical(rows: np.ndarray, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The codes of symbols, first bit lowest, as the format packs them."""
    order = np.lexsort((symbols, lengths, rows))
    share = np.where(lengths[order] > 0, 1 << (15 - lengths[order]), 0)
    first = np.cumsum(share) - share
    new = np.flatnonzero(np.diff(rows[order], prepend=-1))
    first -= np.repeat(first[new], np.diff(np.append(new, len(order))))
    out = np.zeros(len(rows), np.int64)
    out[order] = TURNED[first & 0x7FFF]
    return out


def prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, extra bits and their number of lengths or distances (1 at least)."""
    v = value - 1
    high = np.frexp(np.maximum(v, 1).astype(np.float64))[1].astype(np.int64) - 1
    n = np.maximum(high - 1, 0)
    small = v < 4
    symbol = np.where(small, v, 2 * high + (v >> n & 1))
    return symbol, np.where(small, 0, v & ((1 << n) - 1)), np.where(small, 0, n)


class Streams:
    """Entropy-coded images, one behind the other: their pixels, and the bits that go before each."""

    def __init__(self):
        self.pixels: list[np.ndarray] = []
        self.width: list[int] = []
        self.image: list[int] = []
        self.head: list[int] = []
        self.head_bits: list[int] = []
        self.cache: list[int] = []

    def add(self, image: int, pixels: np.ndarray, width: int, head: list[tuple[int, int]], main: bool) -> None:
        cache = min(10, len(pixels).bit_length() - 2) if main and len(pixels) >= 64 else 0
        head = [*head, (1 | cache << 1, 5) if cache else (0, 1), *([(0, 1)] if main else [])]
        value = at = 0
        for v, n in head:
            value |= v << at
            at += n
        self.pixels.append(pixels)
        self.width.append(width)
        self.image.append(image)
        self.head.append(value)
        self.head_bits.append(at)
        self.cache.append(cache)


def _copies(argb: np.ndarray, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, distance) of stretches that repeat what is that far before, without overlaps."""
    n = len(argb)
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none, none
    following = np.append(argb[1:], 0)
    key = (argb * np.uint32(0x9E3779B1) ^ following * np.uint32(0x85EBCA77) ^ stream.astype(np.uint32) * np.uint32(0xC2B2AE3D)).astype(np.uint32)
    before = _grouped(_sorted32(key), key)
    at = np.arange(n)
    good = (before >= 0) & (np.append(stream[1:], -1) == stream)
    good[good] = (argb[before[good]] == argb[good]) & (following[before[good]] == following[good]) & (stream[before[good]] == stream[good])
    distance = np.where(good, at - before, 0)
    turn = np.flatnonzero(np.diff(distance, prepend=-1) != 0)
    size = np.diff(np.append(turn, n))
    real = (distance[turn] > 0) & (size >= 2)
    start, length, back = turn[real], size[real] + 1, distance[turn[real]]  # pairs: one pixel more than positions
    # A stretch's last pixel may be the next one's first: that stays with the next.
    touching = np.append(start[1:] < start[:-1] + length[:-1], False)
    length = length - touching
    keep = length >= 3
    start, length, back = start[keep], length[keep], back[keep]
    parts = -(-length // LONGEST_COPY)
    if len(parts) and parts.max() > 1:
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, length, back = (np.repeat(x, parts) for x in (start, length, back))
        start, length = start + k * LONGEST_COPY, np.minimum(LONGEST_COPY, length - k * LONGEST_COPY)
    return start, length, back


def _near_codes(width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances that have short codes in an image of that width, ascending, and the codes."""
    found: dict[int, int] = {}
    for code, (dx, dy) in enumerate(webp.NEAR, 1):
        found.setdefault(max(1, dx + dy * width), code)
    return np.array(sorted(found)), np.array([found[d] for d in sorted(found)])


def _distance_codes(back: np.ndarray, width: np.ndarray) -> np.ndarray:
    out = back + 120
    for w in np.unique(width):
        mine = np.flatnonzero(width == w)
        far, codes = _near_codes(int(w))
        at = np.minimum(np.searchsorted(far, back[mine]), len(far) - 1)
        out[mine] = np.where(far[at] == back[mine], codes[at], out[mine])
    return out


def _pack(fields: list[tuple[np.ndarray, np.ndarray, np.ndarray]], image_of: np.ndarray, images: int) -> list[bytes]:
    """The bits of fields (place, value, bits), in the order of place; a place is eight times a stream plus a section."""
    place, value, bits = (np.concatenate(x) for x in zip(*fields, strict=True))
    order = np.argsort(place, kind="stable")
    place, value, bits = place[order], value[order].astype(np.uint64), bits[order]
    image = image_of[place >> 3]
    total = np.bincount(image, bits, images).astype(np.int64)
    words = (total + 63 >> 6) + 1
    base = np.cumsum(words) - words
    at = np.cumsum(bits) - bits
    at += (base * 64 - (np.cumsum(total) - total))[image]
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    out = np.zeros(int(words.sum()), np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] |= np.bitwise_or.reduceat(value << shift, first)
    # What goes beyond the word; a shift by 64 isn't defined.
    out[word[first] + 1] |= np.bitwise_or.reduceat(np.where(shift > 0, value >> (np.uint64(64) - np.maximum(shift, 1)), 0), first)
    data = out.astype("<u8").tobytes()
    return [data[8 * b : 8 * b + (n + 7 >> 3)] for b, n in zip(base.tolist(), total.tolist(), strict=True)]


def _write(streams: Streams, images: int) -> list[bytes]:
    sizes = np.fromiter(map(len, streams.pixels), np.int64, len(streams.pixels))
    argb = np.concatenate(streams.pixels)
    of = np.repeat(np.arange(len(sizes)), sizes)
    cache = np.array(streams.cache)
    # Which pixels the cache holds: of those before with the same place in it, the last one has to be equal.
    place = (argb * np.uint32(webp.CACHE_HASH)).astype(np.uint32) >> (32 - np.maximum(cache, 1)[of]).astype(np.uint32)
    key = (of << 10 | place).astype(np.uint32)
    before = _grouped(_sorted32(key), key)
    cached = (before >= 0) & (cache[of] > 0) & (argb[before] == argb)
    start, length, back = _copies(argb, of)
    inside = np.zeros(len(argb) + 1, np.int64)
    np.add.at(inside, start, 1)
    np.add.at(inside, start + length, -1)
    free = np.cumsum(inside[:-1]) == 0
    hit, plain = np.flatnonzero(free & cached), np.flatnonzero(free & ~cached)

    # Symbols: (stream, code, symbol) as one number, so that all are counted at once.
    slot = lambda s, code, symbol: s * _ALL + _FIRST[code] + symbol
    copy_symbol, copy_extra, copy_bits = prefix(length)
    far_symbol, far_extra, far_bits = prefix(_distance_codes(back, np.array(streams.width)[of[start]]))
    p = argb[plain]
    four = [slot(of[plain], c, (p >> s & 255).astype(np.int64)) for c, s in enumerate((8, 16, 0, 24))]
    hits = slot(of[hit], 0, 256 + webp.LENGTHS + place[hit].astype(np.int64))
    copies, fars = slot(of[start], 0, 256 + copy_symbol), slot(of[start], 4, far_symbol)
    counts = np.bincount(np.concatenate((*four, hits, copies, fars)), minlength=len(sizes) * _ALL)
    # A green code of one symbol that no simple code can name gets a second one.
    green = counts.reshape(-1, _ALL)[:, : ALPHABETS[0]]
    lone = np.flatnonzero(((green > 0).sum(1) == 1) & (green[:, :256].sum(1) == 0))
    green[lone, 0] = 1
    used = np.flatnonzero(counts)
    stream, symbol = np.divmod(used, _ALL)
    code = np.searchsorted(_FIRST, symbol, side="right") - 1
    symbol = symbol - _FIRST[code]
    rows = stream * 5 + code
    lengths = huffman(counts[used], rows, 15)
    code_of, bits_of = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    code_of[used], bits_of[used] = canonical(rows, symbol, lengths), lengths

    fields = [(np.arange(len(sizes)) * 8, np.array(streams.head, np.int64), np.array(streams.head_bits))]
    fields += _code_fields(len(sizes), rows, symbol, lengths, cache)
    # Pixels, by their place in the image.
    at, value, bits = [plain], code_of[four[0]], bits_of[four[0]]
    for s in four[1:]:
        value, bits = value | code_of[s] << bits, bits + bits_of[s]
    values, sizes_of = [value], [bits]
    at += [hit, start]
    values.append(code_of[hits])
    sizes_of.append(bits_of[hits])
    value, bits = code_of[copies] | copy_extra << bits_of[copies], bits_of[copies] + copy_bits
    value, bits = value | code_of[fars] << bits, bits + bits_of[fars]
    values.append(value | far_extra << bits)
    sizes_of.append(bits + far_bits)
    at, value, bits = np.concatenate(at), np.concatenate(values), np.concatenate(sizes_of)
    order = np.argsort(at, kind="stable")
    fields.append((of[at[order]] * 8 + 6, value[order], bits[order]))
    return _pack(fields, np.array(streams.image), images)


def _code_fields(streams: int, rows: np.ndarray, symbol: np.ndarray, lengths: np.ndarray, cache: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The codes themselves, in sections 1 to 5 of each stream."""
    every = np.arange(streams * 5)
    place = every // 5 * 8 + 1 + every % 5
    n = np.bincount(rows, minlength=len(every))
    first = np.cumsum(n) - n
    none, one = np.flatnonzero(n == 0), np.flatnonzero(n == 1)
    fields = [(place[none], np.ones(len(none), np.int64), np.full(len(none), 4)), (place[one], 5 | symbol[first[one]] << 3, np.full(len(one), 11))]
    normal = n > 1
    mine = normal[rows]
    r, s, k = rows[mine], symbol[mine], lengths[mine]
    if not len(r):
        return fields
    # Gaps of zeros before each symbol and behind the last one.
    size = np.where(every % 5 == 0, 256 + webp.LENGTHS + np.where(cache > 0, 1 << cache, 0)[every // 5], np.array(ALPHABETS)[every % 5])
    new = np.diff(r, prepend=-1) != 0
    last = np.append(new[1:], True)
    gap = np.where(new, s, s - np.append(0, s[:-1]) - 1)
    r, k, gap = np.concatenate((r, r[last])), np.concatenate((k, np.zeros(int(last.sum()), np.int64))), np.concatenate((gap, size[r[last]] - s[last] - 1))
    end = np.concatenate((np.zeros(len(s), bool), np.ones(int(last.sum()), bool)))
    order = np.argsort(r, kind="stable")
    r, k, gap, end = r[order], k[order], gap[order], end[order]
    full, rest = gap // 138, gap % 138
    items = full + (rest > 0) + (rest == 2) + ~end
    g = np.repeat(np.arange(len(r)), items)
    j = np.arange(len(g)) - np.repeat(np.cumsum(items) - items, items)
    literal = ~end[g] & (j == items[g] - 1)
    whole, left = j < full[g], rest[g]
    kind = np.where(literal, k[g], np.where(whole | (left >= 11), 18, np.where(left >= 3, 17, 0)))
    extra = np.where(literal, 0, np.where(whole, 127, np.where(left >= 11, left - 11, np.where(left >= 3, left - 3, 0))))
    extra_bits = np.where(kind == 18, 7, np.where(kind == 17, 3, 0))
    # The code of the code lengths.
    row = r[g]
    counts = np.bincount(row * 19 + kind, minlength=len(every) * 19)
    table = counts.reshape(-1, 19)
    lone = np.flatnonzero((table > 0).sum(1) == 1)
    table[lone, np.where(table[lone, 0] > 0, 1, 0)] = 1
    used = np.flatnonzero(counts)
    own = huffman(counts[used], used // 19, 7)
    code_of, bits_of = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    code_of[used], bits_of[used] = canonical(used // 19, used % 19, own), own
    ordered = bits_of.reshape(-1, 19)[:, webp.LENGTH_ORDER]
    count = np.maximum(4, 19 - np.argmax(ordered[:, ::-1] > 0, axis=1))
    head = (count - 4) << 1
    for i in range(19):
        head = head | np.where(i < count, ordered[:, i], 0) << (5 + 3 * i)
    which = np.flatnonzero(normal)
    fields.append((place[which], head[which], 6 + 3 * count[which]))  # the last bit: no maximum
    at = row * 19 + kind
    fields.append((place[row], code_of[at] | extra << bits_of[at], bits_of[at] + extra_bits))
    return fields


def _shorter_without_green(argb: np.ndarray, of: np.ndarray, images: int) -> np.ndarray:
    """Which images' red and blue have less entropy with green subtracted."""

    def entropy(channel: np.ndarray) -> np.ndarray:
        counts = np.bincount(of * 256 + channel, minlength=images * 256).reshape(images, 256)
        return -(counts * np.log2(np.maximum(counts, 1))).sum(1)  # but for a constant

    green, red, blue = ((argb >> s & 255).astype(np.int64) for s in (8, 16, 0))
    return entropy(red - green & 255) + entropy(blue - green & 255) < entropy(red) + entropy(blue)


def encode_many(images: Sequence[np.ndarray]) -> list[bytes]:
    """One lossless WebP file for each image (height, width, 4) of red, green, blue, alpha."""
    out: list[bytes] = []
    begin = 0
    while begin < len(images):
        end, size = begin, 0
        while end < len(images) and (end == begin or size + images[end][..., 0].size <= TOGETHER):
            size += images[end][..., 0].size
            end += 1
        out += _encode(images[begin:end])
        begin = end
    return out


def _encode(images: Sequence[np.ndarray]) -> list[bytes]:
    flat = [np.ascontiguousarray(x).reshape(-1, 4)[:, [3, 0, 1, 2]] for x in images]
    sizes = np.fromiter(map(len, flat), np.int64, len(flat))
    argb = webp.numbers(np.concatenate(flat))
    of = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    without = _shorter_without_green(argb, of, len(sizes))
    streams = Streams()
    for i, x in enumerate(images):
        height, width = x.shape[:2]
        own = argb[ends[i] - sizes[i] : ends[i]]
        head = [(0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 4)]
        # Few pixels of a large image tell already that it has many colours.
        colours = np.unique(own) if len(np.unique(own[:64])) <= 16 else own[:17]
        if len(colours) <= 16:
            step = np.diff(webp.channels(colours), axis=0, prepend=np.zeros((1, 4), np.uint8))
            streams.add(i, webp.numbers(step), len(colours), [*head, (1 | webp.PALETTE << 1, 3), (len(colours) - 1, 8)], False)
            index, packed = webp.pack_palette(np.searchsorted(colours, own), width, height, len(colours))
            streams.add(i, index, packed, [(0, 1)], True)
            continue
        if without[i]:
            own = webp.subtract_green(own)
            head.append((1 | webp.SUBTRACT_GREEN << 1, 3))
        streams.add(i, own, width, [*head, (0, 1)], True)
    return [webp.wrap(x) for x in _write(streams, len(images))]
