"""Pattern packing by non-negative least squares.

Texts become token ids, cut into pieces of at most a sequence's length. The pieces' lengths are counted; that histogram,
of as many numbers as a sequence has tokens, is all that the driver sees. It is fitted with patterns there: every way to
fill a sequence with up to ``depth`` lengths, in steps of a sequence's ``bins``-th part, is a column of a matrix, and
non-negative least squares (Lawson and Hanson's active sets) find how often to repeat each. The repeat counts are rounded
down and expanded to exact lengths, as far as the histogram holds them; a pattern's last place takes the longest that fits. What is left over is packed by best fit, longest first,
into the room that patterns leave and into further sequences; equal sequences are treated at once, so the plan is as
short as the histogram is, however many documents there are.

The plan says, for each length, which sequences its first, next, ... pieces go to and at which offset. A piece's number
among those of its length is its rank in a salted bucket plus the sizes of the buckets before, so that no length, however
common, is numbered in one task. Pieces look up their places in the plan where they lie.

Texts are encoded piece by piece, each distinct piece once while it is remembered: the library's model sees the pieces
of its patterns one by one. For a vocabulary of known normaliser and patterns, Latin-1 text is cut into these pieces here
and other words, which white space parts, are left to the library; with any other vocabulary, or with a special string
in it, a text is encoded whole by the library.

Defined results: null and empty texts are one piece of the closing id alone; repeated rows are pieces of their own;
special strings inside texts count as the library's default has them; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.common import hold, slim, texts
from pagemill.session import durable

VOCABULARY = "word_bpe_49k.json"
#: Tokens of a sequence, and the id that closes a document.
LIMIT, CLOSING = 4096, 1
#: Pieces of more characters are encoded each time they occur.
MEMO_CHARS = 48
#: The normaliser and the patterns of vocabularies that are encoded piece by piece.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
}
#: Letters, numbers and white space up to U+00FF in lower case; there NFC changes nothing, and these are SPLIT's classes.
LETTER, NUMBER, SPACE = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
PIECE = re.compile(f"[{LETTER}]+|'(?:[stmd]|re|ve|ll)|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")
WIDE = re.compile("[^\x00-\xff]")


class Encoder:
    """Token ids of texts by the library, each distinct piece once while it is remembered."""

    def __init__(self, library, group: int = 1 << 16, chars: int = 1 << 21, size: int = 250_000):
        """group: characters of new pieces encoded at once; chars: of texts held in pieces; size: pieces remembered, twice."""
        self.library, self.group, self.chars, self.size = library, group, chars, size
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # what was remembered before
        layout = json.loads(library.to_str())
        self.added = [t["content"] for t in layout["added_tokens"]]
        suffix = layout["model"].get("end_of_word_suffix")
        # Added tokens are looked for in the text itself, before it is normalised.
        plain = bool(suffix) and not any(t["normalized"] for t in layout["added_tokens"])
        self.in_pieces = plain and layout["normalizer"] == NORMALIZER and layout["pre_tokenizer"] == PRE_TOKENIZER
        vocabulary = library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)

    def pieces(self, text: str) -> list[str]:
        """What the library encodes apart: pieces of Latin-1 in lower case, and words with other characters as they are."""
        if text.isascii() or not WIDE.search(text):
            return PIECE.findall(text.lower())
        words = re.findall(r"[^\t-\r ]+", text)
        return list(chain.from_iterable([w] if WIDE.search(w) else PIECE.findall(w.lower()) for w in words))

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """The ids of distinct pieces; those of Latin-1 are encoded side by side, and their last tokens tell them apart."""
        found: dict[str, bytes] = {}
        plain = [p for p in new if p.isascii() or not WIDE.search(p)]
        at = 0
        while at < len(plain):
            end, size = at, 0
            while end < len(plain) and size < self.group:
                size += len(plain[end])
                end += 1
            ids = np.array(self.library.encode_batch_fast([" ".join(plain[at:end])], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(ends) == end - at:
                data = ids.tobytes()
                found.update((p, data[a:b]) for p, a, b in zip(plain[at:end], [0, *ends], ends, strict=False))
            at = end
        rest = [p for p in new if p not in found]
        if rest:
            encoded = self.library.encode_batch_fast(rest, add_special_tokens=False)
            found.update((p, np.array(x.ids, "<u4").tobytes()) for p, x in zip(rest, encoded, strict=True))
        return found

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def ids(self, data: list[str]) -> Iterator[bytes]:
        """The ids of each whole text, as little-endian unsigned 32-bit numbers."""
        at = 0
        while at < len(data):
            group, size = [], 0  # None: a text that goes to the library
            while at + len(group) < len(data) and (not group or size < self.chars):
                text = data[at + len(group)]
                size += len(text)
                group.append(None if not self.in_pieces or any(t in text for t in self.added) else self.pieces(text))
            if len(self.known) > self.size:
                self.known, self.old = {}, self.known
            known, old = self.known, self.old
            new = set(chain.from_iterable(p for p in group if p)).difference(known)
            known.update((p, old[p]) for p in new if p in old)
            known.update(self._learn([p for p in new if p not in old]))
            for i, pieces in enumerate(group):
                yield self._whole(data[at + i]) if pieces is None else b"".join(map(known.__getitem__, pieces))
            for p in new:
                if len(p) > MEMO_CHARS:
                    known.pop(p, None)
            at += len(group)


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """The worker's encoder by a vocabulary file of public_tokenizers."""
    hold("packing", _ENCODERS.clear)
    if vocabulary not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        _ENCODERS[vocabulary] = Encoder(Tokenizer.from_file(public_tokenizers.path(vocabulary)))
    return _ENCODERS[vocabulary]


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, closing: int = CLOSING, ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) and the ids themselves, if wanted, of each piece of each document."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = encoder(vocabulary), np.array([closing], "<u4").tobytes()
        for batch in batches:
            rows, kept = [], []
            found = own.ids([t.decode("utf-8", "replace") for t in texts(batch, 1)])
            for doc_id, data in zip(batch.column(0).to_pylist(), found, strict=True):
                data += last
                for piece, start in enumerate(range(0, len(data), 4 * limit)):
                    part = data[start : start + 4 * limit]
                    rows.append((doc_id, piece, start // 4, len(part) // 4, crc32(part)))
                    if ids:
                        kept.append(np.frombuffer(part, "<i4"))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            if ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    return slim(docs).mapInArrow(run, schema)


def patterns(bins: int, depth: int) -> np.ndarray:
    """All ways to fill bins steps with at most depth lengths of whole steps: a row each, how often it takes each length."""
    found: list[list[int]] = []

    def extend(own: list[int], left: int, most: int) -> None:
        if left == 0:
            found.append(own)
        elif len(own) < depth:
            for x in range(min(left, most), (left - 1) // (depth - len(own)), -1):
                extend([*own, x], left - x, x)

    extend([], bins, bins)
    out = np.zeros((len(found), bins + 1), np.int32)
    for i, own in enumerate(found):
        np.add.at(out[i], own, 1)
    return out


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """The x >= 0 that makes |a x - b| least, by active sets; at most as many of x are above 0 as a has rows."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    least = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds or 3 * a.shape[0]):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= least:
            break
        active[best] = True
        while True:
            at = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            # Go towards z until a number becomes 0, and let that one go.
            own, bad = x[at], z <= 0
            step = (own[bad] / np.maximum(own[bad] - z[bad], 1e-300)).min()
            x[at] = np.maximum(own + step * (z - own), 0)
            gone = at[bad & (x[at] <= 1e-12 * max(1.0, x.max()))]
            gone = gone if len(gone) else at[bad][:1]
            x[gone], active[gone] = 0, False
    return x


class Plan:
    """Where the pieces of each length go: rows (length, first rank, pieces a sequence, first sequence, offset)."""

    def __init__(self, histogram: dict[int, int], limit: int = LIMIT, bins: int = 128, depth: int = 4):
        self.limit, self.sequences = limit, 0
        self.left = {n: c for n, c in histogram.items() if c > 0}
        self.used: dict[int, int] = defaultdict(int)
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room: (first sequence, how many)
        self.by_pattern = 0  # sequences begun by patterns
        if self.left:
            self._fit(min(bins, limit), depth)
            self._best_fit()

    def _place(self, length: int, count: int, each: int, sequence: int, offset: int) -> None:
        self.rows.append((length, self.used[length], each, sequence, offset))
        self.used[length] += count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]

    def _fit(self, bins: int, depth: int) -> None:
        """Repeat patterns as often as least squares say, rounded down, while the histogram holds their lengths."""
        step = -(-self.limit // bins)
        queues: dict[int, list[int]] = defaultdict(list)  # exact lengths of a bin, the longest last
        supply = np.zeros(bins + 1)
        for n in sorted(self.left):
            queues[-(-n // step)].append(n)
            supply[-(-n // step)] += self.left[n]
        made = patterns(bins, depth)
        made = made[(made @ (supply == 0)) == 0]  # all their lengths occur
        if not len(made):
            return
        weight = np.arange(bins + 1) / bins  # a misfit counts by its tokens
        often = np.floor(non_negative_least_squares((made * weight).T.astype(float), supply * weight) + 1e-6)
        lengths = sorted(self.left)
        for p in np.argsort(-often, kind="stable").tolist():
            if often[p] >= 1:
                bins_of = np.repeat(np.arange(bins + 1), made[p])[::-1].tolist()
                self._expand(bins_of, int(often[p]), queues, lengths, step)

    def _expand(self, bins_of: list[int], repeats: int, queues: dict[int, list[int]], lengths: list[int], step: int) -> None:
        """Repeats of a pattern with exact lengths, as long as there are any.

        Each bin gives the longest that it has; the last one, whose bin's lengths fit in any case, gives way to the
        longest of all that fit. A choice of lengths is repeated until one of them runs out.
        """
        while repeats:
            taken: dict[int, int] = defaultdict(int)
            offset = 0
            for b in bins_of[:-1]:
                n = next((n for n in reversed(queues[b]) if self.left.get(n, 0) > taken[n]), None)
                if n is None:
                    return  # what the fit counted on is used up
                taken[n] += 1
                offset += n
            at = bisect_right(lengths, self.limit - offset) - 1
            while at >= 0 and self.left.get(lengths[at], 0) <= taken[lengths[at]]:
                at -= 1
            if at < 0:
                return
            taken[lengths[at]] += 1
            taken = {n: k for n, k in taken.items() if k}
            same = min([repeats, *(self.left[n] // k for n, k in taken.items())])
            offset = 0
            for n, k in taken.items():
                self._place(n, same * k, k, self.sequences, offset)
                offset += n * k
                if n not in self.left:
                    lengths.remove(n)
                    queues[-(-n // step)].remove(n)
            self.room[self.limit - offset].append((self.sequences, same))
            self.sequences += same
            self.by_pattern += same
            repeats -= same

    def _best_fit(self) -> None:
        """What is left over, longest first, each piece where the least room is left behind it."""
        rooms = sorted(self.room)
        for n in sorted(self.left, reverse=True):
            while n in self.left:
                count, at = self.left[n], bisect_left(rooms, n)
                if at == len(rooms):
                    room, first = self.limit, self.sequences
                    many = -(-count // (room // n))
                    self.sequences += many
                else:
                    room = rooms[at]
                    first, many = self.room[room].pop()
                    if not self.room[room]:
                        rooms.pop(at)
                each = min(room // n, count)
                full = min(many, count // each)
                self._place(n, full * each, each, first, self.limit - room)
                self._open(room - each * n, first, full, rooms)
                self._open(room, first + full, many - full, rooms)

    def _open(self, room: int, first: int, many: int, rooms: list[int]) -> None:
        if many and room:
            if not self.room[room]:
                insort(rooms, room)
            self.room[room].append((first, many))

    def table(self) -> np.ndarray:
        """The rows as columns, ordered by length and rank."""
        return np.array(sorted(self.rows) or np.zeros((0, 5)), np.int64).reshape(-1, 5).T


def _ranked(cut: DataFrame, bucket_rows: int) -> DataFrame:
    """Pieces with their number among those of their length, from 0."""
    buckets = max(1, -(-cut.count() // bucket_rows))
    # Rows of a checkpoint keep their places, so this also deals equal rows to several buckets.
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", F.pmod(F.monotonically_increasing_id(), F.lit(64))), F.lit(buckets)))
    sizes = cut.groupBy("length", "bucket").count()
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = cut.withColumn("rank", F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    return ranked.join(sizes, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before")).drop("bucket", "before")


def pack(cut: DataFrame, limit: int = LIMIT, bins: int = 128, depth: int = 4, bucket_rows: int = 50_000) -> DataFrame:
    """Pieces (doc_id, piece, length, ids_crc32, ...) with the sequence each goes to and its offset there."""
    spark = cut.sparkSession
    durable(spark)
    cut = cut.checkpoint()
    plan = Plan({r[0]: r[1] for r in cut.groupBy("length").count().collect()}, limit, bins, depth)
    shared = spark.sparkContext.broadcast(plan.table())
    ranked = _ranked(cut, bucket_rows)
    kept = [f for f in ranked.schema.fields if f.name != "rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, each, sequence, offset = shared.value
        keys = (length << 44) + first
        for batch in batches:
            own, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, (own << 44) + rank, side="right") - 1
            copy, slot = np.divmod(rank - first[at], each[at])
            arrays = [batch.column(f.name) for f in kept]
            places = [pa.array(sequence[at] + copy), pa.array(offset[at] + slot * own)]
            yield pa.RecordBatch.from_arrays(arrays + places, [f.name for f in kept] + ["sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, lengths): each sequence's ids one behind the other, and what they are of."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "length")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    return pack(pieces(docs, ids=False)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
