"""Benchmark decontamination by suffix arrays over shards of the training texts.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z: digits, letters and everything outside ASCII.
A benchmark item's windows are its runs of ``window`` words; an item with fewer words, but not none, is one window.

Each Arrow batch of documents is a shard. Its words become numbers of the benchmark's vocabulary (0: not in it), and
its suffix array holds, sorted by up to ``window`` words, the suffixes that can match at all: those that begin with as
many vocabulary words as the shortest window has. Every benchmark suffix (one per word position, equal ones once) is
binary-searched in it, all at once; the range that it finds holds the occurrences of its window. An occurrence that the
word before doesn't extend too, in text and item, begins a longest verbatim match, which is followed word by word to its
end; all that is reported comes from these matches and their places.

The benchmark is sent to the executors in blocks of at most ``block_bytes``; with more than one, each block is a pass
of its own over the documents, and the passes' hits are merged per document.

Defined results: null or empty texts have no words and are clean; an item with null or no words has no window; items
are told apart by item_id (null reads as the empty string), repeated ones count once; an empty benchmark leaves all
clean; repeated documents each get a row; an empty documents table gives no rows. report() ignores further columns,
remove() keeps them.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import slim, texts

WINDOW = 10
#: A byte's lower case if it belongs to a word, else a space.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


class Benchmark:
    """The windows of a block of items, as rows of word numbers."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window, self.number = window, {}
        named = [(name, [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]) for name, text in items]
        named = [(name, own) for name, own in named if own]
        self.names, self.ids = [n for n, _ in named], [np.array(own, np.int32) for _, own in named]
        #: Of each window the places (item, first word) where it stands, by the word before (0 where there is none).
        holders: dict[tuple[int, ...], dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for i, (_, own) in enumerate(named):
            for at in range(max(1, len(own) - window + 1)):
                holders[tuple(own[at : at + window])][own[at - 1] if at else 0].append((i, at))
        #: By length: the windows (one row each) and their places.
        self.windows: dict[int, tuple[np.ndarray, list[dict[int, list[tuple[int, int]]]]]] = {}
        for size in {len(w) for w in holders}:
            rows = sorted(w for w in holders if len(w) == size)
            self.windows[size] = (np.array(rows, np.int32), [dict(holders[w]) for w in rows])
        self.least = min(self.windows, default=0)


def suffix_array(ids: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The given suffixes of ids sorted by their first depth numbers, and these numbers; ids ends in depth zeros."""
    keys = ids[starts[:, None] + np.arange(depth)]
    # Behind a word that is not in the vocabulary nothing can match, so nothing there may count.
    keys *= np.cumprod(keys != 0, axis=1, dtype=np.int32)
    order = np.lexsort(keys.T[::-1])
    return starts[order], keys[order]


def bounds(keys: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query the range of the sorted keys that begin with it, by binary search over all queries at once."""
    size = queries.shape[1]

    def search(right: bool) -> np.ndarray:
        low, high = np.zeros(len(queries), np.int64), np.full(len(queries), len(keys), np.int64)
        while (open_ := low < high).any():
            middle = (low + high) // 2
            seen = keys[np.minimum(middle, len(keys) - 1), :size]
            unlike = seen != queries
            first = unlike.argmax(1)
            row = np.arange(len(queries))
            less = np.where(unlike.any(1), seen[row, first] < queries[row, first], right)
            low = np.where(open_ & less, middle + 1, low)
            high = np.where(open_ & ~less, middle, high)
        return low

    return search(False), search(True)


class Shard:
    """A batch's words as numbers of the benchmark's vocabulary; a zero stands behind each text."""

    def __init__(self, data: list[bytes], bench: Benchmark):
        get = bench.number.get
        parts, self.counts = [], np.zeros(len(data), np.int64)
        for i, text in enumerate(data):
            own = words(text)
            self.counts[i] = len(own)
            parts += [np.fromiter((get(w, 0) for w in own), np.int32, len(own)), np.zeros(1, np.int32)]
        self.ids = np.concatenate([*parts, np.zeros(bench.window, np.int32)])
        self.first = np.concatenate(([0], np.cumsum(self.counts + 1)))


def occurrences(shard: Shard, bench: Benchmark) -> Iterator[tuple[int, int, np.ndarray]]:
    """(length, row) of each window that occurs, and its places in the shard."""
    ids = shard.ids
    if not bench.windows or not shard.counts.any():
        return
    # Vocabulary words in a row from each position on: the distance to the next zero.
    stops = np.flatnonzero(ids == 0)
    at = np.flatnonzero(ids)
    starts = at[stops[np.searchsorted(stops, at)] - at >= bench.least]
    if not len(starts):
        return
    order, keys = suffix_array(ids, starts, bench.window)
    for size, (rows, _) in bench.windows.items():
        low, high = bounds(keys, rows)
        for row in np.flatnonzero(high > low).tolist():
            yield size, row, order[low[row] : high[row]]


def followed(a: np.ndarray, at: int, b: np.ndarray, start: int) -> int:
    """How many numbers, none of them zero, a from at on and b from start on have in common."""
    n, size = 0, 64
    while True:
        x, y = a[at + n : at + n + size], b[start + n : start + n + size]
        k = min(len(x), len(y))
        unlike = np.flatnonzero((x[:k] != y[:k]) | (x[:k] == 0))
        if len(unlike):
            return n + int(unlike[0])
        n += k
        if k < size:
            return n
        size *= 2


Match = tuple[int, int, int, int]


def matches(data: list[bytes], bench: Benchmark) -> tuple[np.ndarray, list[list[Match]]]:
    """Word counts, and of each text its longest verbatim matches: (first word, words, item, first word in the item).

    A match has a window's length at least and can't be extended on either side.
    """
    shard = Shard(data, bench)
    out: list[list[Match]] = [[] for _ in data]
    for size, row, places in occurrences(shard, bench):
        before = np.where(places > 0, shard.ids[places - 1], 0)
        for word, holders in bench.windows[size][1][row].items():
            # With the same word before in both, the match began earlier; 0 is no word of the vocabulary.
            for place in places[(before != word) | (before == 0)].tolist():
                doc = int(np.searchsorted(shard.first, place, side="right")) - 1
                for item, at in holders:
                    n = size + followed(shard.ids, place + size, bench.ids[item], at + size)
                    out[doc].append((place - int(shard.first[doc]), n, item, at))
    return shard.counts, [sorted(x) for x in out]


def hits(data: list[bytes], bench: Benchmark) -> Iterator[tuple[int, list[tuple[int, int]], list[str], int]]:
    """Of each text: its words, the merged ranges of words that are hit, the items found, and its longest match."""
    counts, found = matches(data, bench)
    for n, own in zip(counts.tolist(), found, strict=True):
        ranges: list[tuple[int, int]] = []
        for start, length, _, _ in own:
            if ranges and start <= ranges[-1][1]:
                ranges[-1] = (ranges[-1][0], max(ranges[-1][1], start + length))
            else:
                ranges.append((start, start + length))
        yield n, ranges, sorted({bench.names[i] for _, _, i, _ in own}), max((length for _, length, _, _ in own), default=0)


def blocks(benchmark: DataFrame, block_bytes: int) -> list[list[tuple[str, bytes]]]:
    """The items, in blocks of at most that many bytes of text (a longer single item is a block of its own)."""
    out: list[list[tuple[str, bytes]]] = [[]]
    size = 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    for r in rows.filter("text is not null").orderBy("item", "text").toLocalIterator():
        data = r["text"].encode()
        if out[-1] and size + len(data) > block_bytes:
            out.append([])
            size = 0
        size += len(data)
        out[-1].append((r["item"], data))
    return out


def _shared(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> list[Broadcast]:
    return [docs.sparkSession.sparkContext.broadcast(Benchmark(b, window)) for b in blocks(benchmark, block_bytes)]


def matched(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, word, n_words, item, item_word): every longest verbatim match of documents with the benchmark.

    Words count from 0; a match of several texts of one item_id is a row for each.
    """
    passes = None
    for bench in _shared(docs, benchmark, window, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], bench: Broadcast = bench) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, found = matches(texts(batch, 1), bench.value)
                rows = [(i, at, n, bench.value.names[item], start) for i, own in enumerate(found) for at, n, item, start in own]
                docs_of, at, n, item, start = zip(*rows, strict=True) if rows else ([],) * 5
                columns = [pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(item, pa.string()), pa.array(start, pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs_of, pa.int64())), *columns], ["doc_id", "word", "n_words", "item", "item_word"])

        part = slim(docs).mapInArrow(run, "doc_id long, word long, n_words long, item string, item_word long")
        passes = part if passes is None else passes.unionAll(part)
    return passes


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match) of every document.

    longest_match is the number of words of the longest match; matched() gives all matches and their places.
    """
    passes = []
    shared = _shared(docs, benchmark, window, block_bytes)
    single = len(shared) == 1
    for bench in shared:

        def run(batches: Iterator[pa.RecordBatch], bench: Broadcast = bench) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data = texts(batch, 1)
                found = list(hits(data, bench.value))
                if single:
                    n_hit = [sum(b - a for a, b in ranges) for _, ranges, _, _ in found]
                    rest = [
                        pa.array(n_hit, pa.int64()),
                        pa.array([len(x) for _, _, x, _ in found], pa.int64()),
                        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for _, _, x, _ in found], pa.string()),
                        pa.array([n > 0 for n in n_hit], pa.bool_()),
                    ]
                    names = ["n_hit", "n_items", "items_sha256", "contaminated"]
                else:
                    rest = [
                        pa.array([hashlib.md5(t).hexdigest() for t in data], pa.string()),
                        pa.array([[{"a": a, "b": b} for a, b in ranges] for _, ranges, _, _ in found], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                        pa.array([x for _, _, x, _ in found], pa.list_(pa.string())),
                    ]
                    names = ["text_md5", "ranges", "items"]
                most = pa.array([n for *_, n in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, *_ in found], pa.int64()), *rest, most], ["doc_id", "n_words", *names, "longest_match"])

        rest = "n_hit long, n_items long, items_sha256 string, contaminated boolean" if single else "text_md5 string, ranges array<struct<a: long, b: long>>, items array<string>"
        passes.append(slim(docs).mapInArrow(run, f"doc_id long, n_words long, {rest}, longest_match long"))
    if single:
        return passes[0]
    together = passes[0]
    for p in passes[1:]:
        together = together.unionAll(p)
    merged = together.groupBy("doc_id", "text_md5", "n_words").agg(
        (F.count("*") / len(passes)).cast("int").alias("copies"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("ranges")))).alias("ranges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.max("longest_match").alias("longest_match"),
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    n_hit = F.aggregate(
        "ranges", start, lambda acc, r: F.struct((acc["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(acc["end"], r["a"]))).alias("n"), F.greatest(acc["end"], r["b"]).alias("end"))
    )["n"]
    out = merged.select("*", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), F.explode(F.sequence(F.lit(1), "copies")))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "longest_match")


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = 4 << 20, text_col: str = "text") -> DataFrame:
    """The rows of docs in whose text no window occurs; one narrow pass a block, without a shuffle."""
    schema, at = docs.schema, docs.columns.index(text_col)
    for bench in _shared(docs, benchmark, window, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], bench: Broadcast = bench) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not ranges for _, ranges, _, _ in hits(texts(batch, at), bench.value)], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
