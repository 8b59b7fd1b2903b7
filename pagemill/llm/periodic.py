"""Periodic run detection by Crochemore's partition refinement.

The positions of a text's words are dealt to classes: of level l, positions whose next l words are equal. A level is
refined from the one before: a class's positions part where their successors have parted. Of the classes that one class
parted into, all but the largest (the smaller halves) are enough to part by, so a position is moved O(log n) times. Each
class keeps its members linked in order. Two neighbours at a distance of exactly the level begin a square (a stretch
twice in a row) whose root has no smaller period; squares that begin at consecutive words are merged into runs.

Many texts are refined together: every step is a few array operations over all positions that move. A level at which
nothing parts any more is left out: the next one looked at is the least distance of linked neighbours above it. A position
with fewer words behind it than a level has stays where it is; it comes behind every place that can complete a square.
Distances of more than a ``least``-th part of a text are not followed.

Defined results: null and blank texts have no words; repeated rows are rows of their own; an empty table gives no rows;
further columns are ignored or, where documents are returned, kept. A text is one task's work, in memory that grows
linearly with its words.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import slim, texts

#: A run has so many words, and so many times its period, at least.
LEAST_WORDS, LEAST_TIMES = 24, 3
#: Words that are refined together; a text of more is refined alone.
GROUP_WORDS = 1 << 20


class Classes:
    """Positions by class: contiguous in ``place`` in any order, and linked in order of position."""

    def __init__(self, keys: np.ndarray):
        """keys: equal numbers for positions of one class of level 1."""
        n = len(keys)
        order = np.argsort(keys, kind="stable").astype(np.int32)
        ordered = keys[order]
        new = np.ones(n, bool)
        new[1:] = ordered[1:] != ordered[:-1]
        self.label = np.empty(n, np.int32)
        self.label[order] = np.cumsum(new) - 1
        self.count = int(new.sum())
        self.begin, self.size = np.zeros(n, np.int32), np.zeros(n, np.int32)
        begins = np.flatnonzero(new)
        self.begin[: self.count] = begins
        self.size[: self.count] = np.diff(begins, append=n)
        self.place, self.slot = order, np.empty(n, np.int32)
        self.slot[order] = np.arange(n, dtype=np.int32)
        self.next, self.before = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        self.moving = np.zeros(n, bool)
        self._link(order[:-1][~new[1:]], order[1:][~new[1:]])

    def _link(self, left: np.ndarray, right: np.ndarray) -> None:
        self.next[left] = right
        self.before[right] = left

    def members(self, classes: np.ndarray) -> np.ndarray:
        """All positions of some classes."""
        sizes = self.size[classes].astype(np.int64)
        if not len(classes):
            return np.zeros(0, np.int32)
        at = np.repeat(self.begin[classes] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
        return self.place[at]

    def part(self, moved: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Take positions (ascending) out of their classes, into a class for each class and label that they move by.

        Returns the classes that are to part others (the smaller halves) and the left ends of new links.
        """
        own = self.label[moved]
        order = np.argsort((own.astype(np.int64) << 32) + by, kind="stable")
        x, parent, label = moved[order], own[order], by[order]
        first = np.ones(len(x), bool)
        first[1:] = (parent[1:] != parent[:-1]) | (label[1:] != label[:-1])
        begins = np.flatnonzero(first)
        sizes = np.diff(begins, append=len(x))
        of = parent[begins]  # each new class's parent
        top = np.ones(len(of), bool)
        top[1:] = of[1:] != of[:-1]
        heads = np.flatnonzero(top)
        parents, leaving = of[heads], np.add.reduceat(sizes, heads)
        rest = self.size[parents] - leaving
        # A parent that goes as a whole into one class doesn't part.
        parts = (rest > 0) | (np.diff(heads, append=len(of)) > 1)
        if not parts.all():
            per_class = np.repeat(parts, np.diff(heads, append=len(of)))
            per_position = np.repeat(per_class, sizes)
            if not per_position.any():
                return np.zeros(0, np.int32), np.zeros(0, np.int32)
            kept = np.sort(x[per_position])
            return self.part(kept, by[np.searchsorted(moved, kept)])
        # The moved ones go to their parents' last places, by their new classes.
        tail = np.repeat(self.begin[parents] + rest - np.append(0, np.cumsum(leaving)[:-1]), leaving) + np.arange(len(x))
        inside = np.repeat(self.begin[parents] + rest, leaving)
        held = self.place[tail]
        self.moving[x] = True
        stay = held[~self.moving[held]]
        self.moving[x] = False
        free = self.slot[x[self.slot[x] < inside]]  # as many, class by class, as there are that stay
        self.place[free], self.slot[stay] = stay, free
        self.place[tail], self.slot[x] = x, tail
        # What stays is linked over the gaps.
        y = x[np.lexsort((x, parent))]
        run = np.ones(len(y), bool)
        run[1:] = self.next[y[:-1]] != y[1:]
        ends = np.append(run[1:], True)
        left, right = self.before[y[run]], self.next[y[ends]]
        self.next[left[left >= 0]] = right[left >= 0]
        self.before[right[right >= 0]] = left[right >= 0]
        both = (left >= 0) & (right >= 0)
        fresh = [left[both]]
        # New classes, with new links.
        self.next[x], self.before[x] = -1, -1
        joined = ~first[1:]
        self._link(x[:-1][joined], x[1:][joined])
        fresh.append(x[:-1][joined])
        names = np.arange(self.count, self.count + len(of), dtype=np.int32)
        whole = heads[rest == 0]  # nothing stays: the first new class keeps the parent's name
        names[whole] = of[whole]
        again = np.ones(len(of), bool)
        again[whole] = False
        names[again] = np.arange(self.count, self.count + int(again.sum()), dtype=np.int32)
        self.count += int(again.sum())
        self.size[parents] = rest
        self.begin[names], self.size[names] = tail[begins], sizes
        self.label[x] = np.repeat(names, sizes)
        # All but the largest of what a parent parted into.
        group = np.repeat(np.arange(len(heads)), np.diff(heads, append=len(of)))
        stays = np.flatnonzero(rest > 0)
        classes = np.concatenate([names, parents[stays]])
        group = np.concatenate([group, stays])
        by_size = np.lexsort((self.size[classes], group))
        largest = np.append(group[by_size][1:] != group[by_size][:-1], True)
        return classes[by_size[~largest]], np.concatenate(fresh)


def squares(keys: np.ndarray, lengths: np.ndarray, least: int = LEAST_TIMES) -> tuple[np.ndarray, np.ndarray]:
    """(period, position) of every square with a primitive root, over texts one behind the other; keys differ between texts."""
    n = len(keys)
    ends = np.repeat(np.cumsum(lengths), lengths).astype(np.int32)
    most = np.repeat(lengths // least, lengths).astype(np.int32)  # distances that matter
    begins = np.zeros(n, bool)
    begins[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
    classes = Classes(keys)
    waiting: dict[int, list[np.ndarray]] = defaultdict(list)
    levels: list[int] = []

    def wait(left: np.ndarray, level: int) -> None:
        gap = classes.next[left] - left
        good = (gap >= level) & (gap <= most[left])
        left, gap = left[good], gap[good]
        order = np.argsort(gap, kind="stable")
        left, gap = left[order], gap[order]
        cuts = np.flatnonzero(np.diff(gap)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(gap)], strict=True):
            if a < b:
                g = int(gap[a])
                if g not in waiting:
                    heappush(levels, g)
                waiting[g].append(left[a:b])

    found: list[tuple[int, np.ndarray]] = []
    wait(np.flatnonzero(classes.next >= 0).astype(np.int32), 1)
    parting, level = np.arange(n, dtype=np.int32), 1  # at level 1, all part
    while True:
        if level in waiting:
            at = np.concatenate(waiting.pop(level))
            at = at[(classes.next[at] == at + level) & (at + 2 * level <= ends[at])]
            if len(at):
                found.append((level, at))
        while levels and levels[0] <= level:
            heappop(levels)
        if not len(parting):
            if not levels:
                break
            level = levels[0]
            continue
        after = parting[~begins[parting]]
        moved = after - 1
        good = (classes.size[classes.label[moved]] > 1) & (level < most[moved])
        moved, by = moved[good], classes.label[after[good]]
        order = np.argsort(moved)
        level += 1
        if not len(moved):
            parting = moved
            continue
        small, fresh = classes.part(moved[order], by[order])
        wait(fresh, level)
        parting = classes.members(small)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    period = np.repeat([g for g, _ in found], [len(at) for _, at in found])
    return period.astype(np.int64), np.concatenate([at for _, at in found]).astype(np.int64)


def runs_of(words: list[np.ndarray], least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text of word numbers, by start and period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    long = [i for i, w in enumerate(words) if len(w) >= least_words]
    if not long:
        return out
    lengths = np.array([len(words[i]) for i in long], np.int64)
    flat = np.concatenate([words[i] for i in long]).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    keys = np.repeat(np.arange(len(long), dtype=np.int64), lengths) * (int(flat.max()) + 1) + flat
    period, at = squares(keys, lengths, least_times)
    if not len(period):
        return out
    keys = np.unique(period * (len(flat) + 1) + at)  # a link can be made twice
    period, at = np.divmod(keys, len(flat) + 1)
    first = np.flatnonzero(np.append(True, np.diff(keys) != 1))
    length = np.diff(first, append=len(keys)) - 1 + 2 * period[first]
    period, at = period[first], at[first]
    good = length >= np.maximum(least_words, least_times * period)
    period, at, length = period[good], at[good], length[good]
    text = np.searchsorted(starts, at, side="right") - 1
    order = np.lexsort((period, at))
    for t, a, n, p in zip(*(x[order].tolist() for x in (text, at - starts[text], length, period)), strict=True):
        out[long[t]].append((a, n, p))
    return out


def grouped(batches: Iterator[pa.RecordBatch], group_words: int = GROUP_WORDS) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Rows as (id, words), a group of texts at a time."""
    group, size = [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch, 1), strict=True):
            words = text.split()  # of bytes: parts at the six white space characters of ASCII
            if group and size + len(words) > group_words:
                yield group
                group, size = [], 0
            group.append((doc_id, words))
            size += len(words)
    if group:
        yield group


def numbered(group: list[list[bytes]]) -> list[np.ndarray]:
    """Words as numbers, equal for equal words of a group."""
    known: dict[bytes, int] = {}
    return [np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) for words in group]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run has behind its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period; of equal ones the first, then that of the smallest period."""
    best = None
    for start, length, period in runs:
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


Rewrite = Callable[[object, list[bytes]], list[bytes]]


def _map(docs: DataFrame, schema: str, rows: Callable, rewrite: Rewrite | None) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches):
            if rewrite:
                group = [(i, rewrite(i, w)) for i, w in group]
            found = runs_of(numbered([w for _, w in group]))
            made = [r for (i, w), own in zip(group, found, strict=True) for r in rows(i, w, own)]
            for at in range(0, len(made), 1000):
                columns = list(zip(*made[at : at + 1000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return slim(docs).mapInArrow(run, schema)


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, period) of every run."""
    return _map(docs, "doc_id long, start long, length long, period long", lambda i, w, own: [(i, *r) for r in own], None)


def collapsed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with every run cut down to its first period, and words joined by one space."""
    return _map(docs, "doc_id long, text string", lambda i, w, own: [(i, b" ".join(collapse(w, own)).decode("utf-8", "replace"))], None)


def repeated(doc_id: object, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents, by crc32 of their ids, with a repeating end."""
    h, n = crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def digest(docs: DataFrame, rewrite: Rewrite | None = repeated) -> DataFrame:
    """Per document its number of runs, its strongest run, and digests of all runs and of the collapsed text."""

    def row(doc_id, words, own):
        best = strongest(own)
        listed = "".join(f"{a},{n},{p}\n" for a, n, p in own)
        values = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        yield doc_id, len(own), *values, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapse(words, own))).hexdigest()

    return _map(docs, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string", row, rewrite)
