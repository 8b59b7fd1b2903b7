"""Language identification by prediction by partial matching.

For each language a tree of byte contexts, of up to ``order`` bytes, holds how often each byte followed; contexts
seen fewer than ``least`` times are pruned, so the order varies. A byte b that context c has seen n(b) of n times,
with d different bytes, costs -log2(n(b) / (n + d)) bits; one that it hasn't seen costs the escape, -log2(d / (n + d)),
and is coded in the context shorter by one; behind the empty context all 256 bytes are equally likely. Statistics are
frozen: a text's code length under a language is the exact sum over all its bytes, in units of 2**-16 bits, and the
language with the shortest code is predicted (equal ones: the first by name).

The trees are laid out as tables: from the last bytes to the longest context that any language keeps, and for each
language from there to the row of its own longest kept suffix of that, with a column per byte that any language has
seen (others share one column: they cost the same everywhere). So texts of any length are scored by array lookups, in
blocks. A model of more than ``max_bytes`` is pruned at twice the count, until it fits, and so can be broadcast.

Training takes a bounded sample: per language the ``max_rows`` documents of least xxhash64(doc_id) outside the held-out
fold, as many of them as ``max_text`` bytes hold; one task counts them.

Defined results: null text or one without a letter is ``und`` with score 0; nothing learned: ``und``; null lang
teaches nothing; equal texts get equal results; repeated rows stay; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.common import fold, texts

HELD_OUT, UNKNOWN = 2, "und"
UNIT = 1 << 16
#: Languages whose counts may be broadcast.
FEW = 4096
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: bytes) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text.decode("utf-8", "replace")))


class Tree:
    """One language's counts: of each context, oldest byte first, how often each byte followed."""

    def __init__(self, data: list[bytes], order: int, least: int):
        start = bytes(order)  # a text begins behind zero bytes
        padded = [start + t for t in data]
        self.kept: dict[bytes, Counter] = {}
        line = np.frombuffer(b"".join(padded), np.uint8).astype(np.int64)
        lengths = np.array([len(t) for t in padded], np.int64)
        own = np.ones(len(line), bool)
        for k in range(order):
            own[np.cumsum(lengths) - lengths + k] = False
        at = np.flatnonzero(own)
        for size in range(order + 1):
            gram = np.zeros(len(at), np.int64)
            for k in range(size, -1, -1):
                gram = gram << 8 | line[at - k]
            found: dict[bytes, Counter] = defaultdict(Counter)
            for g, n in zip(*(x.tolist() for x in np.unique(gram, return_counts=True)), strict=True):
                found[(g >> 8).to_bytes(size, "big")][g & 255] = n
            for context, counts in found.items():
                if size == 0 or counts.total() >= least and context[1:] in self.kept:
                    self.kept[context] = counts

    def bits(self, context: bytes, byte: int) -> float:
        """The cost of a byte behind a context."""
        while context not in self.kept and context:
            context = context[1:]
        counts = self.kept.get(context)
        if not counts:
            return 8.0
        total, unlike = counts.total() + len(counts), len(counts)
        if byte in counts:
            return float(np.log2(total / counts[byte]))
        return float(np.log2(total / unlike)) + (self.bits(context[1:], byte) if context else 8.0)


class Model:
    """The trees of all languages as tables."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = 3, least: int = 16, max_bytes: int = 256 << 20):
        self.langs, self.order = sorted(samples), order
        while True:
            trees = [Tree(samples[x], order, least) for x in self.langs]
            seen = sorted({0} | {b for t in trees for c in t.kept.values() for b in c})
            self.columns = len(seen) + 1
            contexts = sorted({c for t in trees for c in t.kept}, key=lambda c: (len(c), c)) or [b""]
            size = 4 * (self.columns**order + sum(len(contexts) + len(t.kept) * self.columns for t in trees))
            if size <= max_bytes or len(contexts) <= 1:
                break
            least *= 2
        self.symbol = np.full(256, len(seen), np.int64)  # the last column: bytes that no language has seen
        self.symbol[seen] = np.arange(len(seen))
        self.own: list[np.ndarray] = []  # by language: of each context the row in cost, times the columns
        self.cost: list[np.ndarray] = []
        for t in trees:
            kept = [c for c in contexts if c in t.kept] or [b""]
            at = {c: i for i, c in enumerate(kept)}
            rows = np.full((len(kept), self.columns), 8.0)
            for i, c in enumerate(kept):  # shorter ones first
                counts = t.kept.get(c, {})
                n, d = sum(counts.values()), len(counts)
                if d:
                    rows[i] = (rows[at[c[1:]]] if c else 8.0) + np.log2((n + d) / d)
                for b, k in counts.items():
                    rows[i, self.symbol[b]] = np.log2((n + d) / k)
            self.cost.append(np.round(rows * UNIT).astype(np.int32).reshape(-1))
            own = np.zeros(len(contexts), np.int32)
            place = {c: i for i, c in enumerate(contexts)}
            for i, c in enumerate(contexts):
                own[i] = at[c] * self.columns if c in at else own[place[c[1:]]]
            self.own.append(own)
        # The longest context that any language keeps, by the symbols of the last bytes, newest last.
        self.row = np.zeros((self.columns,) * order, np.int32)
        for r, c in enumerate(contexts):
            self.row[(..., *(int(self.symbol[b]) for b in c))] = r
        self.row = self.row.reshape(-1)

    def lengths(self, data: list[bytes], block: int = 1 << 19) -> np.ndarray:
        """Code lengths, a row per text and a column per language."""
        out = np.zeros((len(data), len(self.langs)), np.int64)
        parts: list[tuple[int, bytes]] = []
        size = 0
        for i, text in enumerate(data):
            padded = bytes(self.order) + text
            for at in range(self.order, len(padded), block):
                parts.append((i, padded[at - self.order : at + block]))
                size += len(parts[-1][1])
                if size >= block:
                    self._add(out, parts)
                    parts, size = [], 0
        self._add(out, parts)
        return out

    def _add(self, out: np.ndarray, parts: list[tuple[int, bytes]]) -> None:
        if not parts:
            return
        s = self.symbol[np.frombuffer(b"".join(p for _, p in parts), np.uint8)]
        context = np.zeros(len(s) - self.order, np.int64)
        for k in range(self.order):
            context = context * self.columns + s[k : len(context) + k]
        row, symbol = self.row[context], s[self.order :]
        # Positions that mix two parts (a part's first bytes are history only) are left out of the sums.
        lengths = np.array([len(p) for _, p in parts], np.int64)
        begin = np.cumsum(lengths) - lengths
        edges = np.stack((begin, begin + lengths - self.order), 1).reshape(-1)
        of = [i for i, _ in parts]
        for i, (own, table) in enumerate(zip(self.own, self.cost, strict=True)):
            cost = np.append(table[own[row] + symbol], np.int32(0))
            np.add.at(out[:, i], of, np.add.reduceat(cost, edges, dtype=np.int64)[::2])


def fit(docs: DataFrame, max_rows: int = 400, order: int = 3, max_text: int = 8 << 20) -> Model | None:
    """A model from documents (doc_id, text, lang), held-out fold left out."""
    spark = docs.sparkSession
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.filter("text is not null and lang is not null").filter(fold() != HELD_OUT)
    # The hashes are even over 64 bits, so a share of their range holds the least ones. Languages are few; where they
    # aren't, their counts aren't broadcast.
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    few = counts.limit(FEW + 1).collect()
    if len(few) <= FEW:
        counts = F.broadcast(spark.createDataFrame([tuple(r) for r in few], "lang string, n long"))
    share = (max_rows + 10 * max_rows**0.5 + 100) / F.col("n")
    placed = known.withColumn("place", F.xxhash64("doc_id")).join(counts, "lang").filter(F.col("place") / 2.0**64 + 0.5 <= share)
    nth = F.row_number().over(W.partitionBy("lang").orderBy("place", "doc_id"))
    rows = placed.select("lang", "place", "doc_id", "text").withColumn("nth", nth).filter(F.col("nth") <= max_rows)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        samples: dict[str, list[bytes]] = defaultdict(list)
        held: Counter = Counter()
        for f in frames:
            for lang, text in zip(f["lang"], f["text"], strict=True):
                data = text.encode()
                if not samples[lang] or held[lang] + len(data) <= max_text:
                    samples[lang].append(data)
                    held[lang] += len(data)
        if samples:
            yield pd.DataFrame({"model": [pickle.dumps(Model(samples, order))]})

    found = rows.repartition(1).sortWithinPartitions("lang", "place", "doc_id", "text").select("lang", "text").mapInPandas(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document; the score is the share of the predicted language's
    likelihood for the text's average byte, raised to the text's length up to 64 bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            data = texts(batch, 2)
            langs, marks = [UNKNOWN] * len(data), np.zeros(len(data))
            if own is not None:
                lengths = own.lengths(data)
                best = lengths.argmin(1)
                bits = lengths / UNIT * np.minimum(1, 64 / np.maximum(1, [len(t) for t in data]))[:, None]
                share = 1 / np.exp2(np.minimum(0, bits.min(1)[:, None] - bits)).sum(1)
                for i, text in enumerate(data):
                    if has_letter(text):
                        langs[i], marks[i] = own.langs[best[i]], round(float(share[i]), 9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(marks)], ["doc_id", "held_out", "lang_pred", "score"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
