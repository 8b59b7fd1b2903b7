"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Features of a text: its words (between white space, A-Z lower-cased), its word pairs, and one, two and three
neighbouring word shapes (letters become a or A, digits 0, other characters stay, runs shrink), hashed to ``2**BITS``
places; a feature's value is its count over the square root of the number of words. The score is the logistic
function of the sparse dot product with the weights plus a bias.

Training takes a bounded sample of the labelled rows: the ``max_rows`` of least xxhash64(doc_id), of those whose fold
isn't held out, as many of them as ``max_text`` bytes of text hold. They go to one task in that order, which makes ``passes`` passes and returns the weights (4 * 2**BITS
bytes), and these are broadcast. Nothing but the text enters a score.

Defined results: a null, empty or blank text has no features and gets the bias's score; without labelled rows every
score is 0.5; rows with a null or other quality than 0 and 1 teach nothing; equal texts get equal scores; repeated
rows stay; an empty table gives no rows; score() ignores further columns, keep_good() keeps them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import Memo, fold, hold, texts

BITS = 18
THRESHOLD = 0.7
HELD_OUT = 2
_MASK = np.uint64((1 << BITS) - 1)
_RUNS = re.compile(rb"(.)\1+", re.S)
_SHAPES = bytes(ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else ord("0") if 48 <= c <= 57 else c for c in range(256))
_MEMO = Memo(200_000)


def _codes(word: bytes) -> int:
    """A word's hash in the upper half, its shape's in the lower half."""
    value = crc32(word.lower()) << 32 | crc32(_RUNS.sub(rb"\1", word.translate(_SHAPES)), 7)
    return _MEMO.keep(word, value) if len(word) < 64 else value


def _mixed(a: np.ndarray, salt: int) -> np.ndarray:
    a = a * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)
    a ^= a >> np.uint64(29)
    a *= np.uint64(0xBF58476D1CE4E5B9)
    return (a >> np.uint64(64 - BITS)) & _MASK


def features(data: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The texts' word counts, and for each kind of feature the place of the one that begins at each word.

    Where a text has no n words left, the place is 2**BITS, whose weight is always zero.
    """
    hold("quality", _MEMO.forget)
    counts, codes = np.zeros(len(data), np.int64), []
    for i, text in enumerate(data):
        words = text.split()
        counts[i] = len(words)
        own = list(map(_MEMO.get, words))
        if None in own:
            own = [c if c is not None else _MEMO.fetch(w) or _codes(w) for w, c in zip(words, own, strict=True)]
        codes.append(np.array(own, np.uint64))
    code = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
    word, shape = code >> np.uint64(32), code & np.uint64(0xFFFFFFFF)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(code))  # words up to the text's end
    following = lambda a, k: np.concatenate((a[k:], np.zeros(min(k, len(a)), np.uint64)))
    prime = np.uint64(0x100000001B3)
    pair, triple = shape * prime + following(shape, 1), None
    triple = pair * prime + following(shape, 2)
    out = []
    for salt, (values, n) in enumerate(((word, 1), (word * prime + following(word, 1), 2), (shape, 1), (pair, 2), (triple, 3)), 1):
        out.append(np.where(left >= n, _mixed(values, salt), np.uint64(1 << BITS)).astype(np.int32))
    return counts, out


def scores(data: list[bytes], weights: np.ndarray) -> np.ndarray:
    """weights: 2**BITS of them, a zero, and the bias."""
    counts, places = features(data)
    total = np.zeros(len(data))
    if len(places[0]):
        each = sum(weights[p].astype(np.float64) for p in places)
        some = np.flatnonzero(counts)
        starts = (np.cumsum(counts) - counts)[some]
        total[some] = np.add.reduceat(each, starts) / np.sqrt(counts[some])
    return np.round(1 / (1 + np.exp(-np.clip(total + weights[-1], -35, 35))), 9)


def train(data: list[bytes], labels: list[int], passes: int = 3, alpha: float = 0.08, beta: float = 1.0, l1: float = 0.02, l2: float = 1.0) -> np.ndarray:
    """Follow the regularised leader, one text at a time."""
    size = (1 << BITS) + 2
    z, n, weights = np.zeros(size), np.zeros(size), np.zeros(size)
    rows = []
    for at in range(0, len(data), 500):
        part = data[at : at + 500]
        counts, places = features(part)
        ends = np.cumsum(counts)
        for a, b, k in zip(ends - counts, ends, counts, strict=True):
            index, times = np.unique(np.concatenate([p[a:b] for p in places] or [np.zeros(0, np.int32)]), return_counts=True)
            real = index < 1 << BITS
            rows.append((np.append(index[real], size - 1), np.append(times[real] / np.sqrt(max(k, 1)), 1.0).astype(np.float32)))
    for _ in range(passes):
        for (index, x), y in zip(rows, labels, strict=True):
            zi, ni = z[index], n[index]
            penalty = np.where(index == size - 1, 0.0, l1)
            w = np.where(np.abs(zi) <= penalty, 0.0, -(zi - np.sign(zi) * penalty) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[index] = zi + g - sigma * w
            n[index] = ni + g * g
    penalty = np.full(size, l1)
    penalty[-1] = 0
    weights = np.where(np.abs(z) <= penalty, 0.0, -(z - np.sign(z) * penalty) / ((beta + np.sqrt(n)) / alpha + l2))
    weights[1 << BITS] = 0
    return weights.astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6_000, max_text: int = 64 << 20) -> np.ndarray:
    """Weights from documents (doc_id, text) and labels (doc_id, quality), held-out folds left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter("doc_id is not null and quality in (0, 1)").filter(fold() != HELD_OUT).distinct()
    sample = known.withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id", "quality").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        data, labels_, held = [], [], 0
        for f in frames:
            for text, label in zip(f["text"], f["quality"], strict=True):
                own = (text or "").encode()
                if not data or held + len(own) <= max_text:
                    data.append(own)
                    labels_.append(int(label))
                    held += len(own)
        if data:
            yield pd.DataFrame({"weights": [train(data, labels_).tobytes()]})

    ordered = rows.repartition(1).sortWithinPartitions("place", "doc_id", "quality", "text")
    found = ordered.select("text", "quality").mapInPandas(run, "weights binary").collect()
    if not found:
        return np.zeros((1 << BITS) + 2, np.float32)
    return np.frombuffer(found[0]["weights"], np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = scores(texts(batch, 2), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == HELD_OUT).alias("held_out"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs that score at least threshold."""
    shared, at = docs.sparkSession.sparkContext.broadcast(weights), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(texts(batch, at), shared.value) >= threshold))

    return docs.mapInArrow(run, docs.schema)
