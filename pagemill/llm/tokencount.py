"""Token counts with overlap resynchronisation.

A text of more than ``chunk`` characters is encoded in overlapping chunks, with offsets, by the library. Two neighbours
are spliced at a boundary that both encodings have in their overlap, behind a separator, with the same tokens from there
to the next such boundary (or to the end of the left chunk). Where there is none, the alignment has failed: the overlap
is doubled, and when it covers the whole left chunk, that grows. Each chunk's encoding is used on both of its sides.

A boundary is stable if what stands before it and what stands behind it are encoded alike with or without each other.
That is so behind a separator: a white space character across which the tokenizer's normaliser, patterns and added
tokens don't reach. Which characters are separators is checked when a vocabulary is loaded, by probes with characters of
all kinds on both sides; a vocabulary without separators (its tokens cross white space) has no stable boundary, and its
texts are encoded whole.

The distinct shorter texts of a batch are encoded together: piece by piece, each distinct piece of the vocabulary's
patterns once while it is remembered (see packing), or whole, with a vocabulary of other patterns.

Defined results: null and empty texts have no tokens; special strings inside texts count as the library's default
has them; equal texts give equal rows; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagemill.llm.common import hold, slim, texts
from pagemill.llm.packing import Encoder

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: The characters of the property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: What stands beside a separator in a probe: letters of both cases, digits, signs, a contraction, marks, other scripts.
PROBES = ("a", "Zb", "İ", "7", "½", ".", "'s", "-", "_", "<|", "|>", "́", "é", "中", "\U0001f600", "ำ", "Σ")


def separators(library) -> str:
    """The white space characters that the patterns drop and across which neither they nor the normaliser reach.

    The model sees the patterns' pieces one by one, so it is enough that the pieces of x, separator, y are those of x
    and those of y. No added token may hold a separator or take white space beside it.
    """
    added = json.loads(library.to_str()).get("added_tokens", [])
    if library.pre_tokenizer is None or any(t.get("lstrip") or t.get("rstrip") for t in added):
        return ""

    def pieces(text: str) -> list[str]:
        text = library.normalizer.normalize_str(text) if library.normalizer else text
        return [piece for piece, _ in library.pre_tokenizer.pre_tokenize_str(text)]

    alone = {x: pieces(x) for x in PROBES}

    def apart(space: str) -> bool:
        if any(space in t["content"] for t in added):
            return False
        return all(pieces(x + run + y) == alone[x] + alone[y] for x in PROBES for y in PROBES for run in (space, space + space))

    return "".join(filter(apart, WHITE_SPACE))


class Encoded:
    """A stretch of a text, encoded: where its tokens begin and end in the text, and their ids."""

    def __init__(self, library, text: str, begin: int, end: int):
        found = library.encode(text[begin:end], add_special_tokens=False)
        spans = np.array(found.offsets, np.int64).reshape(-1, 2) + begin
        self.begin, self.end = begin, end
        self.starts, self.ends, self.ids = spans[:, 0], spans[:, 1], np.array(found.ids, np.int64)

    def between(self, low: int, high: int) -> int:
        """How many tokens begin from low on and before high."""
        return int(np.count_nonzero((self.starts >= low) & (self.starts < high)))

    def tokens(self, low: int, high: int) -> list[tuple[int, int, int]]:
        at = np.flatnonzero((self.starts >= low) & (self.starts < high))
        return list(zip(self.starts[at].tolist(), self.ends[at].tolist(), self.ids[at].tolist(), strict=True))


class Counter:
    """Counts tokens by the library."""

    def __init__(self, library, chunk: int = 32_768, overlap: int = 256, group: int = 1 << 18):
        self.library, self.chunk, self.overlap, self.group = library, chunk, overlap, group
        self.separators, self.encoder = separators(library), Encoder(library)
        self.widened = 0  # how often an alignment failed

    def common(self, text: str, left: Encoded, right: Encoded, low: int) -> int | None:
        """A stable boundary of both, or None."""
        places = np.intersect1d(left.starts, right.starts)
        places = [p for p in places[(places > max(low, right.begin)) & (places < left.end)].tolist() if text[p - 1] in self.separators]
        # The left chunk's last word may go on behind it, so it isn't compared.
        agreed = [a for a, b in zip(places, places[1:], strict=False) if left.tokens(a, b) == right.tokens(a, b)]
        return agreed[len(agreed) // 2] if agreed else None

    def spliced(self, text: str) -> int:
        """Tokens of a long text, chunk by chunk."""
        if not self.separators:
            return len(self.library.encode(text, add_special_tokens=False))
        total, done = 0, 0  # all that begins before done is counted
        left = Encoded(self.library, text, 0, min(len(text), self.chunk))
        while left.end < len(text):
            overlap, place = self.overlap, None
            while place is None and left.end < len(text):
                begin = max(left.begin, left.end - overlap)
                right = Encoded(self.library, text, begin, min(len(text), begin + max(self.chunk, 2 * overlap)))
                place = self.common(text, left, right, done)
                if place is None:
                    self.widened += 1
                    overlap *= 2
                    if begin == left.begin:
                        left = Encoded(self.library, text, left.begin, min(len(text), left.end + overlap))
            if place is not None:
                total += left.between(done, place)
                done, left = place, right
        return total + left.between(done, len(text) + 1)

    def count(self, data: list[str]) -> list[int]:
        """The number of tokens of each text."""
        distinct = dict.fromkeys(data)
        known = {t: self.spliced(t) for t in distinct if len(t) > self.chunk}
        short = [t for t in distinct if len(t) <= self.chunk]
        if self.encoder.in_pieces:
            known.update(zip(short, (len(ids) // 4 for ids in self.encoder.ids(short)), strict=True))
            return [known[t] for t in data]
        at = 0
        while at < len(short):
            group, size = [], 0
            while at < len(short) and (not group or size + len(short[at]) <= self.group):
                group.append(short[at])
                size += len(short[at])
                at += 1
            known.update(zip(group, map(len, self.library.encode_batch_fast(group, add_special_tokens=False)), strict=True))
        return [known[t] for t in data]


_COUNTERS: dict[str, Counter] = {}


def counter(vocabulary: str = VOCABULARY) -> Counter:
    """The worker's counter by a vocabulary file of public_tokenizers."""
    hold("tokencount", _COUNTERS.clear)
    if vocabulary not in _COUNTERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        _COUNTERS[vocabulary] = Counter(Tokenizer.from_file(public_tokenizers.path(vocabulary)))
    return _COUNTERS[vocabulary]


def count(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for batch in batches:
            data = texts(batch, 1)
            n = own.count([t.decode("utf-8", "replace") for t in data])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in data], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return slim(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
