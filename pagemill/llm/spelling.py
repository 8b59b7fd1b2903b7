"""Spelling variant grouping by a symmetric-delete join.

Words are counted in tasks before they are shuffled. Every word emits itself and its distinct single deletions as keys;
words that share a key are joined, and the join keeps a pair only if their distance is exactly one (an inserted, deleted
or replaced code point). Two words at that distance share exactly one key: the shorter word, or the deletion of the
place where they differ. So each pair is found once, and a key has no more words than an alphabet can put into it.
The deletions of a long word would be as large as its square: those go by hashes of them.
Pairs are aggregated to a form for each word, its most frequent neighbour if that is frequent enough. A form is at least
twice as frequent as its word, so chains of forms are short; roots follow by joining what is known so far with itself,
which doubles the steps that are known, until nothing changes.

Defined results: null texts have no words; the count of a word is over all documents, repeated rows included; an empty
table gives no rows; further columns are ignored. A null id counts as the empty text where words are altered by id.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate, islice
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import sha256, slim, texts
from pagemill.session import durable

#: A word has so many code points and occurrences at least, and its form so many times its own.
LEAST_CHARS, LEAST_COUNT, TIMES = 5, 3, 2
#: Letters of Latin-1 between U+00C0 and U+00FF and those of ASCII, the latter in lower case.
RUN = re.compile("[a-zÀ-ÿ]+")
#: A document's words are altered where this divides the hash of id and word.
ALTERED = 97
#: Longer words are handled by hashes of their deletions, modulo PRIME: fixed values, a Mersenne prime and any base.
SHORT, PRIME, BASE = 64, (1 << 127) - 1, 0x9E3779B97F4A7C15F39CC0605CEDC835
#: Distinct words that a task counts before it hands them on.
HELD = 250_000

Alter = Callable[[object, Counter], Counter]


def altered(doc_id: object, counts: Counter) -> Counter:
    """A document's words, some of them without one of their letters."""
    begin, out = crc32(f"{'' if doc_id is None else doc_id}:".encode()), Counter()
    for word, n in counts.items():
        h = crc32(word.encode(), begin)
        if h % ALTERED == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        out[word] += n
    return out


def count_words(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, alter: Alter | None = None) -> DataFrame:
    """(word, n) of every word that is long and frequent enough, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def hand_on() -> Iterator[pa.RecordBatch]:
            items = iter(total.items())
            while part := list(islice(items, 10_000)):
                words, counts = zip(*part, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "n"])
            total.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch, 1), strict=True):
                found = RUN.findall(text.lower().decode("utf-8", "replace"))  # bytes: lowers A-Z alone
                own = alter(doc_id, Counter(found)) if alter else Counter(found)
                for word, n in own.items():
                    if len(word) >= least_chars:
                        total[word] += n
                if len(total) >= HELD:
                    yield from hand_on()
        yield from hand_on()

    counts = slim(docs).mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def keys(words: DataFrame) -> DataFrame:
    """(key, word, n): each word under itself and under each of its distinct single deletions."""
    deletion = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.concat(F.col("word").substr(F.lit(1), i - 1), F.col("word").substr(i + 1, F.length("word"))))
    return words.select(F.explode(F.array_distinct(F.concat(F.array("word"), deletion))).alias("key"), "word", "n")


def long_keys(words: DataFrame) -> DataFrame:
    """(key, name, chars, n, low, high) by hashes, in time and space that grow with a word's length, not its square.

    low and high: the first and last place (from 0) whose deletion leaves the string of that key; both -1 for the whole.
    """
    schema = "key string, name string, chars long, n long, low long, high long"

    def hashed(word: str) -> Iterator[tuple[str, int, int]]:
        codes = list(map(ord, word))
        before = list(accumulate(codes, lambda h, c: (h * BASE + c) % PRIME, initial=0))  # of the first so many
        yield f"{len(codes)}:{before[-1]:x}", -1, -1
        behind, scale, at = 0, 1, len(codes)  # of what stands behind a place, and BASE to the power of its length
        while at:
            high = at - 1
            key = (before[high] * scale + behind) % PRIME
            while at and codes[at - 1] == codes[high]:
                at -= 1
                behind, scale = (codes[at] * scale + behind) % PRIME, scale * BASE % PRIME
            yield f"{len(codes) - 1}:{key:x}", at, high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name, made = sha256(word.encode()), hashed(word)
                while part := list(islice(made, 10_000)):
                    key, low, high = zip(*part, strict=True)
                    fixed = [pa.array([x] * len(part)) for x in (name, len(word), n)]
                    yield pa.RecordBatch.from_arrays([pa.array(key), *fixed, pa.array(low), pa.array(high)], ["key", "name", "chars", "n", "low", "high"])

    return words.select("word", "n").mapInArrow(run, schema)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n) of all words at a distance of exactly one, in both directions.

    Pairs with a word of more than SHORT code points are told by where deletions lie: two words with the same deletion
    differ by one replacement if it can be at the same place in both, and by one insertion if it is the whole of one.
    """
    own = keys(words.filter(F.length("word") <= SHORT))
    other = own.select("key", F.col("word").alias("near"), F.col("n").alias("near_n"))
    short = own.join(other, (own["key"] == other["key"]) & (F.levenshtein("word", "near", 1) == 1)).select("word", "n", "near", "near_n")

    long = words.filter(F.length("word") >= SHORT)
    a = long_keys(long)
    b = a.select("key", *(F.col(c).alias(f"near_{c}") for c in a.columns if c != "key"))
    replaced = (F.col("low") >= 0) & (F.col("low") <= F.col("near_high")) & (F.col("near_low") <= F.col("high"))
    inserted = (F.col("low") < 0) != (F.col("near_low") < 0)
    apart = (F.col("name") != F.col("near_name")) & (F.greatest("chars", "near_chars") > SHORT)
    found = a.join(b, (a["key"] == b["key"]) & apart & (replaced | inserted)).select("name", "n", "near_name", "near_n")
    named = long.select(F.sha2("word", 256).alias("name"), "word")
    found = found.join(named, "name").join(named.select(F.col("name").alias("near_name"), F.col("word").alias("near")), "near_name")
    return short.unionByName(found.select("word", "n", "near", "near_n"))


def forms(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n) of each word of (word, n)."""
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    found = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    good = -F.col("best.less") >= times * F.col("n")
    return words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n")
    )


def roots(linked: DataFrame) -> DataFrame:
    """(word, root) of each word of (word, form): the last of the forms that follow one another from it."""
    durable(linked.sparkSession)
    known = linked.select("word", F.col("form").alias("root")).checkpoint()
    while True:
        step = known.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        joined = known.join(step, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("went")).checkpoint()
        known = joined.select("word", "root")
        if joined.filter("went").isEmpty():
            return known


def group(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each word of (word, n)."""
    durable(words.sparkSession)
    found = forms(words.checkpoint(), times).checkpoint()
    return found.join(roots(found.filter("form IS NOT NULL")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def report(docs: DataFrame, alter: Alter | None = altered) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the documents."""
    return group(count_words(docs, alter=alter)).select("word", "form", "root", "n", "n_near", "form_n")
