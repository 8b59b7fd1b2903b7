"""Sharding: minimax contiguous partition of groups of equal texts.

Groups (all documents of one text) are atomic and ordered by the MD5 of their text. The smallest capacity with which
the groups, cut greedily in that order, fit the shards is found by binary search, and the groups are cut there.

The search runs over a summary: the ordered key space is dealt to intervals by the keys' first four hex digits, whose
counts, sums and largest groups come to the driver (65,536 rows at most). Over intervals a greedy cut is known within
bounds, so some capacities surely suffice and some surely don't; binary search on the driver finds the smallest of the
one and the largest of the other kind. Between them, only intervals into which a cut can fall matter: they all are dealt
anew by their next digits in one job, and the search goes on, until both bounds meet. A round divides intervals by
thousands, so a few jobs are enough at any size of input, and the capacity is exact.

A document's shard follows from its own MD5 and the cuts. Its slot is its rank within (shard, bucket of its id, text
and a salt) plus the sizes of the shard's earlier buckets, so a shard is never sorted in one task.

Defined results: null text has no bytes and is grouped with the empty text; a group larger than an even share makes
its shard as large as that and leaves later shards smaller or empty; repeated rows each get a slot; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.session import durable

#: Bytes that a document costs beside its text.
OVERHEAD = 16
#: Hex digits of the key for the first level of intervals, and for each further one.
FIRST_DIGITS, DIGITS = 4, 3


class Intervals:
    """Consecutive groups by prefixes of their keys, in order."""

    def __init__(self, rows: list[tuple[str, int, int, int]]):
        """rows: (prefix, groups, size, largest group)."""
        self.rows = rows
        self.groups, size, self.largest = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3))
        self.ends = np.cumsum(size)
        self.total = int(self.ends[-1])

    def at(self, place: int) -> int:
        """The interval that holds the byte at a place."""
        return min(int(np.searchsorted(self.ends, place, side="right")), len(self.rows) - 1)

    def cuts(self, capacity: int, shards: int) -> tuple[list[int], list[int]]:
        """Where greedy shards of a capacity end at the least and at the most; lists of at most so many shards."""
        low, high = [0], [0]
        for ends, least in ((low, True), (high, False)):
            while ends[-1] < self.total and len(ends) <= shards:
                place = ends[-1] + capacity
                if place >= self.total:
                    ends.append(self.total)
                    break
                i = self.at(place)
                begin = int(self.ends[i - 1]) if i else 0
                if self.groups[i] == 1:
                    place = begin
                elif least:  # a shard ends less than a group before its room does
                    place = max(begin, place - int(self.largest[i]) + 1)
                ends.append(place)
        return low[1:], high[1:]

    def refined(self, groups: DataFrame, wanted: list[int]) -> Intervals:
        """These intervals dealt anew, in a job for each length of prefix."""
        dealt: dict[str, list[tuple[str, int, int, int]]] = {self.rows[i][0]: [] for i in wanted}
        for length in {len(p) for p in dealt}:
            for r in summary(groups.filter(F.substring("gkey", 1, length).isin([p for p in dealt if len(p) == length])), length + DIGITS):
                dealt[r[0][:length]].append(r)
        return Intervals([y for x in self.rows for y in dealt.get(x[0], [x])])


def summary(groups: DataFrame, digits: int) -> list[tuple[str, int, int, int]]:
    rows = groups.groupBy(F.substring("gkey", 1, digits).alias("prefix")).agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.max("size").alias("most"))
    return sorted(map(tuple, rows.collect()))


def _first(low: int, high: int, holds: Callable[[int], bool]) -> int:
    """The smallest number from low on for which holds, which is so for high."""
    while low < high:
        middle = (low + high) // 2
        if holds(middle):
            high = middle
        else:
            low = middle + 1
    return low


def minimax(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """(capacity, cuts) over groups (gkey, size): the smallest capacity that suffices, and where shards begin."""
    rows = summary(groups, FIRST_DIGITS)
    if not rows:
        return 0, []
    known = Intervals(rows)
    while True:
        total, largest = known.total, int(known.largest.max())
        low, high = max(largest, -(-total // shards)), largest + -(-total // shards)  # high always suffices
        reaches = lambda ends: len(ends) <= shards and ends[-1] == known.total
        low = _first(low, high, lambda c: reaches(known.cuts(c, shards)[1]))
        high = _first(low, high, lambda c: reaches(known.cuts(c, shards)[0]))
        # Where cuts of any capacity in between can lie.
        least, most = known.cuts(low, shards)[0], known.cuts(high, shards)[1]
        most += [total] * (len(least) - len(most))
        wanted: set[int] = set()
        for a, b in zip(least, most, strict=False):
            wanted.update(range(known.at(a), known.at(b) + 1))
        wanted = {i for i in wanted if known.groups[i] > 1}
        if not wanted:
            ends = known.cuts(high, shards)[0]
            return high, [known.rows[known.at(e)][0] for e in ends[:-1]]
        known = known.refined(groups, sorted(wanted))


def assign(docs: DataFrame, shards: int = 40, bucket_rows: int = 50_000) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document, by the law ``bytes``."""
    durable(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("gkey")
    ).checkpoint()
    groups = own.groupBy("gkey").agg(F.sum("size").alias("size")).checkpoint()
    _, cuts = minimax(groups, shards)
    shard = F.lit(0)
    if cuts:
        shard = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("gkey")))
    buckets = max(1, -(-own.count() // (shards * bucket_rows)))
    # Rows of a checkpoint keep their places, so this also deals equal rows to several buckets.
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(64))
    own = own.withColumn("shard", shard.cast("int")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "gkey", salt), F.lit(buckets)))
    offsets = own.groupBy("shard", "bucket").count()
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = offsets.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    ranked = own.withColumn("rank", F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "gkey")))
    return ranked.join(offsets, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
