"""SimHash near-duplicates by multi-index hashing.

Fingerprints: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, ``width``-word shingles with repeats (fewer words: the
whole sequence), XXH64 with seed 42 of each; a bit is 1 if it is set in over half of the hashes. No words: zero.

Links: equal fingerprints are one node, so copies are never paired. A fingerprint is cut into ``segments`` (three,
or two, by the number of fingerprints); with
radii r_i such that sum(r_i + 1) > radius, two fingerprints within radius bits differ in some segment i by r_i bits
at most. Each fingerprint is entered in a table per segment, and probes it with its own segment value and with the
values in a small Hamming ball around it (only with those whose lowest changed bit goes from 0 to 1: of two values
that differ, one does that). Matches are verified over all 64 bits.

A crowded table entry (over ``crowd`` fingerprints, such as thousands of near copies) is not paired either. Those
that probe it are compared in another exact way: two fingerprints are within 2k bits exactly if their balls of radius
k have a common member, so each emits its ball, and all who emitted a value are linked to the smallest of them. That
grows in proportion to their number, loses no link, and adds none.

Components: alternating large-star and small-star rounds over the links of distinct fingerprints, each round cut by
checkpoint(); nothing is gathered on the driver but one count a round.

Defined results: null and empty texts have fingerprint zero and are linked like any other; repeated rows stay
separate rows of one component; a component of null ids only has a null component_id; an empty table gives no rows;
further columns are ignored by components() and kept by keep_first().
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import hold, texts
from pagemill.session import durable

BITS = 64


def shingle_hashes(text: bytes, width: int = 4) -> np.ndarray:
    """The hash of every shingle, with repeats; none for a text without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        line = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(lengths)
        starts = (ends - lengths)[: len(words) - width + 1].tolist()
        shingles = [line[a:b] for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, 42) for s in shingles), np.uint64, len(shingles))


def fingerprints(text: bytes, width: int = 4, prints: int = 1) -> list[int]:
    """The fingerprint, and further ones of the same shingles by hashes mixed anew from the first."""
    return _majorities(shingle_hashes(text, width), prints)


def _majorities(every: np.ndarray, prints: int) -> list[int]:
    n, ones = len(every), np.zeros((prints, BITS), np.int64)
    if not n:
        return [0] * prints
    for at in range(0, n, 1 << 16):
        hashes = every[at : at + (1 << 16)]
        for i in range(prints):
            own = _mixed(hashes, i) if i else hashes
            # Eight bits at a time in the eight bytes of a word: sums of up to 255 rows fit a byte.
            for k in range(0, len(own), 255):
                rows = own[k : k + 255]
                for bit in range(8):
                    ones[i, bit::8] += ((rows >> np.uint64(bit)) & np.uint64(0x0101010101010101)).sum(dtype=np.uint64).reshape(1).view(np.uint8)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view("<u8").reshape(-1).tolist()


def fingerprint(text: bytes, width: int = 4) -> int:
    return fingerprints(text, width)[0]


def _mixed(hashes: np.ndarray, salt: int) -> np.ndarray:
    own = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * salt & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    own ^= own >> np.uint64(29)
    own *= np.uint64(0x94D049BB133111EB)
    return own ^ own >> np.uint64(32)


#: Bands of least hashes: texts that share 80 % of their shingles agree in one of 24 bands of 5 but for 7 in 100,000.
BANDS, ROWS = 24, 5
_SALTS, _FACTORS = (_mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64), i)[:, None] for i in (101, 102))
_FACTORS = _FACTORS | np.uint64(1)
#: Of the 120 least hashes, texts that share 80 % of their shingles have 96 in common on average, with a deviation of
#: 4.4; they have less than 83 once in 700 times (once in three million at 85 %).
ALIKE = 83
#: Bits of a least hash that a signature keeps: those of a band make a long.
_SIGN = 12
#: Of that many further least hashes a fine signature keeps one bit each. At 80 % nine tenths of the bits agree, 922 on
#: average with a deviation of 9.6; less than 890 do once in 2,000 times. At 70 % that many agree once in 25 times.
FINE, FINE_ALIKE = 1024, 890
_FINE_SALTS, _FINE_FACTORS = (_mixed(np.arange(1, FINE + 1, dtype=np.uint64), i)[:, None] for i in (104, 105))
_FINE_FACTORS = _FINE_FACTORS | np.uint64(1)


def _least(distinct: np.ndarray, salts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least of a set's hashes under each order; all ones for an empty set."""
    least = np.full(len(salts), np.iinfo(np.uint64).max, np.uint64)
    step = max(1, (1 << 19) // len(salts))
    for at in range(0, len(distinct), step):
        own = (distinct[at : at + step] ^ salts) * factors
        np.minimum(least, (own ^ own >> np.uint64(32)).min(axis=1), out=least)
    return least


def signature(distinct: np.ndarray) -> np.ndarray:
    """A long for each band, of bits of the least hashes under its ROWS orders; bands agree where the longs do."""
    bits = _mixed(_least(distinct, _SALTS, _FACTORS), 103) & np.uint64((1 << _SIGN) - 1)
    return (bits.reshape(BANDS, ROWS) << (np.arange(ROWS, dtype=np.uint64) * np.uint64(_SIGN))).sum(axis=1, dtype=np.uint64)


def fine_signature(distinct: np.ndarray) -> np.ndarray:
    """FINE bits of further least hashes, in longs."""
    bits = (_mixed(_least(distinct, _FINE_SALTS, _FINE_FACTORS), 106) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view("<u8")


def alike(one: Column, other: Column) -> Column:
    """In how many least hashes two signatures agree."""
    ones = sum(1 << (_SIGN * i) for i in range(ROWS))
    low, high = ((1 << (_SIGN - 1)) - 1) * ones, (1 << (_SIGN - 1)) * ones

    def equal(a: Column, b: Column) -> Column:
        x = a.bitwiseXOR(b)
        # The high bit of a part of the sum is set where one of its low bits is.
        return F.lit(ROWS) - F.bit_count((x.bitwiseAND(low) + low).bitwiseOR(x).bitwiseAND(high))

    return F.aggregate(F.zip_with(one, other, equal), F.lit(0), lambda acc, n: acc + n)


def fine_alike(one: Column, other: Column) -> Column:
    """In how many bits two fine signatures agree."""
    return F.aggregate(F.zip_with(one, other, lambda a, b: F.lit(64) - F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda acc, n: acc + n)


def _lists(values: np.ndarray) -> pa.Array:
    """The rows of a table of longs as lists."""
    n, size = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * size + 1, size, dtype=np.int32)), pa.array(np.ascontiguousarray(values).reshape(-1)))


def with_sketches(docs: DataFrame, width: int, prints: int, only: tuple[str, ...]) -> DataFrame:
    """The columns in only, node (a digest of the text's set of shingles), fingerprints fp, fp1 ..., size of that set and signature, as longs."""
    names = ["fp", *(f"fp{i}" for i in range(1, prints))]
    source = docs.select(*only, F.col("text").alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*only).schema] + [f"`{n}` long" for n in ("node", *names, "size")] + ["signature array<long>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("simhash", dict)
        for batch in batches:
            made = []
            for t in texts(batch, "__text"):
                every = shingle_hashes(t, width)
                distinct = np.unique(every)
                made.append([xxhash.xxh64_intdigest(distinct.tobytes(), 42), *_majorities(every, prints), len(distinct), *signature(distinct).tolist()])
            values = np.array(made, np.uint64).reshape(-1, 2 + prints + BANDS).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(values[:, i]) for i in range(2 + prints)), _lists(values[:, 2 + prints :])], [*only, "node", *names, "size", "signature"])

    return source.mapInArrow(run, schema)


def with_fine_signatures(owners: DataFrame, width: int) -> DataFrame:
    """(node, fine) of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("simhash", dict)
        for batch in batches:
            made = [fine_signature(np.unique(shingle_hashes(t, width))) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), _lists(np.array(made, np.uint64).reshape(-1, FINE // 64).view(np.int64))], ["node", "fine"])

    return owners.select("node", "text").mapInArrow(run, "node long, fine array<long>")


def similar(pairs: DataFrame, owners: DataFrame, width: int, least: float) -> DataFrame:
    """Those of pairs (a, b) whose texts in owners (node, text) share at least that part of all their distinct shingles."""
    for side in ("b", "a"):  # the owners are dealt by node once, for both
        pairs = pairs.join(owners.hint("merge"), F.col(side) == F.col("node")).drop("node").withColumnRenamed("text", f"text_{side}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("simhash", dict)
        for batch in batches:
            keep, before, one = [], None, None
            for x, y in zip(texts(batch, "text_a"), texts(batch, "text_b"), strict=True):
                if x != before:
                    before, one = x, np.unique(shingle_hashes(x, width))
                other = np.unique(shingle_hashes(y, width))
                both = len(np.intersect1d(one, other, assume_unique=True))
                keep.append(both >= least * (len(one) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def with_fingerprints(docs: DataFrame, width: int = 4, prints: int = 1, text_col: str = "text", only: tuple[str, ...] | None = None) -> DataFrame:
    """The columns of docs (or those in only) and the fingerprints as signed longs: fp, fp1, fp2 ..."""
    kept = [c for c in docs.columns if only is None or c in only]
    names = ["fp", *(f"fp{i}" for i in range(1, prints))]
    source = docs.select(*kept, F.col(text_col).alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema] + [f"`{n}` long" for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("simhash", dict)
        for batch in batches:
            values = np.array([fingerprints(t, width, prints) for t in texts(batch, "__text")], np.uint64).reshape(-1, prints).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(values[:, i]) for i in range(prints))], [*kept, *names])

    return source.mapInArrow(run, schema)


def cut(radius: int, segments: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of each segment; the radii are the smallest whose sum of r_i + 1 exceeds radius."""
    width, rest = divmod(BITS, segments)
    sizes = [width + (i < rest) for i in range(segments)]
    r, more = divmod(radius + 1, segments)
    return [(sum(sizes[:i]), sizes[i], r - 1 + (i < more)) for i in range(segments) if r + (i < more) > 0]


def _balls(value: Column, bits: int, radius: int, half: bool) -> Column:
    """value with up to radius of its lowest bits changed. half: only where the lowest changed bit was 0."""
    masks = [0] + [sum(1 << i for i in c) for k in range(1, radius + 1) for c in combinations(range(bits), k)]
    lows = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks))
    if half:
        lows = F.filter(lows, lambda m: value.bitwiseAND(m.bitwiseAND(-m)) == 0)
    return F.transform(lows, lambda m: value.bitwiseXOR(m))


def links(nodes: DataFrame, radius: int = 4, segments: int = 3, crowd: int = 64, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, a, b) with a < b for fingerprints in nodes (by, fp, distinct) within radius bits, or a chain of such for crowds.

    Where nodes have a column root, what two nodes of one root would add is left out; null roots are like no other.
    """
    if radius % 2:
        raise ValueError("crowded entries need an even radius")
    if "root" not in nodes.columns:
        nodes = nodes.withColumn("root", F.lit(None).cast("long"))
    tables, probes = [], []
    for i, (first, bits, r) in enumerate(cut(radius, segments)):
        value = F.shiftrightunsigned("fp", first).bitwiseAND((1 << bits) - 1)
        tables.append(F.struct(F.lit(i).cast("byte").alias("seg"), value.alias("key")))
        seg = F.lit(i).cast("byte").alias("seg")
        probes.append(F.transform(_balls(value, bits, r, half=True), lambda k: F.struct(seg, k.alias("key"))))
    place = [*by, "seg", "key"]
    entry = W.partitionBy(*place)
    entered = nodes.select(*by, "fp", "root", F.inline(F.array(*tables))).withColumn("n", F.count("*").over(entry)).withColumn("at", F.row_number().over(entry.orderBy("fp")))
    one = (F.count("root").over(entry) == F.col("n")) & (F.min("root").over(entry) == F.max("root").over(entry))
    entered = entered.withColumn("whole", F.when(one, F.col("root"))).filter((F.col("n") <= crowd) | (F.col("at") == 1))
    alone = F.col("n") <= crowd
    entered = entered.select(*place, F.when(alone, F.col("fp")).alias("other"), F.when(alone, F.col("root")).otherwise(F.col("whole")).alias("other_root"))
    met = nodes.select(*by, "fp", "root", F.inline(F.flatten(F.array(*probes)))).join(entered.hint("merge"), place)
    unlike = F.coalesce(F.col("root") != F.col("other_root"), F.lit(True))
    near = (F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius) & unlike
    crowds = F.col("other").isNull()
    # A crowded entry matters if some who probe it aren't all of one root.
    met = met.filter(crowds | near).select(*by, F.when(crowds, F.col("fp")).otherwise(F.least("fp", "other")).alias("fp"), F.when(~crowds, F.greatest("fp", "other")).alias("other"), *(F.when(crowds, F.col(c)).alias(c) for c in ("seg", "key")), (crowds & unlike).alias("open"))
    durable(nodes.sparkSession)
    met = met.distinct().checkpoint()
    pairs = met.filter("other is not null").select(*by, F.col("fp").alias("a"), F.col("other").alias("b")).distinct()
    hot = met.filter("open").select(*place).distinct()
    crowded = met.filter("other is null").join(hot.hint("merge"), place, "left_semi").select(*by, "fp").distinct()
    balls = crowded.select(*by, "fp", F.explode(_balls(F.col("fp"), BITS, radius // 2, half=False)).alias("key"))
    smallest = balls.groupBy(*by, "key").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").select(*by, "key", "a")
    stars = balls.join(smallest.hint("merge"), [*by, "key"]).filter(F.col("a") != F.col("fp")).select(*by, "a", F.col("fp").alias("b")).distinct()
    return pairs.union(stars)


#: Links that one task may hold: 16 MB.
FEW = 1 << 20


def spread(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of edges (a, b) reaches, by large-star and small-star rounds.

    Up to FEW links the rounds run in one partition and need no shuffle; beyond that they are dealt by node.
    """
    durable(edges.sparkSession)
    edges = edges.select("a", "b").distinct().checkpoint()
    if edges.count() <= FEW:
        edges = edges.coalesce(1)
    before = None
    while True:
        # Large star: larger neighbours of a node move to its smallest neighbour (itself included).
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = both.coalesce(1) if edges.rdd.getNumPartitions() == 1 else both
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least.hint("merge"), "a").filter(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        # Small star: smaller neighbours of a node, and the node, move to the smallest of them.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least.hint("merge"), "b").select(F.col("m").alias("a"), F.col("a").alias("b")).filter("a <> b")
        together = small.union(least.select(F.col("m").alias("a"), "b"))
        edges = (together.coalesce(1) if edges.rdd.getNumPartitions() == 1 else together).distinct().checkpoint()
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = state


def label(nodes: DataFrame, radius: int, segments: int) -> DataFrame:
    """(fp, root) of every fingerprint in nodes (fp, distinct)."""
    roots = spread(links(nodes, radius, segments))
    return nodes.join(roots.hint("merge"), nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def segments_for(nodes: DataFrame) -> int:
    """How many segments: with so many fingerprints that tables of three are crowded everywhere, two."""
    return 3 if nodes.count() <= 16 << 21 else 2


def components(docs: DataFrame, radius: int = 4, segments: int | None = None, width: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document; component_id is the smallest doc_id that links reach."""
    durable(docs.sparkSession)
    own = with_fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width, only=("doc_id",)).checkpoint()
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("least")).checkpoint()
    rooted = label(nodes.select("fp"), radius, segments or segments_for(nodes)).join(nodes.hint("merge"), "fp")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(ids.hint("merge"), "root").select("fp", "component_id")
    return own.join(named.hint("merge"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shared_links(own: DataFrame, roots: DataFrame, prints: int, radius: int, segments: int) -> DataFrame:
    """(a, b): links between values of node that any of the fingerprints gives, but for those of one root already.

    All fingerprints are searched in one plan. Each value of one stands for the smallest node beside it: nodes beside one
    value are linked, and so are those that linked values stand for.
    """
    values = F.array("fp", *(f"fp{i}" for i in range(1, prints)))
    rooted = own.join(roots.hint("merge"), own["node"] == roots["node"], "left").select(own["node"].alias("of"), F.coalesce("root", own["node"]).alias("root"), values.alias("values"))
    long = rooted.select("of", "root", F.posexplode("values").alias("which", "value"))
    stands = long.groupBy("which", "value").agg(F.min("of").alias("least"), F.min_by("root", "of").alias("least_root"), F.min("root").alias("low"), F.max("root").alias("high")).checkpoint()
    shared = stands.filter("low <> high").select("which", "value", "least", "least_root")
    beside = long.join(shared.hint("merge"), ["which", "value"]).filter("root <> least_root").select(F.least("least", "of").alias("a"), F.greatest("least", "of").alias("b"))
    searched = stands.select("which", F.col("value").alias("fp"), F.when(F.col("low") == F.col("high"), F.col("low")).alias("root"))
    between = links(searched, radius, segments, by=("which",))
    for side in ("a", "b"):
        between = between.join(stands.select("which", F.col("value").alias(side), F.col("least").alias(f"of_{side}")).hint("merge"), ["which", side])
    between = between.select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")).filter("a <> b")
    return beside.union(between).distinct()


def _parted(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (key, band, node, root, main) of the entries that links don't join whole; main is the root of the smallest."""
    of = entries.join(roots.hint("merge"), entries["node"] == roots["node"], "left").select("key", "band", entries["node"], "least", F.coalesce("root", entries["node"]).alias("root"))
    place = W.partitionBy("key")
    of = of.withColumn("main", F.max(F.when(F.col("node") == F.col("least"), F.col("root"))).over(place)).withColumn("stray", F.max((F.col("root") != F.col("main")).cast("int")).over(place))
    return of.filter("stray = 1").select("key", "band", "node", "root", "main").checkpoint()


def _pair(one: str, other: str) -> list[Column]:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def _beside(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): unlinked members of an entry that stand side by side in an order of its band; as many as members."""
    order = W.partitionBy("key").orderBy(F.xxhash64("node", "key"))
    before = [F.lag(F.struct(F.col("node").alias("other"), F.col("root").alias("other_root")), i).over(order) for i in (1, 2, 3)]
    met = _parted(entries, roots).select("node", "root", F.array(*before).alias("before")).select("node", "root", F.inline("before")).filter("root <> other_root")
    return met.select(*_pair("node", "other")).distinct()


def _apart(entries: DataFrame, roots: DataFrame, sketches: DataFrame, owners: DataFrame, width: int, least: float) -> DataFrame:
    """(a, b): unlinked members of an entry, of which one at least isn't linked with its smallest.

    Only pairs whose sizes, signatures and fine signatures allow for that similarity, each in the first band that it shares.
    """
    parted = _parted(entries, roots)
    fine = with_fine_signatures(owners.join(parted.select("node").distinct().hint("merge"), "node", "left_semi"), width)
    of = parted.join(sketches.hint("merge"), "node").join(fine.hint("merge"), "node").checkpoint()
    other = [F.col(c).alias(f"other_{c}") for c in ("key", "node", "root", "size", "signature", "fine")]
    stray = of.filter("root <> main").select(*other)
    once = (F.col("root") == F.col("main")) | (F.col("node") < F.col("other_node"))
    first = F.array_position(F.zip_with("signature", "other_signature", lambda x, y: x == y), True) == F.col("band") + 1
    sizes = F.least("size", "other_size") >= least * F.greatest("size", "other_size")
    near = (alike(F.col("signature"), F.col("other_signature")) >= ALIKE) & (fine_alike(F.col("fine"), F.col("other_fine")) >= FINE_ALIKE)
    met = of.join(stray.hint("merge"), (F.col("key") == F.col("other_key")) & (F.col("root") != F.col("other_root")) & once & sizes & first & near)
    return met.select(*_pair("node", "other_node")).distinct()


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    name = f"__{name}"
    while name in taken:
        name += "_"
    return name


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns in which nulls have their places; nested columns go by their JSON, with nulls too."""
    parts: list[Column] = []
    for f in docs.schema:
        own = F.col(f"`{f.name}`")
        nested = isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        parts += [own.isNull(), F.to_json(F.struct(own), {"ignoreNullFields": "false"}) if nested else own]
    return F.xxhash64(*parts)


def keep_first(docs: DataFrame, radius: int = 4, segments: int | None = None, width: int = 5, prints: int = 1, least: float = 0.8) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest doc_id (null ids last).

    Texts are linked if they share at least that part of all their distinct shingles, which is counted for every
    candidate pair. Candidates are those of which one of the fingerprints (further ones are made of the same shingles by
    other hashes) differs by radius bits at most, and those that agree in a band of least hashes. Of an entry of a band, all members are held against the
    smallest first; then the fingerprints are searched for pairs not linked yet; then members of entries are held against
    neighbours, and those still not linked with the smallest against all that they aren't linked with, if the least hashes
    of both, 120 first and 1,024 more then, agree as those of texts of that similarity do. Rows
    are told apart by a hash of all their columns; of fully equal rows one stays. Only keys of winners and of candidates meet the texts
    again, in joins on a key that no group shares.
    """
    durable(docs.sparkSession)
    columns = docs.columns
    row, id_, key = (free_name(docs, x) for x in ("row", "id", "key"))
    keyed = docs.withColumn(row, row_hash(docs))
    own = with_sketches(keyed.select("doc_id", row, "text"), width, prints, ("doc_id", row)).checkpoint()
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", F.col(row).alias("row"))).alias("first")
    names = ["fp", *(f"fp{i}" for i in range(1, prints))]
    nodes = own.groupBy("node").agg(first, *(F.first(c).alias(c) for c in (*names, "size", "signature"))).checkpoint()
    sketches = nodes.select("node", *names)
    # A band's key is hashed with the band's number, so keys alone tell entries apart.
    place = W.partitionBy("key")
    entries = nodes.select("node", F.posexplode("signature").alias("band", "value")).select("node", F.col("band").cast("byte").alias("band"), F.xxhash64("band", "value").alias("key"))
    entries = entries.withColumn("least", F.min("node").over(place)).withColumn("most", F.max("node").over(place)).filter("least <> most").drop("most").checkpoint()
    stars = entries.filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    tried = stars.distinct().checkpoint()
    met = (F.col(row) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(id_))

    def texts_of(pairs: DataFrame) -> DataFrame:
        """(node, text) of the nodes in pairs, each once. Few keys are sent to the texts; many meet them in a shuffle."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        at = ends.join(nodes.hint("merge"), "node").select("node", F.col("first.doc_id").alias(id_), F.col("first.row").alias(key))
        at = F.broadcast(at) if pairs.count() <= FEW // 2 else at.hint("merge")
        return keyed.select("doc_id", row, "text").join(at, met).select("node", "text").dropDuplicates(["node"])

    # What the bands show is linked first; then no step needs what is of one root already.
    owners = texts_of(tried).checkpoint()
    roots = spread(similar(tried, owners, width, least))
    steps = (
        (lambda: shared_links(sketches, roots, prints, radius, segments or segments_for(nodes)), texts_of),
        # Members of entries all have a star's pair, so their texts are there.
        (lambda: _beside(entries, roots), lambda _: owners),
        (lambda: _apart(entries, roots, nodes.select("node", "size", "signature"), owners, width, least), lambda _: owners),
    )
    for step, texts_for in steps:
        more = step().join(tried.hint("merge"), ["a", "b"], "left_anti").checkpoint()
        if not more.isEmpty():
            tried, linked = tried.union(more), similar(more, texts_for(more), width, least)
            # Links between roots are enough, and few.
            for side in ("a", "b"):
                of = roots.select(F.col("node").alias(side), F.col("root").alias(f"of_{side}"))
                linked = linked.join(of.hint("merge"), side, "left").withColumn(f"of_{side}", F.coalesce(f"of_{side}", side))
            between = linked.filter("of_a <> of_b").select(*_pair("of_a", "of_b")).distinct()
            roots = spread(between.union(roots.select(F.col("root").alias("a"), F.col("node").alias("b"))))
    rooted = nodes.join(roots.hint("merge"), "node", "left").select("first", F.coalesce("root", "node").alias("root"))
    winners = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias(id_), F.col("first.row").alias(key))
    return keyed.join(winners.hint("merge"), met, "left_semi").dropDuplicates(["doc_id", row]).select(*columns)
