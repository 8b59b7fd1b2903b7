"""Sparse retrieval: corpus statistics, weights and search, for many queries and statistics epochs in one plan.

Terms are counted and queries scored inside a batch of rows, in Arrow functions, so that neither postings nor pairs of
queries and chunks are shuffled. A query is weighted like a document (its own term counts and length), so the inverse document frequency enters the
score twice. Chunks are (chunk_id, text), with an epoch column where several snapshots are searched at once.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pagemill.functions.text import tokens
from pagemill.session import durable
from pagemill.settings import Bm25


def words(text: str | None) -> list[str]:
    """The same as tokens(), in Python."""
    return text.lower().split() if text else []


def sendable(frequencies: DataFrame, most: int = 128 << 20) -> DataFrame:
    """frequencies, kept, and broadcast where they are so few bytes that an executor holds them."""
    durable(frequencies.sparkSession)
    kept = frequencies.checkpoint()
    size = kept.agg(F.sum(F.octet_length("term") + F.lit(64))).first()[0] or 0
    return F.broadcast(kept) if size <= most else kept


def _counted_rows(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Batches of some keys and a text as (keys, row, len, term, tf), where row numbers a batch's texts."""
    for batch in batches:
        row, size, term, tf = [], [], [], []
        for i, own in enumerate(map(words, batch.column(keys).to_pylist())):
            if own:
                counted = Counter(own)
                term += counted
                tf += counted.values()
                row += [i] * len(counted)
                size += [len(own)] * len(counted)
        at = pa.array(row, pa.int32())
        yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:-1]), at, pa.array(size, pa.int32()), pa.array(term, pa.string()), pa.array(tf, pa.int64())], [*batch.schema.names[:-1], "row", "len", "term", "tf"])


def term_counts(texts: DataFrame, key: str | list[str], text: str = "text") -> DataFrame:
    """(key, len, term, tf): one row per text and term. The counts are made inside the row: no shuffle."""
    keys = [key] if isinstance(key, str) else key
    listed = texts.select(*keys, F.col(text))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in listed.select(*keys).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _counted_rows(batches, len(keys)):
            yield batch.select([*keys, "len", "term", "tf"])

    return listed.mapInArrow(run, f"{kinds}, len int, term string, tf long")


def counted(texts: DataFrame, by: list[str] = [], sign: int = 1, text: str = "text", terms: bool = True, held: int = 200_000) -> DataFrame:  # noqa: B006
    """(by, term, df, total) in one pass, in parts: how many texts hold each term.

    The rows without a term have the number of texts and of their words. All numbers are multiplied by sign. A task counts
    up to so many terms before it lets them go; without terms, it counts sizes alone.
    """
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in texts.select(*by).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: dict[tuple, Counter] = defaultdict(Counter)
        size: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
        types: list = []

        def rows(e: tuple, term: list, n: list[int], total: list[int]) -> pa.RecordBatch:
            keys = [pa.array([x] * len(term), t) for x, t in zip(e, types, strict=True)]
            return pa.RecordBatch.from_arrays([*keys, pa.array(term, pa.string()), pa.array([sign * x for x in n], pa.int64()), pa.array([sign * x for x in total], pa.int64())], [*by, "term", "df", "total"])

        def let_go() -> Iterator[pa.RecordBatch]:
            for e, own in df.items():
                yield rows(e, list(own), list(own.values()), [0] * len(own))
            df.clear()

        for batch in batches:
            types = [batch.schema.field(i).type for i in range(len(by))]
            epochs = zip(*(batch.column(i).to_pylist() for i in range(len(by))), strict=True) if by else [()] * batch.num_rows
            for e, own in zip(epochs, map(words, batch.column(len(by)).to_pylist()), strict=True):
                size[e][0] += 1
                size[e][1] += len(own)
                if terms:
                    df[e].update(set(own))
            if sum(map(len, df.values())) > held:
                yield from let_go()
        yield from let_go()
        for e, (n, total) in size.items():
            yield rows(e, [None], [n], [total])

    return texts.select(*by, text).mapInArrow(run, f"{kinds}term string, df long, total long")


def document_frequencies(texts: DataFrame, by: list[str] = [], text: str = "text") -> DataFrame:  # noqa: B006
    """(by, term, df): how many texts hold each term."""
    return counted(texts, by, text=text).filter("term IS NOT NULL").groupBy(*by, "term").agg(F.sum("df").alias("df"))


def corpus_size(texts: DataFrame, by: list[str] = [], text: str = "text") -> DataFrame:  # noqa: B006
    """(by, n, avgdl): one row, or one per epoch."""
    sizes = counted(texts, by, text=text, terms=False).groupBy(*by).agg(F.coalesce(F.sum("df"), F.lit(0).cast("long")).alias("n"), F.sum("total").alias("total"))
    return sizes.select(*by, "n", F.try_divide("total", "n").alias("avgdl"))


def sizes_and_frequencies(texts: DataFrame, by: list[str] = []) -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """corpus_size and document_frequencies of one pass over the texts."""
    durable(texts.sparkSession)
    every = counted(texts, by).groupBy(*by, "term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).checkpoint()
    return every.filter("term IS NULL").select(*by, F.col("df").alias("n"), F.try_divide("total", "df").alias("avgdl")), every.filter("term IS NOT NULL").select(*by, "term", "df")


def active_chunks(chunks: DataFrame, publications: DataFrame, include: DataFrame | None = None) -> DataFrame:
    """The chunks (rev_id, ...) that statistics are of: those of active publications, and of the revisions in include.

    include (rev_id) names a revision that is about to be published.
    """
    counted = publications.filter("state = 'active'").select("rev_id")
    if include is not None:
        counted = counted.union(include.select("rev_id"))
    return chunks.join(counted.distinct(), "rev_id", "left_semi")


def statistics(chunks: DataFrame, stats_sha: str) -> tuple[DataFrame, DataFrame]:
    """An epoch to store: (stats_sha, n, avgdl) and (stats_sha, term, df)."""
    mark = F.lit(stats_sha).alias("stats_sha")
    size, frequencies = sizes_and_frequencies(chunks)
    return size.select(mark, "n", "avgdl"), frequencies.select(mark, "term", "df")


def epoch_for(record: dict | None, settings_sha: str, active: bool, policy: str = "live") -> str | None:
    """The recorded epoch's stats_sha that a publication joins, or None: then statistics are made anew.

    record (stats_sha, bm25) is the one of the last switch. A revision that is active already joins it; under the
    policy frozen every revision does. A record of other settings counts as none.
    """
    if policy not in ("live", "frozen"):
        raise ValueError(f"unknown policy {policy}")
    usable = record is not None and record.get("bm25") == settings_sha
    return record["stats_sha"] if usable and (active or policy == "frozen") else None


def version_part(record: dict | None) -> str:
    """What a publish job's version says of the epoch; init before the first."""
    return str(record["stats_sha"]) if record else "init"


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def weight(tf: Column, length: Column, df: Column, n: Column, avgdl: Column, p: Bm25 = Bm25()) -> Column:
    mean = F.when(avgdl > 0, avgdl).otherwise(F.lit(1.0))
    return idf(n, df) * (tf * (p.k1 + 1.0) / (tf + p.k1 * (1.0 - p.b + p.b * length / mean)))


def weights(counts: DataFrame, frequencies: DataFrame, size: DataFrame, by: list[str] = [], p: Bm25 = Bm25()) -> DataFrame:  # noqa: B006
    """counts with the weight w; terms without statistics drop out. size has a row per epoch and is broadcast."""
    joined = counts.join(frequencies, [*by, "term"])
    joined = joined.join(F.broadcast(size), by) if by else joined.crossJoin(F.broadcast(size))
    return joined.withColumn("w", weight(F.col("tf"), F.col("len"), F.col("df"), F.col("n"), F.col("avgdl"), p)).drop("df", "n", "avgdl")


def sparse_scores(query_weights: DataFrame, postings: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, query_id, chunk_id, score): dot products over shared terms, zero left out.

    query_weights (query_id, term, w) are joined to postings (chunk_id, term, w) on the term alone; only postings of
    terms that some query holds leave the scan's side.
    """
    q = query_weights.select(*by, "query_id", "term", F.col("w").alias("qw"))
    hit = postings.join(q, [*by, "term"])
    return hit.groupBy(*by, "query_id", "chunk_id").agg(F.sum(F.col("w") * F.col("qw")).alias("score")).filter("score <> 0")


def heavy_terms(texts: DataFrame, key: str, frequencies: DataFrame, size: DataFrame, k: int, p: Bm25 = Bm25(), most: int = 1 << 18) -> DataFrame:
    """The rows (key, len, term, tf) of term_counts that can be among a text's k greatest weights, equal ones included.

    Tasks know the frequencies of the commonest terms, so many at most. Any other term has a lower frequency than these,
    which bounds its weight from both sides; terms whose bound is below the k-th best of a text stay where they are.
    """
    spark = texts.sparkSession
    durable(spark)
    power = F.floor(F.log2("df")).cast("int")
    sizes = {r["power"]: r["n"] for r in frequencies.groupBy(power.alias("power")).agg(F.count("*").alias("n")).collect()}  # a row a power of two
    least, known = 1 + max(sizes, default=0), 0
    while least > 0 and known + sizes.get(least - 1, 0) <= most:
        known, least = known + sizes.get(least - 1, 0), least - 1
    common = {r["term"]: r["df"] for r in frequencies.filter(F.col("df") >= 1 << least).select("term", "df").toLocalIterator()}
    n, mean = size.select("n", "avgdl").first() or (0, None)
    shared = spark.sparkContext.broadcast(common)
    rare = max(1, (1 << least) - 1)

    def idf_of(df: np.ndarray) -> np.ndarray:
        return np.log(1 + (n - df + 0.5) / (df + 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            df = [get(t) for t in batch.column("term").to_pylist()]
            length, tf = batch.column("len").to_numpy().astype(np.float64), batch.column("tf").to_numpy().astype(np.float64)
            part = tf * (p.k1 + 1.0) / (tf + p.k1 * (1.0 - p.b + p.b * length / (mean if mean and mean > 0 else 1.0)))
            lower = idf_of(np.array([rare if x is None else x for x in df], np.float64)) * part
            upper = idf_of(np.array([1 if x is None else x for x in df], np.float64)) * part
            row = batch.column("row").to_numpy()
            order = np.lexsort((-lower, row))
            begin = np.flatnonzero(np.diff(row[order], prepend=-1))
            ends = np.append(begin[1:], len(order))
            at_k = np.minimum(begin + k, ends) - 1
            bound = np.where(ends - begin >= k, lower[order[at_k]], -np.inf) if len(begin) else np.zeros(0)
            kept = np.zeros(len(order), bool)
            # Weights are rounded to six decimals later.
            kept[order] = upper[order] >= np.repeat(bound, ends - begin) - 2e-6
            yield batch.filter(pa.array(kept)).select([key, "len", "term", "tf"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, "text").mapInArrow(lambda batches: run(_counted_rows(batches, 1)), f"{key} {kind}, len int, term string, tf long")


def top(scores: DataFrame, k: int, by: list[str], score: Column | None = None, tie: str = "chunk_id") -> DataFrame:
    """The k best rows per group with their rank; equal scores by id. The filter is pushed below the shuffle."""
    order = W.partitionBy(*by).orderBy((score if score is not None else F.col("score")).desc(), F.col(tie))
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


#: Cells of one block's table of terms and queries (eight bytes each), and terms that may be known on the driver.
CELLS, TERMS = 8 << 20, 1 << 20


def _question_blocks(queries: DataFrame) -> list[list[tuple]]:
    """The queries' (query_id, len, term, tf), in blocks of which each has a table of bounded size.

    Queries are a stated set: they come to the driver one after the other.
    """
    return _blocks((query, Counter(words(text))) for query, text in queries.select("query_id", "text").toLocalIterator())


def _blocks(questions: Iterable[tuple[object, Counter]]) -> list[list[tuple]]:
    blocks: list[list[tuple]] = [[]]
    terms: set[str] = set()
    n = 0
    for query, counted in questions:
        if not counted:
            continue
        more = terms | counted.keys()
        if blocks[-1] and (len(more) * (n + 1) > CELLS or len(more) > TERMS):
            blocks.append([])
            more, n = set(counted), 0
        terms, n = more, n + 1
        blocks[-1] += [(query, counted.total(), t, k) for t, k in counted.items()]
    return [b for b in blocks if b]


def _statistics(chunks: DataFrame, by: list[str], terms: list[str]) -> dict[tuple, tuple[int, float, dict[str, int]]]:
    """By epoch: n, avgdl and the document frequencies of terms, in one pass; as many rows as terms and epochs come back."""
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in chunks.select(*by).schema)
    wanted = chunks.sparkSession.sparkContext.broadcast(frozenset(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: dict[tuple, Counter] = defaultdict(Counter)
        size: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            epochs = zip(*(batch.column(i).to_pylist() for i in range(len(by))), strict=True) if by else [()] * batch.num_rows
            for e, text in zip(epochs, batch.column(len(by)).to_pylist(), strict=True):
                own = words(text)
                size[e][0] += 1
                size[e][1] += len(own)
                df[e].update(wanted.value.intersection(own))
        rows = [(*e, t, n, 0) for e, counted in df.items() for t, n in counted.items()] + [(*e, None, n, total) for e, (n, total) in size.items()]
        if rows:
            names = [*by, "term", "n", "total"]
            types = [*(batch.schema.field(i).type for i in range(len(by))), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    found = chunks.select(*by, "text").mapInArrow(run, f"{kinds}term string, n long, total long").groupBy(*by, "term").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out: dict[tuple, list] = defaultdict(lambda: [0, 0.0, {}])
    for r in found.collect():
        own = out[tuple(r[c] for c in by)]
        if r["term"] is None:
            own[0], own[1] = r["n"], r["total"] / r["n"]
        else:
            own[2][r["term"]] = r["n"]
    return {e: tuple(v) for e, v in out.items()}


def asked_statistics(chunks: DataFrame, queries: DataFrame) -> tuple[int, float, dict[str, int]]:
    """n, avgdl and the document frequencies of the queries' terms: tasks hand on no other term."""
    terms = {t for r in queries.select("text").toLocalIterator() for t in words(r["text"])}
    return _statistics(chunks, [], sorted(terms)).get((), (0, 0.0, {}))


def search(chunks: DataFrame, queries: DataFrame, k: int = 20, by: list[str] = [], p: Bm25 = Bm25(), only: Column | None = None) -> DataFrame:  # noqa: B006
    """Top k chunks of each query: (by, query_id, chunk_id, score, rank); scores are rounded to six decimals.

    The statistics are of all chunks; only says which of them may be found, so a filter changes no score. The corpus is
    read twice: for the statistics of the queries' terms, and to score. A chunk is scored where it lies, against all
    queries of a block at once, and a task hands on its k best of each query when it has seen all its chunks: no posting
    and no (query, chunk) pair is shuffled. Blocks hold as many queries as a table of bounded size does.
    """
    spark = chunks.sparkSession
    own = chunks.select(*by, "chunk_id", "text")
    searched = own if only is None else chunks.filter(only).select(*by, "chunk_id", "text")
    kinds = {f.name: f.dataType for f in own.schema} | {"query_id": queries.schema["query_id"].dataType}
    names = [*by, "query_id", "chunk_id", "score"]
    schema = ", ".join(f"{c} {kinds[c].simpleString()}" for c in names[:-1]) + ", score double"
    types = [*(to_arrow_type(kinds[c]) for c in names[:-1]), pa.float64()]
    found = None
    for block in _question_blocks(queries):
        terms = sorted({r[2] for r in block})
        asked = sorted({r[0] for r in block})
        epochs = _statistics(own, by, terms)
        shared = spark.sparkContext.broadcast({e: _Block(block, asked, *stats, p) for e, stats in epochs.items() if stats[0]})

        def run(batches: Iterator[pa.RecordBatch], shared=shared, asked=asked) -> Iterator[pa.RecordBatch]:
            best: dict[tuple, _Best] = {}
            for batch in batches:
                groups: dict[tuple, list[int]] = defaultdict(list)
                for i, e in enumerate(zip(*(batch.column(n).to_pylist() for n in range(len(by))), strict=True) if by else [()] * batch.num_rows):
                    groups[e].append(i)
                ids, texts = batch.column(len(by)).to_pylist(), batch.column(len(by) + 1).to_pylist()
                for e, rows in groups.items():
                    if e in shared.value:
                        rows.sort(key=lambda i: (ids[i] is not None, ids[i]))
                        kept = best.setdefault(e, _Best(len(asked), k))
                        row, query, score = shared.value[e].best([words(texts[i]) for i in rows], k, kept.least)
                        kept.add([ids[rows[i]] for i in row], query, score)
            out = [(*e, asked[q], i, s) for e, kept in best.items() for q, i, s in kept.rows()]
            for at in range(0, len(out), 10_000):
                columns = list(zip(*out[at : at + 10_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        scored = searched.mapInArrow(run, schema)
        found = scored if found is None else found.unionAll(scored)
    if found is None:
        found = spark.createDataFrame([], schema)
    return top(found, k, [*by, "query_id"])


class _Best:
    """A task's k best of each query so far, by score and then by id (nulls first)."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.held: list[list[tuple]] = [[] for _ in range(queries)]
        self.least = np.zeros(queries)  # a hit of a smaller score isn't among the best

    def add(self, ids: list, queries: list[int], scores: np.ndarray) -> None:
        for i, q, s in zip(ids, queries, scores.tolist(), strict=True):
            own = self.held[q]
            own.append((-s, i is not None, i))
            if len(own) >= 2 * self.k:
                self._cut(q)

    def _cut(self, q: int) -> None:
        own = self.held[q]
        own.sort()
        del own[self.k :]
        if len(own) == self.k:
            self.least[q] = -own[-1][0]

    def rows(self) -> Iterator[tuple[int, object, float]]:
        for q, own in enumerate(self.held):
            self._cut(q)
            yield from ((q, i, -s) for s, _, i in own)


class _Block:
    """A block of queries under one epoch's statistics: the weight of each of its terms in each query."""

    zeros = False  # whether a text with a term is a hit though its score is rounded to zero

    def __init__(self, block: list[tuple], asked: list, n: int, avgdl: float, df: dict[str, int], p: Bm25):
        self.p, self.mean = p, avgdl if avgdl and avgdl > 0 else 1.0
        self.number = {t: i for i, t in enumerate(sorted(df))}
        counts = np.array([df[t] for t in sorted(df)], np.float64)
        self.idf = np.log(1 + (n - counts + 0.5) / (counts + 0.5))
        place = {q: i for i, q in enumerate(asked)}
        self.weights = np.zeros((len(df), len(asked)))
        for query, size, term, tf in block:
            if term in self.number:
                at = self.number[term]
                self.weights[at, place[query]] = self.idf[at] * self._saturated(tf, size)

    def _saturated(self, tf, size):
        return tf * (self.p.k1 + 1.0) / (tf + self.p.k1 * (1.0 - self.p.b + self.p.b * size / self.mean))

    def counted(self, text: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
        """A text's known terms, by number, how often it has them, and its length."""
        terms, tf = np.unique(np.array([n for n in map(self.number.get, text) if n is not None], np.int64), return_counts=True)
        return terms, tf, len(text)

    def best(self, texts: list, k: int, least: np.ndarray) -> tuple[list[int], list[int], np.ndarray]:
        """(row, query, score) of each query's k best texts of a score of least or more; zeros are no hits.

        Of equal scores the earlier rows are kept.
        """
        scores = np.zeros((len(texts), self.weights.shape[1]))
        for i, own in enumerate(texts):
            terms, tf, size = self.counted(own)
            if len(terms):
                scores[i] = (self.idf[terms] * self._saturated(tf, size)) @ self.weights[terms]
        raw, scores = scores, np.round(scores, 6)
        if len(texts) > k:
            # The k-th best of this batch bounds what can matter of it.
            least = np.maximum(least, np.partition(scores, len(texts) - k, axis=0)[len(texts) - k])
        row, query = np.nonzero(((raw if self.zeros else scores) > 0) & (scores >= least))
        return row.tolist(), query.tolist(), scores[row, query]
