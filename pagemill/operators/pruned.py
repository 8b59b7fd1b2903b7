"""Exact top-k over stored blocks, most of which are never scored: an inverted index and vector cells.

An index is a table of blocks. Each holds some chunks and what bounds their scores: an inverted block has, for each of its
terms, the greatest impact of any of its chunks; a cell has a centre and a radius. No chunk of a block can score more
than the block's bound, so a block whose bound is below a query's k-th best score so far is skipped, and nothing is lost.

A search has two rounds. First only the bounds are read (the postings' and vectors' columns are not), and each query's
``first`` most promising blocks are scored: the k-th best score there is what any further hit must reach. Then every task
goes through its blocks with that threshold, which rises as the task finds better hits, and scores what isn't below. Both
rounds run where the blocks lie; a task hands on at most its k best of each query. Queries are a stated set and go to the
tasks in blocks of bounded size.

Blocks are cut along an order (of ids or lengths within a part of the chunks, or of cells and distances, dealt by ranges),
so that no cell or key, however common, has to fit one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pagemill.operators.bm25 import _Best, _Block, _question_blocks, corpus_size, top, words
from pagemill.session import durable
from pagemill.settings import Bm25

#: Rounding of scores to six decimals can lift one above its bound by so much.
SLACK = 1e-6

#: Cells of a table of some blocks and their terms or queries (eight bytes each), and blocks that are handed on together.
CELLS, TOGETHER = 4 << 20, 64


def _kind(frame: DataFrame, column: str) -> str:
    return frame.schema[column].dataType.simpleString()


def _cut(frame: DataFrame, order: list[str], parts: int, rows: int, schema: str, block: Callable[[int, pa.RecordBatch], list[pa.Array]], split: str | None = None) -> DataFrame:
    """Blocks of at most so many rows that follow one another in an order, none across two values of split.

    Without split, rows are dealt by chunk_id and each part has an order of its own: parts are of like bytes then, though
    the order may be by length, and the rows needn't be read before for the limits of ranges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def whole() -> pa.RecordBatch:
            return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        def made(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal number
            row = block(number, batch)
            number += 1
            return pa.RecordBatch.from_arrays(row, [n for n, *_ in _fields(schema)])

        def blocks() -> Iterator[pa.RecordBatch]:
            nonlocal held
            for batch in batches:
                held.append(batch)
                if sum(b.num_rows for b in held) < rows:
                    continue
                every, at = whole(), 0
                while every.num_rows - at >= rows:
                    end = _end(every, at, rows, split)
                    yield made(every.slice(at, end - at))
                    at = end
                held = [every.slice(at)] if at < every.num_rows else []
            if held and sum(b.num_rows for b in held):
                every, at = whole(), 0
                while at < every.num_rows:
                    end = _end(every, at, rows, split)
                    yield made(every.slice(at, end - at))
                    at = end

        kept, size = [], 0
        for one in blocks():
            kept.append(one)
            size += one.nbytes
            if len(kept) == TOGETHER or size > 8 << 20:
                yield from pa.Table.from_batches(kept).combine_chunks().to_batches()
                kept, size = [], 0
        if kept:
            yield from pa.Table.from_batches(kept).combine_chunks().to_batches()

    dealt = frame.repartitionByRange(parts, *order) if split else frame.repartition(parts, "chunk_id")
    return dealt.sortWithinPartitions(*order).mapInArrow(run, schema)


def _end(batch: pa.RecordBatch, at: int, rows: int, split: str | None) -> int:
    end = min(at + rows, batch.num_rows)
    if split is None:
        return end
    own = batch.column(split).slice(at, end - at).to_numpy(zero_copy_only=False)
    other = np.flatnonzero(own != own[0])
    return at + int(other[0]) if len(other) else end


def _one(values: pa.Array) -> pa.Array:
    """A column of lists with these values as its only row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _slices(ends: np.ndarray, more: int) -> Iterator[tuple[int, int]]:
    """Rows in runs of which each has a table of bounded size, by how many columns they have up to each row, and have in common."""
    a = 0
    while a < len(ends):
        before, b = ends[a - 1] if a else 0, a + 1
        while b < len(ends) and (b + 1 - a) * (ends[b] - before + more) <= CELLS:
            b += 1
        yield a, b
        a = b


def _fields(schema: str) -> list[list[str]]:
    return [f.split(" ", 1) for f in schema.split(", ")]


# An inverted index


def inverted(chunks: DataFrame, order: list[str] = ["chunk_id"], rows: int = 16, parts: int | None = None, p: Bm25 = Bm25(), avgdl: float | None = None) -> DataFrame:  # noqa: B006
    """(block, n, chunk_ids, terms, tops, ends, at, impacts): a row for each block of chunks (chunk_id, text, ...).

    Terms are joined by spaces (null if there are none), numbers are packed (doubles, and 32-bit integers for ends and at):
    lists would be copied item by item between Spark and its tasks.

    Of each term of a block: the greatest impact, and where its postings end; of each posting the chunk's number in the
    block and its impact, the saturated term frequency under the corpus' mean length (counted, unless it is given). Bounds
    are the closer, the more a block's texts are alike: order by what they share, such as language, topic or length.
    """
    mean = avgdl if avgdl is not None else corpus_size(chunks).first()["avgdl"]
    mean = mean if mean and mean > 0 else 1.0
    schema = f"block long, n int, chunk_ids array<{_kind(chunks, 'chunk_id')}>, terms string, tops binary, ends binary, at binary, impacts binary"

    def block(number: int, batch: pa.RecordBatch) -> list[pa.Array]:
        term, tf, size, distinct = [], [], [], []
        for text in batch.column("text").to_pylist():
            found = words(text)
            counted = Counter(found)
            term += counted
            tf += counted.values()
            size.append(len(found))
            distinct.append(len(counted))
        coded = pa.array(term, pa.string()).dictionary_encode()
        of, at = coded.indices.to_numpy(), np.repeat(np.arange(batch.num_rows, dtype=np.int32), distinct)
        tf, size = np.array(tf, np.float64), np.array(size, np.float64)[at]
        order = np.argsort(of, kind="stable")
        impacts = (tf * (p.k1 + 1.0) / (tf + p.k1 * (1.0 - p.b + p.b * size / mean)))[order]
        ends = np.cumsum(np.bincount(of, minlength=len(coded.dictionary)))
        tops = np.maximum.reduceat(impacts, np.concatenate([[0], ends[:-1]])) if len(ends) else impacts
        names = pc.binary_join(_one(coded.dictionary), " ") if len(ends) else pa.array([None], pa.string())
        packed = (pa.array([x.tobytes()], pa.binary()) for x in (tops, ends.astype(np.int32), at[order], impacts))
        return [pa.array([number], pa.int64()), pa.array([batch.num_rows], pa.int32()), _one(batch.column("chunk_id")), names, *packed]

    parts = parts or max(1, int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return _cut(chunks.select(*dict.fromkeys([*order, "chunk_id", "text"])), order, parts, rows, schema, block)


class _Terms:
    """A block of queries against inverted blocks."""

    columns = ("terms", "tops")

    def __init__(self, block: _Block):
        self.names, self.queries = pa.array(list(block.number), pa.string()), block.weights.shape[1]
        self.factors = block.weights * block.idf[:, None]

    def rows(self, batch: pa.RecordBatch) -> _TermRows:
        return _TermRows(self, batch)


class _TermRows:
    """A batch of inverted blocks, whose lists are read where they lie."""

    def __init__(self, own: _Terms, batch: pa.RecordBatch):
        self.own, self.batch = own, batch
        listed = pc.split_pattern(batch.column("terms"), " ")
        offsets, terms = listed.offsets.to_numpy(), listed.values
        number = pc.index_in(terms, value_set=own.names.cast(terms.type)).fill_null(-1).to_numpy()
        self.place = np.flatnonzero(number >= 0)
        self.known = number[self.place]
        #: Where each block's known terms begin and end.
        self.at = np.searchsorted(self.place, offsets)
        self.tops = _packed(batch, "tops", np.float64)[1][self.place]
        if "ends" in batch.schema.names:
            ends = _packed(batch, "ends", np.int32)[1]
            begins = np.concatenate([[0], ends])[: len(ends)]
            begins[offsets[:-1][np.diff(offsets) > 0]] = 0
            self.begins, self.sizes = begins[self.place], (ends - begins)[self.place]
            self.postings, self.chunk = _packed(batch, "at", np.int32)
            self.impacts = _packed(batch, "impacts", np.float64)[1]

    def bounds(self, counted: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
        """The bounds of some blocks for every query, from which block on, and if asked for how many postings it has there."""
        factors = self.own.factors
        for a, b in _slices(self.at[1:] - self.at[0], self.own.queries):
            some = slice(self.at[a], self.at[b])
            terms, column = np.unique(self.known[some], return_inverse=True)
            cell = np.repeat(np.arange(b - a), np.diff(self.at[a : b + 1])), column
            table, of = np.zeros((b - a, len(terms))), factors[terms]
            table[cell] = self.tops[some]
            bounds, units = table @ of, None
            if counted:
                table[cell] = self.sizes[some]
                units = (table @ (of != 0)).astype(np.int64)
            yield a, bounds, units

    def scores(self, row: int, queries: np.ndarray) -> np.ndarray:
        """The scores of all chunks of a block for some queries."""
        own = slice(self.at[row], self.at[row + 1])
        known, sizes, begins = self.known[own], self.sizes[own], self.begins[own]
        factors = self.own.factors[known] if len(queries) == self.own.queries else self.own.factors[np.ix_(known, queries)]
        wanted = factors.any(axis=1)
        factors, sizes, begins = factors[wanted], sizes[wanted], begins[wanted]
        where = self.postings[row] + np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        table = np.zeros((self.batch.column("n")[row].as_py(), len(sizes)))
        table[self.chunk[where], np.repeat(np.arange(len(sizes)), sizes)] = self.impacts[where]
        return table @ factors


def _packed(batch: pa.RecordBatch, name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Where the packed numbers of each row begin and end in those of all rows, and these."""
    rows = batch.column(name).to_pylist()
    return np.cumsum([0, *map(len, rows)]) // np.dtype(kind).itemsize, np.frombuffer(b"".join(rows), kind)


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, pa.Array]:
    """Where the lists of a column begin and end in their values, and those."""
    column = batch.column(name)
    return column.offsets.to_numpy(), column.values


def _numbers(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    offsets, values = _flat(batch, name)
    return offsets, values.to_numpy(zero_copy_only=False)


def search(index: DataFrame, frequencies: DataFrame | dict[str, int], n: int, avgdl: float, queries: DataFrame, k: int = 20, first: int = 4, p: Bm25 = Bm25()) -> tuple[DataFrame, DataFrame]:
    """The hits (query_id, chunk_id, score, rank) of bm25.search, and what of the index it took to find them.

    index: of inverted(); frequencies (term, df), n and avgdl: the epoch's; the frequencies may also come as those of the
    queries' terms alone, by term. The report is (query_id, blocks, scored, postings, postings_read).
    """
    spark = index.sparkSession
    hits, reports = [], []
    for block in _question_blocks(queries):
        terms = sorted({r[2] for r in block})
        asked = sorted({r[0] for r in block})
        if isinstance(frequencies, dict):
            df = {t: frequencies[t] for t in terms if t in frequencies}
        else:
            wanted = spark.createDataFrame([(t,) for t in terms], "term string")
            df = {r.term: r.df for r in frequencies.join(F.broadcast(wanted), "term").collect()}  # as many as the block's terms
        scorer = _Terms(_Block(block, asked, n, avgdl, df, p))
        h, r = _pruned(index, scorer, asked, queries, k, first)
        hits.append(h)
        reports.append(r.select("query_id", "blocks", "scored", F.col("units").alias("postings"), F.col("units_read").alias("postings_read")))
    return _together(hits, queries, index, k), _union(reports)


# Vector cells


def cells(vectors: DataFrame, pivots: int = 64, rows: int = 256, sample: int = 20_000, parts: int | None = None) -> DataFrame:
    """(block, n, chunk_ids, centre, radius, vectors): blocks of vectors (chunk_id, vector) that lie near one another.

    Pivots are fitted on a sample of that many vectors, those of the least hashes of their ids; every vector is dealt to
    its nearest pivot. A block's centre and radius are its own vectors', so they hold whatever the pivots are.
    """
    spark = vectors.sparkSession
    fitted = vectors.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("vector")
    points = np.array([r[0] for r in fitted.collect()], np.float64)
    centres = spark.sparkContext.broadcast(_pivots(points, pivots))
    kind = _kind(vectors, "chunk_id")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, c = np.array(batch.column(1).to_pylist(), np.float64), centres.value
                apart = (own**2).sum(1)[:, None] - 2 * own @ c.T + (c**2).sum(1)[None]
                cell = apart.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(apart[np.arange(len(own)), cell])], ["chunk_id", "vector", "cell", "apart"])

    dealt = vectors.select("chunk_id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(deal, f"chunk_id {kind}, vector array<double>, cell int, apart double")
    schema = f"block long, n int, chunk_ids array<{kind}>, centre array<double>, radius double, vectors array<array<double>>"

    def block(number: int, batch: pa.RecordBatch) -> list[pa.Array]:
        listed = batch.column("vector")
        own = np.array(listed.to_pylist(), np.float64)
        centre = own.mean(0)
        radius = float(np.sqrt(((own - centre) ** 2).sum(1).max())) * (1 + 1e-12)
        return [pa.array([number], pa.int64()), pa.array([batch.num_rows], pa.int32()), _one(batch.column("chunk_id")), _one(pa.array(centre)), pa.array([radius]), _one(listed)]

    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return _cut(dealt, ["cell", "apart", "chunk_id"], parts, rows, schema, block, split="cell")


def _pivots(points: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Means of nearest points, from points spread over the sample."""
    if not len(points):
        return np.zeros((1, 1))
    points = np.unique(points, axis=0)
    centres = points[np.linspace(0, len(points) - 1, min(n, len(points))).astype(int)]
    for _ in range(rounds):
        near = ((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)[None]).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
    return centres


class _Vectors:
    """Query vectors against cells: no dot product with a vector within a radius of the centre exceeds q·c + |q| r."""

    columns = ("centre", "radius")

    def __init__(self, matrix: np.ndarray):
        self.matrix, self.queries = matrix, len(matrix)
        self.norms = np.sqrt((matrix**2).sum(1))

    def rows(self, batch: pa.RecordBatch) -> _VectorRows:
        return _VectorRows(self, batch)


class _VectorRows:
    """A batch of cells, whose vectors are read where they lie."""

    def __init__(self, own: _Vectors, batch: pa.RecordBatch):
        self.own, self.batch = own, batch
        offsets, centres = _numbers(batch, "centre")
        self.centres = centres[offsets[0] : offsets[-1]].reshape(batch.num_rows, self.own.matrix.shape[1])
        self.radius = batch.column("radius").to_numpy()

    def bounds(self, counted: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
        """The bounds of some cells for every query, from which cell on, and if asked for how many vectors it has there."""
        matrix, norms = self.own.matrix, self.own.norms
        for a, b in _slices(np.zeros(len(self.centres), np.int64), max(1, self.own.queries)):
            bounds = (self.centres[a:b] @ matrix.T + self.radius[a:b, None] * norms) * (1 + 1e-12) + 1e-12
            yield a, bounds, np.repeat(self.batch.column("n").to_numpy()[a:b, None], len(norms), axis=1) if counted else None

    def scores(self, row: int, queries: np.ndarray) -> np.ndarray:
        """The products of a cell's vectors with some queries."""
        own = self.batch.column("vectors")[row].values.flatten().to_numpy(zero_copy_only=False)
        matrix = self.own.matrix[queries]
        return own.reshape(-1, matrix.shape[1]) @ matrix.T


def dense(index: DataFrame, queries: DataFrame, k: int, first: int = 4, query_bytes: int = 16 << 20) -> tuple[DataFrame, DataFrame]:
    """The hits of hybrid.dense_topk for queries (query_id, query), and (query_id, blocks, scored, vectors, vectors_read)."""
    hits, reports, block, size = [], [], [], 0

    def ask() -> None:
        asked = [r[0] for r in block]
        h, r = _pruned(index, _Vectors(np.array([r[1] for r in block], np.float64)), asked, queries, k, first)
        hits.append(h)
        reports.append(r.select("query_id", "blocks", "scored", F.col("units").alias("vectors"), F.col("units_read").alias("vectors_read")))

    for row in queries.select("query_id", "query").toLocalIterator():
        if block and size + 8 * len(row["query"]) > query_bytes:
            ask()
            block, size = [], 0
        block.append((row["query_id"], row["query"]))
        size += 8 * len(row["query"])
    if block:
        ask()
    return _together(hits, queries, index, k, zeros=True), _union(reports)


# Both


def _pruned(index: DataFrame, scorer, asked: list, queries: DataFrame, k: int, first: int) -> tuple[DataFrame, DataFrame]:
    """The k best of each query, or more, and (query_id, blocks, scored, units, units_read)."""
    spark = index.sparkSession
    durable(spark)
    shared = spark.sparkContext.broadcast(scorer)
    sparse = isinstance(scorer, _Terms)
    query_kind, chunk_kind = _kind(queries, "query_id"), index.schema["chunk_ids"].dataType.elementType.simpleString()

    def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, best = shared.value, _Best(len(asked), first)
        best.least[:] = -np.inf
        for batch in filter(len, batches):
            number = batch.column("block").to_pylist()
            for a, bounds, _ in own.rows(batch).bounds():
                least = best.least
                if len(bounds) > first:
                    # The first-best of these bounds is what any of them must reach.
                    least = np.maximum(least, np.partition(bounds, len(bounds) - first, axis=0)[len(bounds) - first])
                at, q = np.nonzero((bounds >= least) & ((bounds > 0) | (not sparse)))
                best.add([number[a + i] for i in at.tolist()], q.tolist(), bounds[at, q])
        rows = list(best.rows())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.float64()))], ["q", "block", "bound"])

    chosen = index.select("block", *scorer.columns).mapInArrow(promising, "q int, block long, bound double")
    chosen = top(chosen, first, ["q"], F.col("bound"), "block").select("block").distinct()

    def scored(least: np.ndarray, report: bool):
        levels = spark.sparkContext.broadcast(least)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, best = shared.value, _Best(len(asked), k)
            best.least[:] = levels.value
            seen, read, units, units_read = 0, *np.zeros((3, len(asked)), np.int64)
            for batch in filter(len, batches):
                rows = own.rows(batch)
                begins, ids = _flat(batch, "chunk_ids")
                ids = ids.to_pylist()
                for row, bounds, of in ((a + i, bounds[i], of[i] if report else None) for a, bounds, of in rows.bounds(report) for i in range(len(bounds))):
                    some = np.flatnonzero((bounds + SLACK >= best.least) & ((bounds > 0) | (not sparse)))
                    if report:
                        seen += 1
                        read[some] += 1
                        units += of
                        units_read[some] += of[some]
                    if not len(some):
                        continue
                    scores = np.round(rows.scores(row, some), 6)
                    at, q = np.nonzero((scores >= best.least[some]) & ((scores > 0) | (not sparse)))
                    best.add([ids[begins[row] + i] for i in at.tolist()], some[q].tolist(), scores[at, q])
            out = [(asked[q], i, s, None, None, None, None) for q, i, s in best.rows()]
            if report:
                out += [(asked[q], None, None, seen, int(read[q]), int(units[q]), int(units_read[q])) for q in range(len(asked))]
            for at in range(0, len(out), 10_000):
                columns = list(zip(*out[at : at + 10_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        return run

    names = ["query_id", "chunk_id", "score", "blocks", "scored", "units", "units_read"]
    types = [to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(index.schema["chunk_ids"].dataType.elementType), pa.float64(), *[pa.int64()] * 4]
    schema = f"query_id {query_kind}, chunk_id {chunk_kind}, score double, blocks long, scored long, units long, units_read long"
    lowest = 0.0 if sparse else -np.inf
    begun = top(index.join(F.broadcast(chosen), "block", "left_semi").mapInArrow(scored(np.full(len(asked), lowest), False), schema), k, ["query_id"]).filter(F.col("rank") == k)
    reached = {r["query_id"]: r["score"] for r in begun.select("query_id", "score").collect()}  # a number for each query
    least = np.array([reached.get(q, lowest) for q in asked])
    found = index.mapInArrow(scored(least, True), schema).checkpoint()
    report = found.filter("blocks IS NOT NULL").groupBy("query_id").agg(*(F.sum(c).alias(c) for c in ("blocks", "scored", "units", "units_read")))
    return found.filter("blocks IS NULL").select("query_id", "chunk_id", "score"), report


def _union(frames: list[DataFrame]) -> DataFrame | None:
    out = None
    for f in frames:
        out = f if out is None else out.unionAll(f)
    return out


def _together(hits: list[DataFrame], queries: DataFrame, index: DataFrame, k: int, zeros: bool = False) -> DataFrame:
    every = _union(hits)
    if every is None:
        every = queries.sparkSession.createDataFrame([], f"query_id {_kind(queries, 'query_id')}, chunk_id {index.schema['chunk_ids'].dataType.elementType.simpleString()}, score double")
    return top(every, k, ["query_id"])
