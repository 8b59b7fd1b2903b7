"""Dense top-k, reciprocal-rank fusion, validation, top-up rounds and budgeted selection, for many queries at once."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pagemill.operators.bm25 import search as bm25_search
from pagemill.operators.bm25 import top
from pagemill.session import durable
from pagemill.settings import Search


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def normalized(vector: Column) -> Column:
    """The vector at length one; a zero vector raises an error."""
    norm = F.sqrt(dot(vector, vector))
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm)).otherwise(F.raise_error(F.lit("zero vector")).cast("array<double>"))


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, query_bytes: int = 64 << 20) -> DataFrame:
    """(query_id, chunk_id, score, rank) over vectors (chunk_id, vector) for queries (query_id, query).

    Queries are a stated set, asked in blocks of at most query_bytes. A task holds its vectors against a block by matrix
    products, which say what can be among its k best; only that is scored by dot(), in its order of additions, and only the
    k best leave the task. Vectors and queries that aren't numbers alone, all of one length, are scored one by one.
    """
    sound = lambda c, n: (F.size(c) == n) & F.forall(c, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    sized = queries.select(F.size("query").alias("n")).agg(F.max("n").alias("n"), F.count("*").alias("rows")).first()
    dims = sized["n"] or 0
    good = lambda c: F.coalesce(sound(c, dims), F.lit(False)) if dims > 0 else F.lit(False)
    every = vectors.agg(F.count("*").alias("n"), F.count_if(~good(F.col("vector"))).alias("odd")).first()
    odd_queries = queries.filter(~good(F.col("query")))
    odd = odd_queries.count()
    found = [_one_by_one(vectors, odd_queries, query_bytes)] if odd else []
    if odd < sized["rows"]:
        asked = queries.filter(good(F.col("query")))
        if every["odd"]:
            found.append(_one_by_one(vectors.filter(~good(F.col("vector"))), asked, query_bytes))
        # As many tasks as the work is worth: each hands on k hits of every query.
        wanted = -(-every["n"] * sized["rows"] * dims // (1 << 32))
        parts = max(1, min(wanted, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        dealt = vectors.filter(good(F.col("vector"))).select("chunk_id", F.col("vector").cast("array<double>").alias("vector")).repartition(parts)
        found += _by_products(dealt, asked, k, dims, query_bytes)
    out = found[0] if found else _one_by_one(vectors, queries, query_bytes)
    for f in found[1:]:
        out = out.unionAll(f)
    return top(out, k, ["query_id"])


def _one_by_one(vectors: DataFrame, queries: DataFrame, query_bytes: int) -> DataFrame:
    """(query_id, chunk_id, score) of all pairs, scored where the vectors lie."""
    first = queries.select(F.size("query").alias("n")).agg(F.max("n").alias("n"), F.count("*").alias("rows")).first()
    blocks = max(1, -(-(first["n"] or 0) * 8 * first["rows"] // query_bytes))
    out = None
    for i in range(blocks):
        block = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        scored = vectors.crossJoin(F.broadcast(block)).select("query_id", "chunk_id", F.round(dot(F.col("vector"), F.col("query")), 6).alias("score"))
        out = scored if out is None else out.unionAll(scored)
    return out


def _by_products(vectors: DataFrame, queries: DataFrame, k: int, dims: int, query_bytes: int, rows: int = 4096) -> list[DataFrame]:
    """(query_id, chunk_id, score), for each block of queries: the k best of every task that vectors lie in."""
    spark = vectors.sparkSession
    kinds = [queries.schema["query_id"].dataType, vectors.schema["chunk_id"].dataType]
    query_kind, kind = map(to_arrow_type, kinds)
    schema = f"query_id {kinds[0].simpleString()}, chunk_id {kinds[1].simpleString()}, score double"
    found, ids, held = [], [], []

    def ask() -> None:
        shared = spark.sparkContext.broadcast((pa.array(ids, query_kind), np.array(held, np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, asked = shared.value
            best = _Nearest(asked, k, kind)
            held: list[pa.RecordBatch] = []
            for batch in batches:
                held.append(batch)
                if sum(b.num_rows for b in held) >= rows:
                    best.see(pa.Table.from_batches(held).combine_chunks())
                    held = []
            if sum(b.num_rows for b in held):
                best.see(pa.Table.from_batches(held).combine_chunks())
            for part in best.hits().to_batches(10_000):
                yield pa.RecordBatch.from_arrays([names.take(part["q"]), part["id"], part["score"]], ["query_id", "chunk_id", "score"])

        found.append(vectors.mapInArrow(run, schema))

    for row in queries.select("query_id", F.col("query").cast("array<double>")).toLocalIterator():
        ids.append(row[0])
        held.append(row[1])
        if 8 * dims * len(held) >= query_bytes:
            ask()
            ids, held = [], []
    if held:
        ask()
    return found


class _Nearest:
    """A task's k best vectors of each query so far, by rounded score and then by id (nulls first)."""

    def __init__(self, asked: np.ndarray, k: int, kind: pa.DataType):
        self.asked, self.k = asked, k
        self.norms = np.sqrt((asked**2).sum(1))
        self.least = np.full(len(asked), -np.inf)  # a hit of a smaller score isn't among the best
        self.names = {"q": pa.int32(), "id": kind, "score": pa.float64()}
        self.kept = pa.Table.from_arrays([pa.array([], t) for t in self.names.values()], list(self.names))
        self.new: list[pa.Table] = []

    def see(self, batch: pa.Table, queries: int = 1024, pairs: int = 1 << 16) -> None:
        batch = batch.take(pc.sort_indices(batch, sort_keys=[("chunk_id", "ascending")], null_placement="at_start"))
        own = batch["vector"].combine_chunks().flatten().to_numpy().reshape(batch.num_rows, -1)
        # Of equal vectors only the k first ids can matter.
        _, group = np.unique(own.view(np.dtype((np.void, own.itemsize * own.shape[1]))).ravel(), return_inverse=True)
        order = np.argsort(group, kind="stable")
        begin = np.flatnonzero(np.diff(group[order], prepend=-1))
        place = np.arange(len(order)) - np.repeat(begin, np.diff(begin, append=len(order)))
        some = np.sort(order[place < self.k])
        own, ids = own[some], batch["chunk_id"].combine_chunks().take(pa.array(some))
        longest = np.sqrt((own**2).sum(1).max())
        for at in range(0, len(self.asked), queries):
            asked, least = self.asked[at : at + queries], self.least[at : at + queries]
            near = asked @ own.T
            slack = 1e-6 + 1e-12 * self.norms[at : at + queries] * longest
            bound = least - slack
            fresh = np.flatnonzero(np.isinf(least))
            if len(fresh) and len(own) > self.k:
                # The k-th best of this batch bounds what can matter of it.
                bound[fresh] = np.partition(near[fresh], len(own) - self.k, axis=1)[:, len(own) - self.k] - 2 * slack[fresh]
            q, row = np.nonzero(near >= bound[:, None])
            for i in range(0, len(q), pairs):
                self._add(q[i : i + pairs] + at, row[i : i + pairs], own, ids)
        self._cut()

    def _add(self, q: np.ndarray, row: np.ndarray, own: np.ndarray, ids: pa.Array) -> None:
        # One addition after the other, as dot() has them.
        score = rounded(np.add.accumulate(own[row] * self.asked[q], axis=1)[:, -1])
        self.new.append(pa.Table.from_arrays([pa.array(q.astype(np.int32)), ids.take(pa.array(row)), pa.array(score)], list(self.names)))
        if sum(t.num_rows for t in self.new) > 1 << 20:
            self._cut()

    def _cut(self) -> None:
        if not self.new:
            return
        every = pa.concat_tables([self.kept, *self.new]).combine_chunks()
        every = every.take(pc.sort_indices(every, sort_keys=[("q", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_start"))
        q = every["q"].to_numpy()
        begin = np.flatnonzero(np.diff(q, prepend=-1))
        place = np.arange(len(q)) - np.repeat(begin, np.diff(begin, append=len(q)))
        last = place == self.k - 1
        self.least[q[last]] = every["score"].to_numpy()[last]
        self.kept, self.new = every.filter(pa.array(place < self.k)), []

    def hits(self) -> pa.Table:
        self._cut()
        return self.kept.combine_chunks()


def rounded(scores: np.ndarray) -> np.ndarray:
    """Six decimals, halves away from zero, as Spark's round of doubles has them."""
    out = np.round(scores, 6)
    large = np.abs(scores) > 1e8
    for i in np.flatnonzero(large | (np.abs(np.abs(scores * 1e6 - np.rint(scores * 1e6)) - 0.5) < 1e-3)).tolist():
        out[i] = float(Decimal(repr(float(scores[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP, Context(prec=400)))
    return out + 0.0


def fuse(lists: DataFrame, rrf_k: int = 60) -> DataFrame:
    """(query_id, chunk_id, rrf, dense_rank, sparse_rank, rank) of ranked lists (query_id, side, epoch, chunk_id, rank).

    Every list adds 1 / (rrf_k + rank); of each side the rank in the list of the first epoch is kept.
    """
    side = lambda name: F.min_by(F.when(F.col("side") == name, F.col("rank")), F.when(F.col("side") == name, F.col("epoch")))
    fused = lists.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(1.0 / (rrf_k + F.col("rank"))), 9).alias("rrf"), side("dense").alias("dense_rank"), side("sparse").alias("sparse_rank")
    )
    return fused.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("rrf"), "chunk_id")))


def validate(hits: DataFrame, chunks: DataFrame, revisions: DataFrame, publications: DataFrame) -> DataFrame:
    """Hits whose chunk exists, whose revision is active and published, and whose payload says the same as the row."""
    rows = chunks.select("chunk_id", F.col("rev_id").alias("row_rev"))
    alive = revisions.filter("is_active").select(F.col("rev_id").alias("row_rev"), F.col("doc_id").alias("row_doc"))
    published = publications.filter("state = 'active'").select(F.col("rev_id").alias("row_rev")).distinct()
    met = hits.join(rows, "chunk_id").join(alive, "row_rev").join(published, "row_rev", "left_semi")
    return met.filter(F.col("rev_id").eqNullSafe(F.col("row_rev")) & F.col("doc_id").eqNullSafe(F.col("row_doc"))).drop("row_rev", "row_doc")


def rounds(lists: DataFrame, s: Search = Search()) -> DataFrame:
    """(query_id, round, limit, chunk_id, rrf, rank): the fusion of every top-up round, from lists ranked once.

    A round sees the ranks up to its limit; limits double up to the cap.
    """
    limits, limit = [], max(s.dense_top, s.sparse_top)
    for i in range(s.rounds):
        limits.append((i + 1, limit))
        limit = min(2 * limit, s.limit_cap)
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("round"), F.lit(n).alias("limit")) for i, n in limits)))
    spread = lists.withColumn("step", steps).select("*", "step.round", "step.limit").filter("rank <= limit")
    fused = spread.groupBy("query_id", "round", "limit", "chunk_id").agg(F.round(F.sum(1.0 / (s.rrf_k + F.col("rank"))), 9).alias("rrf"))
    return fused.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "round").orderBy(F.desc("rrf"), "chunk_id")))


def chosen_round(valid: DataFrame, all_rounds: DataFrame, s: Search = Search()) -> DataFrame:
    """(query_id, round): the first with enough valid hits, or that brought no new id, or that is the last or at the cap."""
    n_all = all_rounds.groupBy("query_id", "round", "limit").agg(F.count("*").alias("n"))
    n_valid = valid.groupBy("query_id", "round").agg(F.count("*").alias("ok"))
    # A round's ids hold those of the round before it, so no new id means an equal number.
    before = F.lag("n").over(W.partitionBy("query_id").orderBy("round"))
    seen = n_all.join(n_valid, ["query_id", "round"], "left").withColumn("before", before)
    stop = (F.coalesce("ok", F.lit(0)) >= s.min_passages) | (F.col("limit") >= s.limit_cap) | (F.col("round") >= s.rounds) | (F.col("n") == F.col("before"))
    return seen.filter(stop).groupBy("query_id").agg(F.min("round").alias("round"))


def select_passages(candidates: DataFrame, s: Search = Search(), diversify: bool = True) -> DataFrame:
    """(query_id, chunk_id, doc_id, tokens, place) chosen from candidates (query_id, chunk_id, doc_id, tokens, rank).

    A greedy scan in rank order, as a fold over at most rerank_max structs a query: a passage over the token budget is
    skipped, one of a book that has its share is put off; if too few are chosen, those put off follow in order.
    """
    kept = candidates.filter(F.col("rank") <= s.rerank_max)
    item = F.struct(F.col("rank").cast("int").alias("rank"), F.col("chunk_id").alias("chunk_id"), F.col("doc_id").alias("doc_id"), F.col("tokens").cast("int").alias("tokens"))
    listed = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    none = F.filter("items", lambda x: F.lit(False))
    start = F.struct(none.alias("chosen"), none.alias("later"), F.lit(0).alias("used"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["tokens"] <= s.token_budget
        crowded = F.size(F.filter(acc["chosen"], lambda c: c["doc_id"].eqNullSafe(x["doc_id"]))) >= s.max_per_book if diversify else F.lit(False)
        room = F.size(acc["chosen"]) < s.max_passages
        take, put_off = room & fits & ~crowded, room & fits & crowded
        return F.struct(
            F.when(take, F.concat(acc["chosen"], F.array(x))).otherwise(acc["chosen"]).alias("chosen"),
            F.when(put_off, F.concat(acc["later"], F.array(x))).otherwise(acc["later"]).alias("later"),
            F.when(take, acc["used"] + x["tokens"]).otherwise(acc["used"]).alias("used"),
        )

    scanned = listed.select("query_id", F.aggregate("items", start, step).alias("acc"))

    def fill(acc: Column, x: Column) -> Column:
        take = (F.size(acc["chosen"]) < s.min_passages) & (acc["used"] + x["tokens"] <= s.token_budget)
        return F.struct(
            F.when(take, F.concat(acc["chosen"], F.array(x))).otherwise(acc["chosen"]).alias("chosen"),
            F.when(take, acc["used"] + x["tokens"]).otherwise(acc["used"]).alias("used"),
        )

    filled = scanned.select("query_id", F.aggregate(F.col("acc.later"), F.struct(F.col("acc.chosen").alias("chosen"), F.col("acc.used").alias("used")), fill).alias("acc"))
    return filled.select("query_id", F.posexplode("acc.chosen").alias("place", "x")).select("query_id", "x.chunk_id", "x.doc_id", "x.tokens", (F.col("place") + 1).alias("place"))


#: Why a search has no dense side.
NO_EMBEDDER = "embedding model not configured; sparse-only search"


def search(questions: DataFrame, chunks: DataFrame, revisions: DataFrame, publications: DataFrame, vectors: DataFrame | None = None, only: Column | None = None, s: Search = Search(), stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(passages, counts) of questions (query_id, text[, query]) over the visible chunks.

    chunks (chunk_id, text, rev_id, doc_id, tokens[, epoch]), revisions (rev_id, doc_id, is_active), publications
    (rev_id, state), vectors (chunk_id, vector). Without vectors, or without the questions' own (query), the search is
    sparse only, and says so. only restricts what may be found, to one book or revision; the statistics stay those of
    all visible chunks, and a book may have every place. A chunk's payload (rev_id, doc_id, as in chunks) is held against
    stored, its rows as they are now (by default the same), so that hits of stale payloads are removed.

    passages (query_id, chunk_id, doc_id, tokens, place); counts (query_id, dense, sparse, fused, validated,
    postvalidation_removed, reranked, selected, topup_rounds, degraded, degraded_reason), of every question.
    """
    visible = chunks.join(publications.filter("state = 'active'").select("rev_id").distinct(), "rev_id", "left_semi")
    by = ["epoch"] if "epoch" in chunks.columns else []
    epoch = F.col("epoch").cast("string") if by else F.lit("")
    degraded = vectors is None or "query" not in questions.columns
    sparse = bm25_search(visible, questions.select("query_id", "text"), s.limit_cap, by, only=only)
    lists = sparse.select("query_id", F.lit("sparse").alias("side"), epoch.alias("epoch"), "chunk_id", "rank")
    if not degraded:
        found = visible if only is None else visible.filter(only)
        dense = dense_topk(vectors.join(found.select("chunk_id"), "chunk_id", "left_semi"), questions.select("query_id", "query"), s.limit_cap)
        lists = lists.unionByName(dense.select("query_id", F.lit("dense").alias("side"), F.lit("").alias("epoch"), "chunk_id", "rank"))
    # The lists have a bounded number of rows a query and are read by several branches: they are made once.
    durable(chunks.sparkSession)
    lists = lists.checkpoint()
    every = rounds(lists, s)
    rows = chunks.select("chunk_id", "rev_id", "doc_id", "tokens")
    valid = validate(every.join(rows, "chunk_id"), chunks if stored is None else stored, revisions, publications)
    last = chosen_round(valid, every, s)
    kept = valid.join(last, ["query_id", "round"])
    order = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    passages = select_passages(kept.withColumn("rank", order), s, diversify=only is None)
    fused = every.join(last, ["query_id", "round"]).groupBy("query_id", "round", "limit").agg(F.count("*").alias("fused"))
    sides = lists.join(fused.select("query_id", "limit"), "query_id").filter("rank <= limit").groupBy("query_id").agg(*(F.count_if(F.col("side") == x).alias(x) for x in ("dense", "sparse")))
    n = kept.groupBy("query_id").agg(F.count("*").alias("validated"))
    chosen = passages.groupBy("query_id").agg(F.count("*").alias("selected"))
    met = questions.select("query_id").join(fused, "query_id", "left").join(sides, "query_id", "left").join(n, "query_id", "left").join(chosen, "query_id", "left")
    number = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    counts = met.select(
        "query_id", *(number(c).alias(c) for c in ("dense", "sparse", "fused", "validated")), (number("fused") - number("validated")).alias("postvalidation_removed"),
        F.least(number("validated"), F.lit(s.rerank_max).cast("long")).alias("reranked"), number("selected").alias("selected"), F.coalesce(F.col("round") - 1, F.lit(0)).cast("int").alias("topup_rounds"),
        F.lit(degraded).alias("degraded"), F.lit(NO_EMBEDDER if degraded else None).cast("string").alias("degraded_reason"),
    )
    return passages, counts


def reranked(valid: DataFrame, score: Column, s: Search = Search()) -> DataFrame:
    """valid (query_id, chunk_id, rank, ...) with ranks by a reranker's score, of the rerank_max first ones only."""
    kept = valid.filter(F.col("rank") <= s.rerank_max)
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(score.desc(), "rank", "chunk_id")))
