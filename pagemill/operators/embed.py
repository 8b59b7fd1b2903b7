"""Embedding: a deterministic stand-in encoder, batched encoding with halving, vector checks, statistics identity."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import ids
from pagemill.functions.text import bound, tokens


def fake_vector(text: Column, role: str = "doc", dims: int = 64) -> Column:
    """A unit vector from a chain of SHA-256 digests, 16 little-endian 16-bit numbers each; equal texts, equal vectors."""
    seed = F.sha2(F.concat(F.encode(F.lit(f"{role}\0"), "UTF-8"), F.encode(text, "UTF-8")), 256)
    digest = lambda last: F.sha2(F.unhex(last), 256)
    chain = F.aggregate(
        F.sequence(F.lit(1), F.lit(-(-dims // 16))), F.struct(seed.alias("last"), F.lit("").alias("all")),
        lambda acc, _: bound(digest(acc["last"]), lambda d: F.struct(d.alias("last"), F.concat(acc["all"], d).alias("all"))),
    )["all"]

    def number(c: Column, i: Column) -> Column:
        return F.conv(F.concat(F.substr(c, i * 4 + 3, F.lit(2)), F.substr(c, i * 4 + 1, F.lit(2))), 16, 10).cast("double") / 65536.0

    # The digests, the numbers and their norm are bound, so that each is computed once a text.
    values = bound(chain, lambda c: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: number(c, i)))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return bound(values, lambda v: bound(norm(v), lambda n: F.transform(v, lambda x: x / n)))


def encode_halving(texts: list[str], encode: Callable[[list[str]], list], halvings: int = 4) -> list:
    """Vectors of texts; a batch that exhausts memory is cut in halves, so many times at most."""
    try:
        return encode(texts)
    except MemoryError:
        if halvings == 0 or len(texts) < 2:
            raise
        half = len(texts) // 2
        return encode_halving(texts[:half], encode, halvings - 1) + encode_halving(texts[half:], encode, halvings - 1)


def embedded(chunks: DataFrame, encoder: Callable[[], Callable[[list[str]], list]], batch: int = 8) -> DataFrame:
    """(chunk_id, vector) of chunks (chunk_id, text); encoder() makes the model once per task."""
    kind = chunks.schema["chunk_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder()
        for f in frames:
            own = f["text"].fillna("").tolist()
            vectors = [v for at in range(0, len(own), batch) for v in encode_halving(own[at : at + batch], encode)]
            yield pd.DataFrame({"chunk_id": f["chunk_id"], "vector": vectors})

    return chunks.select("chunk_id", "text").mapInPandas(run, f"chunk_id {kind}, vector array<float>")


def vector_problem(vector: Column, dims: int) -> Column:
    """missing, dimensions, not_finite, zero or not_normalized; null for a sound vector."""
    norm = F.aggregate(vector, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    odd = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return (
        F.when(vector.isNull(), "missing").when(F.size(vector) != dims, "dimensions").when(odd, "not_finite").when(norm == 0, "zero").when(F.abs(norm - 1) > 1e-3, "not_normalized")
    )


def stats_sha(frequencies: DataFrame, n: int, avgdl: float, k1: float = 1.5, b: float = 0.75) -> str:
    """The statistics' identity: SHA-256 of their canonical JSON, fed term by term in order, so no list is held."""
    seen = hashlib.sha256(f'{{"N":{json.dumps(n)},"avgdl":{json.dumps(avgdl)},"b":{json.dumps(b)},"df":{{'.encode())
    for i, r in enumerate(frequencies.orderBy(F.encode("term", "UTF-8")).toLocalIterator()):
        seen.update(f"{',' if i else ''}{json.dumps(r['term'])}:{r['df']}".encode())
    seen.update(f'}},"k1":{json.dumps(k1)}}}'.encode())
    return seen.hexdigest()


def token_count(text: Column) -> Column:
    """The default counter of words; a model's own counter takes its place as a Column of the same kind."""
    return F.size(tokens(text))


def build_points(chunks: DataFrame, vectors: DataFrame, sparse: DataFrame, model_revision: str, embedding_sha: str, stats_sha: str) -> DataFrame:
    """(point_id, payload, dense, sparse) of chunks (chunk_id, run_id, rev_id, doc_id) under one generation.

    vectors (chunk_id, vector), sparse (chunk_id, term, w); a chunk without a vector makes no point, one without known
    terms an empty sparse part. Terms are numbered by their own hash and listed in the order of the terms.
    """
    gen = ids.generation_id(F.col("run_id"), embedding_sha, stats_sha)
    own = chunks.select("chunk_id", "run_id", "rev_id", "doc_id", gen.alias("gen_id")).join(vectors.select("chunk_id", "vector"), "chunk_id")
    listed = sparse.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("t"))
    met = own.join(listed, "chunk_id", "left").withColumn("t", F.coalesce("t", F.array().cast("array<struct<term: string, w: double>>")))
    payload = F.struct(
        "chunk_id", "rev_id", "doc_id", "run_id", "gen_id", ids.publication_id(F.col("rev_id"), F.col("gen_id")).alias("pub_id"),
        F.lit(model_revision).alias("model_revision"), F.lit(embedding_sha).alias("embedding_sha"), F.lit(stats_sha).alias("stats_sha"),
    )
    weights = F.struct(F.transform("t", lambda x: ids.term_id(x["term"])).alias("indices"), F.transform("t", lambda x: x["w"]).alias("values"))
    return met.select(ids.point_id(F.col("chunk_id"), F.col("gen_id")).alias("point_id"), payload.alias("payload"), F.col("vector").alias("dense"), weights.alias("sparse"))
