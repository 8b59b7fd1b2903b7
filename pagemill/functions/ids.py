"""Deterministic identities as Column expressions, so that codegen and constant folding stay active."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The registry's namespaces.
NAMESPACES = {
    "doc": "8f3e2a10-0000-4000-8000-0000000000d1",
    "rev": "8f3e2a10-0000-4000-8000-0000000000d2",
    "task": "8f3e2a10-0000-4000-8000-0000000000d3",
    "extract": "8f3e2a10-0000-4000-8000-0000000000d4",
    "unit": "8f3e2a10-0000-4000-8000-0000000000d5",
    "chunk": "8f3e2a10-0000-4000-8000-0000000000d6",
    "gen": "8f3e2a10-0000-4000-8000-0000000000d7",
    "point": "8f3e2a10-0000-4000-8000-0000000000d8",
}


def uuid5(namespace: str, name: Column) -> Column:
    """The version 5 UUID of a name."""
    space = F.unhex(F.lit(namespace.replace("-", "")))
    h = F.sha1(F.concat(space, F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12)
    )


def _joined(kind: str, *parts: Column | str) -> Column:
    return uuid5(NAMESPACES[kind], F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)))


def document_id(anchor_sha: Column) -> Column:
    return uuid5(NAMESPACES["doc"], anchor_sha)


def revision_id(doc_id: Column, sha: Column) -> Column:
    return _joined("rev", doc_id, sha)


def extraction_id(sha: Column, parser: Column | str, settings: Column | str, page_cap: int | None = None) -> Column:
    return _joined("extract", "extract", sha, parser, settings, *([f"cap{page_cap}"] if page_cap is not None else []))


def unit_id(run_id: Column, kind: Column | str, position: Column) -> Column:
    return _joined("unit", "unit", run_id, kind, position)


def chunk_id(run_id: Column, chunker_sha: Column | str, span_signature: Column, text_sha: Column) -> Column:
    return _joined("chunk", "chunk", run_id, chunker_sha, span_signature, text_sha)


def task_key(stage: Column | str, input_id: Column, version: Column | str, span: Column | str = "") -> Column:
    return _joined("task", stage, input_id, version, span)


def embedding_id(run_id: Column, model: Column | str, settings: Column | str, chunk: Column) -> Column:
    return _joined("extract", "embed", run_id, model, settings, chunk)


def generation_id(run_id: Column, embedding_sha: Column | str, stats_sha: Column | str) -> Column:
    return _joined("gen", "gen", run_id, embedding_sha, stats_sha)


def point_id(chunk: Column, generation: Column) -> Column:
    return _joined("point", "point", chunk, generation)


def publication_id(rev_id: Column, generation: Column) -> Column:
    return _joined("gen", "pub", rev_id, generation)


def term_id(term: Column) -> Column:
    """The first four bytes of the SHA-256 as a little-endian unsigned number."""
    h = F.sha2(term, 256)
    return F.conv(F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2)), 16, 10).cast("long")


def units_fingerprint(position: Column, sha: Column) -> Column:
    """An aggregate: the SHA-256 of the sorted (position, content hash) pairs as compact JSON."""
    pairs = F.array_sort(F.collect_list(F.struct(position.alias("at"), sha.alias("sha"))))
    listed = F.transform(pairs, lambda p: F.concat(F.lit("["), p["at"].cast("string"), F.lit(',"'), p["sha"], F.lit('"]')))
    return F.sha2(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")), 256)


def chunk_fingerprint(units: Column, normalization_sha: Column | str, chunking_sha: Column | str) -> Column:
    """What decides a run's chunks: its units' fingerprint and the settings of normalisation and chunking."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.sha2(F.concat_ws(":", units, lit(normalization_sha), lit(chunking_sha)), 256)
