"""Stored artifacts: units as compressed JSON envelopes, and batches of vectors with a manifest, checked before use."""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The envelope's version; a vector file's first bytes, version, kind of number and header.
SCHEMA = 1
MAGIC, VERSION, FLOAT32 = b"LBEM", 1, 0
HEADER = "<4sIIBQ"
HEADER_BYTES = struct.calcsize(HEADER)


def unit_path(rev_id: Column, unit_id: Column) -> Column:
    return F.concat(F.lit("extract/"), rev_id, F.lit("/"), unit_id, F.lit(".json.gz"))


def vector_path(run_id: Column, embedding_sha: Column, batch: Column) -> Column:
    return F.concat(F.lit("embeddings/"), run_id, F.lit("/"), embedding_sha, F.lit("/batch_"), F.lpad(batch.cast("string"), 5, "0"), F.lit(".bin"))


def packed_units(units: DataFrame) -> DataFrame:
    """(unit_id, content, sha256) of units (unit_id, payload): the payload's JSON in an envelope; equal payloads, equal bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for payload in batch.column(1).to_pylist():
                envelope = {"schema": SCHEMA, **json.loads(payload)}
                data.append(gzip.compress(json.dumps(envelope, sort_keys=True, separators=(",", ":")).encode(), mtime=0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary()), pa.array([hashlib.sha256(d).hexdigest() for d in data])], ["unit_id", "content", "sha256"])

    kind = units.schema["unit_id"].dataType.simpleString()
    return units.select("unit_id", "payload").mapInArrow(run, f"unit_id {kind}, content binary, sha256 string")


def read_units(files: DataFrame) -> DataFrame:
    """(unit_id, payload, problem) of files (unit_id, content, expected): problem is missing, checksum, unreadable or schema.

    A null expected hash isn't checked.
    """

    def one(content: bytes | None, expected: str | None) -> tuple[str | None, str | None]:
        if content is None:
            return None, "missing"
        if expected is not None and hashlib.sha256(content).hexdigest() != expected:
            return None, "checksum"
        try:
            envelope = json.loads(gzip.decompress(content))
        except (OSError, EOFError, ValueError):
            return None, "unreadable"
        if not isinstance(envelope, dict) or envelope.get("schema") != SCHEMA:
            return None, "schema"
        return json.dumps({k: v for k, v in envelope.items() if k != "schema"}, sort_keys=True), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(c, e) for c, e in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["unit_id", "payload", "problem"])

    kind = files.schema["unit_id"].dataType.simpleString()
    return files.select("unit_id", "content", "expected").mapInArrow(run, f"unit_id {kind}, payload string, problem string")


def effective_text(kind: Column, ocr_state: Column, ocr_text: Column, text: Column, paragraphs: Column) -> Column:
    """A unit's searchable source: a page's OCR text once that is done, else its own; a section's paragraphs joined."""
    page = F.when((ocr_state == "done") & ocr_text.isNotNull(), ocr_text).otherwise(F.coalesce(text, F.lit("")))
    return F.when(kind == "page", page).otherwise(F.coalesce(F.array_join(F.transform(paragraphs, lambda p: F.coalesce(p["text"], F.lit(""))), "\n\n"), F.lit("")))


def packed_vectors(batches: DataFrame, dims: int) -> DataFrame:
    """(batch_id, content, manifest) of batches (batch_id, chunk_ids, vectors) of dims numbers each."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            data, manifests = [], []
            for ids, vectors in zip(frame.column(1).to_pylist(), frame.column(2).to_pylist(), strict=True):
                raw = struct.pack(HEADER, MAGIC, VERSION, dims, FLOAT32, len(vectors)) + b"".join(struct.pack(f"<{dims}f", *v) for v in vectors)
                data.append(raw)
                manifests.append(json.dumps({"chunk_ids": ids, "count": len(vectors), "dims": dims, "vector_sha256": hashlib.sha256(raw).hexdigest()}, sort_keys=True))
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(data, pa.binary()), pa.array(manifests)], ["batch_id", "content", "manifest"])

    kind = batches.schema["batch_id"].dataType.simpleString()
    return batches.select("batch_id", "chunk_ids", "vectors").mapInArrow(run, f"batch_id {kind}, content binary, manifest string")


def vector_problem(content: bytes | None, manifest: str | None, expected: list[str]) -> str | None:
    """missing, too_short, magic, version, dtype, size, manifest, hash, chunk_ids or shape; None for a sound file."""
    if content is None or manifest is None:
        return "missing"
    if len(content) < HEADER_BYTES:
        return "too_short"
    magic, version, dims, dtype, count = struct.unpack_from(HEADER, content)
    for wrong, name in ((magic != MAGIC, "magic"), (version != VERSION, "version"), (dtype != FLOAT32, "dtype"), (len(content) != HEADER_BYTES + 4 * count * dims, "size")):
        if wrong:
            return name
    try:
        said = json.loads(manifest)
        shape = (int(said.get("dims", -1)), int(said.get("count", -1)))
    except (ValueError, TypeError, AttributeError):
        return "manifest"
    if said.get("vector_sha256") != hashlib.sha256(content).hexdigest():
        return "hash"
    if said.get("chunk_ids") != expected:
        return "chunk_ids"
    return None if shape == (dims, count) else "shape"


def read_vectors(files: DataFrame) -> DataFrame:
    """(batch_id, vectors, problem) of files (batch_id, content, manifest, expected array<string>); vectors of sound ones."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            vectors, problems = [], []
            for content, manifest, expected in zip(*(frame.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                problem = vector_problem(content, manifest, list(expected or ()))
                problems.append(problem)
                if problem:
                    vectors.append(None)
                else:
                    _, _, dims, _, count = struct.unpack_from(HEADER, content)
                    vectors.append([list(struct.unpack_from(f"<{dims}f", content, HEADER_BYTES + 4 * dims * i)) for i in range(count)])
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(vectors, pa.list_(pa.list_(pa.float32()))), pa.array(problems, pa.string())], ["batch_id", "vectors", "problem"])

    kind = files.schema["batch_id"].dataType.simpleString()
    return files.select("batch_id", "content", "manifest", "expected").mapInArrow(run, f"batch_id {kind}, vectors array<array<float>>, problem string")
