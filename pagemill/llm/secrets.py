"""Secret scan: an Aho-Corasick keyword prefilter, anchored expressions at the hits, checksums inside the tokens.

A keyword automaton runs over the A-Z lower-cased bytes of a text; only where a keyword starts is that kind's
expression matched, anchored, and kinds whose tokens hold a checksum are checked against it. Long hexadecimal
strings have no keyword: every run of 32 holds a whole aligned block of 16, so blocks are tested at once and runs are
grown only around full ones.

Kinds: ``assign`` (a named value of 8 or more characters), ``access`` (AKIA..., 16 or more), ``hex`` (32 or more),
and with checksums ``github`` and ``npm``: a prefix, 30 base-62 characters and the CRC-32 of these in 6 base-62 digits.

Defined results: null and empty texts have no spans; positions are code points, end exclusive; matches of one kind
don't overlap, leftmost first, those of different kinds may; equal spans of several kinds are listed in the order of
KINDS; an empty table gives no rows. redact() keeps all columns and rows, replaces spans in the text, and leaves null
texts null.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import sha256, slim, texts

KINDS = ("assign", "access", "hex", "github", "npm")
BASE = 3  # the first three are reported as base spans
#: Keywords and expressions of the kinds.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
GITHUB = re.compile(rb"gh[pousr]_([0-9A-Za-z]{36})(?![0-9A-Za-z])")
NPM = re.compile(rb"npm_([0-9A-Za-z]{36})(?![0-9A-Za-z])")
KEYWORDS = {"password": 0, "passwd": 0, "secret": 0, "token": 0, "apikey": 0, "api_key": 0, "akia": 1, "ghp_": 3, "gho_": 3, "ghu_": 3, "ghs_": 3, "ghr_": 3, "npm_": 4}
DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_HEX = np.zeros(256, bool)
_HEX[[*b"0123456789abcdef"]] = True
_AUTOMATON = ahocorasick.Automaton()
for _word, _kind in KEYWORDS.items():
    _AUTOMATON.add_word(_word, (len(_word), _kind))
_AUTOMATON.make_automaton()


def checksum(body: bytes) -> bytes:
    """CRC-32 in six base-62 digits."""
    n, out = zlib.crc32(body), b""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = DIGITS[d : d + 1] + out
    return out


def hex_runs(data: bytes, least: int = 32) -> list[tuple[int, int]]:
    """Maximal runs of at least that many lower-case hexadecimal digits."""
    n = len(data) // 16
    if not n:
        return []
    full = np.flatnonzero(_HEX[np.frombuffer(data, np.uint8, n * 16)].reshape(n, 16).all(1))
    out, end = [], -1
    for block in full.tolist():
        at = block * 16
        if at < end:
            continue
        start, end = at, at + 16
        while start and data[start - 1] in b"0123456789abcdef":
            start -= 1
        end = _RUN.match(data, end).end()
        if end - start >= least:
            out.append((start, end))
    return out


_RUN = re.compile(rb"[0-9a-f]*")


def find(data: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes, sorted."""
    found = [(a, 2, b) for a, b in hex_runs(data)]
    starts = sorted((end - size + 1, kind) for end, (size, kind) in _AUTOMATON.iter(data.lower().decode("latin-1")))
    free = [0] * len(KINDS)
    for at, kind in starts:
        if at < free[kind]:
            continue
        m = (ASSIGN, ACCESS, None, GITHUB, NPM)[kind].match(data, at)
        if not m:
            continue
        free[kind] = m.end()
        if kind == 0:
            good = len(m[2]) >= 8
        elif kind == 1:
            good = len(m[0]) >= 16
        else:
            good = checksum(m[1][:30]) == m[1][30:]
        if good:
            found.append((at, kind, m.end()))
    return sorted(found)


def spans(data: bytes) -> list[tuple[int, int, int]]:
    """The same in code points."""
    found = find(data)
    if not found or data.isascii():
        return found
    lead = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
    return [(int(lead[a]), k, int(lead[b])) for a, k, b in found]


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, listed = np.zeros((batch.num_rows, BASE), np.int64), [], []
            for row, data in enumerate(texts(batch, 1)):
                found = spans(data)
                names = [f"{KINDS[k]}:{a}:{b}" for a, k, b in found]
                for _, k, _ in found:
                    if k < BASE:
                        counts[row, k] += 1
                digests.append(sha256(",".join(n for n, (_, k, _) in zip(names, found, strict=True) if k < BASE).encode()))
                listed.append(",".join(names))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[:, k]) for k in range(BASE)), pa.array(digests, pa.string()), pa.array(listed, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return slim(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by [KIND]; overlapping spans become one, named after the first."""
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, null in zip(texts(batch, at), batch.column(at).is_null().to_pylist(), strict=True):
                done, parts, end, last = 0, [], -1, None
                for a, k, b in find(data):
                    if a < end:  # overlaps the span before
                        end = max(end, b)
                        continue
                    if last is not None:
                        parts += [data[done : last[0]], b"[%s]" % KINDS[last[1]].upper().encode()]
                        done = end
                    last, end = (a, k), b
                if last is not None:
                    parts += [data[done : last[0]], b"[%s]" % KINDS[last[1]].upper().encode()]
                    done = end
                parts.append(data[done:])
                out.append(None if null else b"".join(parts))
            columns = [*batch.columns]
            columns[at] = pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    done = docs.mapInArrow(run, schema)
    return done.withColumn("n_chars", F.length(text_col).cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else done
