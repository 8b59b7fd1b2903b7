"""Page texts: running headers and footers, span-mapped normalisation, chunking. Pages are (book, position, text).

Normalisation and the chunker are recurrences over places and tokens, so they run as Arrow functions; what a page's
made text stands for travels as a few runs, not by character. A book's pages go through the chunker in order, streamed
page by page, so a book needs no more memory than one chunk and page.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.ids import NAMESPACES
from pagemill.functions.text import strip
from pagemill.settings import Chunking, Normalization

_TOKEN = re.compile(r"\S+")


def edge_lines(text: Column) -> Column:
    """struct(first, last, first_end, last_start, end): the stripped first and last lines and where they lie.

    A line's end includes its newline, and a newline at the text's end opens no further line.
    """
    whole = F.when(text.endswith("\n"), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    lines = F.split(whole, "\n")
    last = F.element_at(lines, -1)
    return F.struct(
        strip(lines[0]).alias("first"), strip(last).alias("last"), F.least(F.length(lines[0]) + 1, F.length(text)).alias("first_end"), (F.length(whole) - F.length(last)).alias("last_start"), F.length(text).alias("end")
    )


def running_lines(pages: DataFrame, s: Normalization = Normalization()) -> DataFrame:
    """(book, kind, line, n): first and last lines that repeat on enough pages of a book."""
    e = pages.select("book", edge_lines(F.col("text")).alias("e"))
    each = e.select("book", F.inline(F.array(F.struct(F.lit("header").alias("kind"), F.col("e.first").alias("line")), F.struct(F.lit("footer").alias("kind"), F.col("e.last").alias("line")))))
    fit = F.length("line").between(s.header_min_chars, s.header_max_chars)
    return each.filter(fit).groupBy("book", "kind", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= s.header_min_pages)


def removed_ranges(pages: DataFrame, s: Normalization = Normalization()) -> DataFrame:
    """pages with removed, the merged source ranges of running headers and footers."""
    running = running_lines(pages, s)
    marked = pages.withColumn("e", edge_lines(F.col("text")))
    for kind, line in (("header", "e.first"), ("footer", "e.last")):
        own = running.filter(F.col("kind") == kind).select("book", F.col("line").alias("__line"), F.lit(True).alias(f"is_{kind}"))
        marked = marked.withColumn("__line", F.col(line)).join(own, ["book", "__line"], "left").drop("__line")
    head = F.when(F.col("is_header"), F.struct(F.lit(0).alias("s"), F.col("e.first_end").alias("e")))
    foot = F.when(F.col("is_footer"), F.struct(F.col("e.last_start").alias("s"), F.col("e.end").alias("e")))
    # Of a page with one line both ranges are the same.
    ranges = F.array_distinct(F.filter(F.array(head, foot), lambda r: r.isNotNull()))
    return marked.withColumn("removed", ranges).drop("e", "is_header", "is_footer")


#: Where text may change: white space but for a single space, and a hyphen at a line's end.
_CHANGES = re.compile(r"\s{2,}|[^\S ]|-[ \t]*\n(?=[^\n])")


class Runs:
    """What a made text stands for, as runs: (made start, length, source start, source end).

    A run as long as its source stands for it character by character; in any other, each character stands for the
    whole source range. Neighbouring runs of the first kind that continue one another are one.
    """

    def __init__(self):
        self.text: list[str] = []
        self.runs: list[list[int]] = []
        self.made = 0

    def add(self, text: str, a: int, b: int) -> None:
        n, last = len(text), self.runs[-1] if self.runs else None
        if not n:
            return
        if n == b - a and n > 1 and text.isspace():  # made white space, each for the whole range
            for c in text:
                self.runs.append([self.made, 1, a, b])
                self.text.append(c)
                self.made += 1
            return
        if last and n == b - a and last[1] == last[3] - last[2] and last[3] == a:
            last[1] += n
            last[3] = b
        else:
            self.runs.append([self.made, n, a, b])
        self.text.append(text)
        self.made += n


def normalize_runs(text: str, removed: list[tuple[int, int]], s: Normalization = Normalization()) -> tuple[str, list[list[int]]]:
    """The searchable text, and the runs of source ranges that it stands for."""
    out, gaps = Runs(), sorted(removed)
    at, n, gap = 0, len(text), 0
    while at < n:
        while gap < len(gaps) and gaps[gap][1] <= at:
            gap += 1
        limit = gaps[gap][0] if gap < len(gaps) else n
        if limit <= at:
            at = gaps[gap][1]
            continue
        change = _CHANGES.search(text, at) if s.collapse_whitespace else None
        if change is None or change.start() >= limit:
            out.add(text[at:limit], at, limit)
            at = limit
            continue
        start, end = change.span()
        out.add(text[at:start], at, start)
        if text[start] == "-":
            end = _joined_line(text, start) if s.dehyphenate else None
            if end is None:
                out.add("-", start, start + 1)
                end = start + 1
        else:
            before_gap = gap < len(gaps) and gaps[gap][0] <= end < gaps[gap][1]
            out.add(_space(text, start, end, before_gap), start, end)
        at = end
    return "".join(out.text), out.runs


def expanded(runs: list[list[int]]) -> list[tuple[int, int]]:
    """For each character of a made text the source range that it stands for."""
    out: list[tuple[int, int]] = []
    for _, n, a, b in runs:
        out += [(a + k, a + k + 1) for k in range(n)] if n == b - a else [(a, b)] * n
    return out


def normalize(text: str, removed: list[tuple[int, int]], s: Normalization = Normalization()) -> tuple[str, list[tuple[int, int]]]:
    """The searchable text, and for each of its characters the source range."""
    made, runs = normalize_runs(text, removed, s)
    return made, expanded(runs)


def _space(text: str, start: int, end: int, before_gap: bool) -> str:
    """What a run of white space becomes."""
    breaks = text.count("\n", start, end)
    if breaks != 1:
        return "\n" if breaks else " "
    if text[end - 1] != "\n":
        return "\n "
    at_edge = start == 0 or end == len(text) or text[start - 1] == "-"
    return "\n" if at_edge or before_gap else " "


def _joined_line(text: str, hyphen: int) -> int | None:
    """Where a word goes on that a hyphen at a line's end divides; None if it doesn't."""
    if hyphen == 0 or not text[hyphen - 1].isalpha():
        return None
    m = re.compile(r"-[ \t]*\n(?=[^\n])").match(text, hyphen)
    return m.end() if m and text[m.end()].islower() else None


RUNS = "array<struct<at: int, n: int, s: int, e: int>>"
_RUNS = pa.list_(pa.struct([(x, pa.int32()) for x in ("at", "n", "s", "e")]))


def normalized(pages: DataFrame, s: Normalization = Normalization()) -> DataFrame:
    """(book, position, searchable, runs) of pages with removed (see removed_ranges); few runs a page, however long it is."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.select("book", "position").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [normalize_runs(t or "", [(r["s"], r["e"]) for r in gaps or ()], s) for t, gaps in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            flat = np.array([r for _, runs in done for r in runs], np.int32).reshape(-1, 4)
            ends = np.cumsum([0, *(len(runs) for _, runs in done)], dtype=np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(4)], fields=list(_RUNS.value_type)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t for t, _ in done], pa.string()), listed], ["book", "position", "searchable", "runs"])

    return pages.select("book", "position", "text", "removed").mapInArrow(run, f"{kinds}, searchable string, runs {RUNS}")


def word_places(searchable: str, boxes: list[tuple[str, list[float]]]) -> list[tuple[int, int, list[float]]]:
    """(start, end, box) of a page's OCR words, each looked for behind the start of the one before; unfound ones drop out."""
    out, at = [], 0
    for word, box in boxes:
        place = searchable.find(word, at)
        if place >= 0:
            out.append((place, place + len(word), box))
            at = place + 1
    return out


def union_box(places: list[tuple[int, int, list[float]]], start: int, end: int) -> list[float] | None:
    """The [left, top, right, bottom] around the boxes (left, top, width, height) of words that reach into a range."""
    own = [box for a, b, box in places if a < end and b > start]
    if not own:
        return None
    return [round(x, 3) for x in (min(b[0] for b in own), min(b[1] for b in own), max(b[0] + b[2] for b in own), max(b[1] + b[3] for b in own))]


class Chunker:
    """Cuts a book's token stream, fed page by page, into overlapping chunks."""

    def __init__(self, run_id: str, s: Chunking = Chunking()):
        self.run_id, self.s = run_id, s
        self.settings_sha = s.sha()
        #: Tokens not yet behind a chunk's start, in columns: text, number of the unit, source start and end, and whether
        #: a cut behind it is preferred (a byte each).
        self.texts: list[str] = []
        self.unit_of: list[int] = []
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.preferred = bytearray()
        self.first: dict[int, str | None] = {}  # titles by the number of the unit, while its first token is still there
        self.units: dict[int, tuple[str, list]] = {}
        self.fed = self.position = 0

    def feed(self, unit: str, searchable: str, runs: list, title: str | None, boxes: list[tuple[str, list[float]]] = ()) -> Iterator[dict]:
        """runs as normalize_runs gives them; without any, the text stands for itself."""
        spans = [m.span() for m in _TOKEN.finditer(searchable)]
        if spans:
            a, b = np.array(spans).T
            if len(runs):
                table = np.array(runs, np.int64).reshape(-1, 4)
                source = []
                for place, end in ((a, 0), (b - 1, 1)):
                    at, n, low, high = table[np.searchsorted(table[:, 0], place, side="right") - 1].T
                    plain = n == high - low
                    source.append(np.where(plain, low + place - at + end, high if end else low))
            else:
                source = [a, b]
            number = self.fed
            self.texts += [searchable[x:y] for x, y in spans]
            self.unit_of += [number] * len(spans)
            self.starts += source[0].tolist()
            self.ends += source[1].tolist()
            self.preferred += bytes(searchable[y : y + 1] == "\n" for _, y in spans[:-1]) + b"\1"
            self.first[len(self.texts) - len(spans)] = title or None
            self.units[number] = (unit, word_places(searchable, list(boxes)) if len(boxes) else [])
            self.fed += 1
        # A chunk may be cut once one more token than it can hold is there.
        while len(self.texts) > min(self.s.target, self.s.maximum):
            yield self.cut(final=False)

    def close(self) -> Iterator[dict]:
        while self.texts:
            yield self.cut(final=True)

    def cut(self, final: bool) -> dict:
        s, n = self.s, len(self.texts)
        title = self.first.get(0) if s.title_prefix else None
        extra = len(title.split()) if title else 0
        end = min(n, max(1, min(s.target, s.maximum) - extra))
        whole = final and end >= n
        if not whole:
            place = self.preferred.rfind(1, max(0, end - max(20, s.target // 4)), end)
            end = place + 1 if place >= 0 else end
        made = self.chunk(end, title, extra)
        following = end - s.overlap
        gone = n if whole else following if following > 0 else 1
        for column in (self.texts, self.unit_of, self.starts, self.ends, self.preferred):
            del column[:gone]
        self.first = {k - gone: t for k, t in self.first.items() if k >= gone}
        for k in [k for k in self.units if not self.unit_of or k < self.unit_of[0]]:
            del self.units[k]
        return made

    def chunk(self, end: int, title: str | None, extra: int) -> dict:
        text = " ".join(self.texts[:end])
        spans, at = [], 0
        while at < end:
            number = self.unit_of[at]
            stop = end if self.unit_of[end - 1] == number else bisect.bisect_right(self.unit_of, number, at, end)
            unit, places = self.units[number]
            low, high = self.starts[at], max(self.ends[at:stop])
            spans.append({"unit_id": unit, "source_start": low, "source_end": high, "bbox": union_box(places, low, high) if places else None})
            at = stop
        signature = hashlib.sha256(json.dumps([[x["unit_id"], x["source_start"], x["source_end"]] for x in spans], separators=(",", ":")).encode()).hexdigest()
        name = f"chunk:{self.run_id}:{self.settings_sha}:{signature}:{hashlib.sha256(text.encode()).hexdigest()}"
        self.position += 1
        return {
            "book": self.run_id, "position": self.position - 1, "chunk_id": str(uuid.uuid5(uuid.UUID(NAMESPACES["chunk"]), name)), "text": text, "title": title,
            "token_count": extra + end, "spans": spans,
        }


CHUNK_SCHEMA = "book string, position int, chunk_id string, text string, title string, token_count int, spans array<struct<unit_id: string, source_start: int, source_end: int, bbox: array<double>>>"


def chunked(units: DataFrame, s: Chunking = Chunking(), partitions: int | None = None) -> DataFrame:
    """Chunks of units (book, position, searchable, runs, title[, boxes]): books are dealt to partitions, sorted, streamed.

    boxes, where units have it, is an array of (text, box) of OCR words; spans then carry the box around their words.
    """
    boxes = F.col("boxes") if "boxes" in units.columns else F.lit(None)
    dealt = units.select(F.col("book").cast("string").alias("book"), "position", "searchable", "runs", "title", boxes.cast("array<struct<text: string, box: array<double>>>").alias("boxes"))
    dealt = (dealt.repartition(partitions, "book") if partitions else dealt.repartition("book")).sortWithinPartitions("book", "position")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Chunker | None = None
        kind = pa.schema([("book", pa.string()), ("position", pa.int32()), ("chunk_id", pa.string()), ("text", pa.string()), ("title", pa.string()), ("token_count", pa.int32()), ("spans", pa.list_(pa.struct([("unit_id", pa.string()), ("source_start", pa.int32()), ("source_end", pa.int32()), ("bbox", pa.list_(pa.float64()))])))])
        for batch in batches:
            rows: list[dict] = []
            columns = [c.to_pylist() for i, c in enumerate(batch.columns) if i != 3]
            runs = batch.column(3)
            flat = np.stack([np.asarray(runs.values.field(i)) for i in range(4)], 1) if len(runs.values) else np.zeros((0, 4), np.int64)
            edges = np.asarray(runs.offsets)
            for i, (book, position, searchable, title, words) in enumerate(zip(*columns, strict=True)):
                if own is None or own.run_id != book:
                    if own:
                        rows += own.close()
                    own = Chunker(book, s)
                rows += own.feed(f"{book}:{position}", searchable or "", flat[edges[i] : edges[i + 1]], title, [(w["text"], w["box"]) for w in words or ()])
            if rows:
                yield pa.RecordBatch.from_pylist(rows, kind)
        if own and (rows := list(own.close())):
            yield pa.RecordBatch.from_pylist(rows, kind)

    return dealt.mapInArrow(run, CHUNK_SCHEMA)


def linked(chunks: DataFrame) -> DataFrame:
    """chunks with the ids of their neighbours in the book."""
    order = W.partitionBy("book").orderBy("position")
    return chunks.withColumn("prev_chunk_id", F.lag("chunk_id").over(order)).withColumn("next_chunk_id", F.lead("chunk_id").over(order))


def strides(tokens: DataFrame, size: int, overlap: int) -> DataFrame:
    """(doc_id, position, first, n) of fixed-stride chunks of (doc_id, n_tokens): the chunker without preferred cuts."""
    step = size - overlap
    count = F.when(F.col("n_tokens") <= size, F.lit(1)).otherwise(F.ceil((F.col("n_tokens") - size) / step) + 1)
    each = tokens.filter("n_tokens > 0").select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))).alias("position"))
    return each.select("doc_id", "position", (F.col("position") * step).alias("first"), F.least(F.lit(size), F.col("n_tokens") - F.col("position") * step).alias("n"))
