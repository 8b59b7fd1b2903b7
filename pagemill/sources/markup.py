"""Markup sources: strict XHTML sections, EPUB containers, OCR tables."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements that go, attributes that hold addresses, elements whose text is a paragraph.
REMOVED = frozenset("script style link meta iframe object embed form base template".split())
ADDRESSES = frozenset("href src action poster data".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dt dd figcaption".split())
TITLES = ("h1", "h2")
_EXTERNAL = re.compile(r"[a-zA-Z][a-zA-Z0-9+.\-]*:|\s*//")
MAX_ENTRIES, MAX_BYTES, MAX_RATIO = 10_000, 2 << 30, 100.0


def _name(element: ElementTree.Element) -> str | None:
    return element.tag.rpartition("}")[2].lower() if isinstance(element.tag, str) else None


def clean(data: bytes | str) -> ElementTree.Element:
    """The body without active content; a removed element's tail text goes with it. Raises ParseError."""
    root = ElementTree.fromstring(data)
    pending = [root]
    while pending:
        parent = pending.pop()
        for child in list(parent):
            if (_name(child) or "script") in REMOVED:
                parent.remove(child)
            else:
                pending.append(child)
        for key in [k for k, v in parent.attrib.items() if (short := k.rpartition("}")[2].lower()).startswith("on") or (short in ADDRESSES and _EXTERNAL.match(v))]:
            del parent.attrib[key]
    return next((e for e in root if _name(e) == "body"), root)


def blocks(body: ElementTree.Element) -> tuple[list[str], str | None]:
    """Paragraphs in document order (nested ones repeat), and the first title."""
    texts = [(_name(e), "".join(e.itertext()).strip()) for e in body.iter() if _name(e) in BLOCKS]
    return [t for _, t in texts if t], next((t for name, t in texts if t and name in TITLES), None)


def sections(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, title, flags, paragraphs array<struct<anchor, text>>, char_count); bad_html where it isn't well-formed."""
    kind = pages.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for data in f[html]:
                try:
                    found, title = blocks(clean(data or ""))
                    rows.append((title, [], found))
                except ElementTree.ParseError:
                    rows.append((None, ["bad_html"], []))
            yield pd.DataFrame({key: f[key], "title": [r[0] for r in rows], "flags": [r[1] for r in rows], "texts": [r[2] for r in rows]})

    read = pages.select(key, html).mapInPandas(run, f"{key} {kind}, title string, flags array<string>, texts array<string>")
    named = F.transform("texts", lambda t, i: F.struct(F.format_string("a%04d", i).alias("anchor"), t.alias("text")))
    size = F.aggregate("texts", F.lit(0), lambda acc, t: acc + F.length(t))
    return read.select(key, "title", "flags", named.alias("paragraphs"), size.alias("char_count"))


def lenient_text(html: Column) -> Column:
    """Text of any HTML, tags and active content cut out; an extension for pages that aren't well-formed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|template)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def unsafe_entries(entries: DataFrame) -> DataFrame:
    """(archive, problem) of archives with entries (archive, name, size, packed) that must not be read."""
    per = entries.groupBy("archive").agg(
        F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("packed").alias("packed"), F.bool_or(F.col("name").startswith("/") | F.col("name").contains("\\")).alias("absolute"),
        F.bool_or(F.array_contains(F.split("name", "/"), "..")).alias("climbs"),
    )
    problem = (
        F.when(F.col("n") > MAX_ENTRIES, "too_many_entries").when(F.col("size") > MAX_BYTES, "too_large").when(F.col("size") > MAX_RATIO * F.greatest("packed", F.lit(1)), "ratio")
        .when(F.col("absolute"), "absolute_path").when(F.col("climbs"), "path_traversal")
    )
    return per.withColumn("problem", problem).filter("problem is not null").select("archive", "problem")


def _spine(book: zipfile.ZipFile) -> list[str]:
    """Names of a book's sections in reading order."""
    box = ElementTree.fromstring(book.read("META-INF/container.xml"))
    package = next(e.attrib["full-path"] for e in box.iter() if _name(e) == "rootfile")
    folder = package.rpartition("/")[0]
    root = ElementTree.fromstring(book.read(package))
    items = {e.attrib["id"]: e.attrib["href"] for e in root.iter() if _name(e) == "item"}
    order = [items[e.attrib["idref"]] for e in root.iter() if _name(e) == "itemref" and e.attrib.get("idref") in items]
    return [f"{folder}/{h}" if folder else h for h in order]


def epub_sections(files: DataFrame) -> DataFrame:
    """(path, position, ref, html, error) of EPUB files in a binaryFile DataFrame (path, content); unsafe ones aren't read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows: list[tuple] = []
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as book:
                        own = book.infolist()
                        size, packed = sum(i.file_size for i in own), sum(i.compress_size for i in own)
                        if len(own) > MAX_ENTRIES or size > MAX_BYTES or size > MAX_RATIO * max(1, packed) or any(i.filename.startswith("/") or ".." in i.filename.split("/") for i in own):
                            raise zipfile.BadZipFile("unsafe archive")
                        rows += [(path, i, name, book.read(name).decode("utf-8", "replace"), None) for i, name in enumerate(_spine(book))]
                except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError) as problem:
                    rows.append((path, 0, None, None, str(problem) or type(problem).__name__))
            yield pd.DataFrame(rows, columns=["path", "position", "ref", "html", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, position int, ref string, html string, error string")


def ocr_words(pages: DataFrame, scale: float = 1.0) -> DataFrame:
    """(page, block, par, line, word, text, box) of OCR tables (page, tsv): words only, boxes in page units."""
    line = F.explode(F.split("tsv", "\n")).alias("row")
    c = F.split("row", "\t")
    rows = pages.select("page", line).select("page", c.alias("c")).filter((F.size("c") >= 12) & (F.col("c")[0] == "5") & (F.trim(F.col("c")[11]) != ""))
    box = F.transform(F.slice("c", 7, 4), lambda x: F.round(x.cast("double") / scale, 3))
    return rows.select("page", *(F.col("c")[i].cast("int").alias(n) for i, n in ((2, "block"), (3, "par"), (4, "line"), (5, "word"))), F.trim(F.col("c")[11]).alias("text"), box.alias("box"))


def ocr_text(words: DataFrame) -> DataFrame:
    """(page, text): words joined to lines, lines to pages."""
    lines = words.groupBy("page", "block", "par", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda w: w["text"]), " ").alias("text"))
    return lines.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "par", "line", "text"))), lambda x: x["text"]), "\n").alias("text"))
