"""Scanning files into the catalog: formats, outcomes, reports by root, the archive, and listings of folders."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.operators.catalog import resolve

#: How files begin, and what an EPUB's entry says.
PDF_HEAD, ZIP_HEAD, EPUB_TYPE = b"%PDF-", b"PK\x03\x04", b"application/epub+zip"
OUTCOMES = ("new_document", "new_revision", "alias", "unchanged", "missing", "changed_during_scan", "invalid", "deferred", "error")


def candidates(files: DataFrame, suffixes: tuple[str, ...], ignored_folders: tuple[str, ...] = (), ignored_names: tuple[str, ...] = ()) -> DataFrame:
    """files (path, ...) with one of the suffixes in any case, outside ignored folders, by name not ignored; no symlinks.

    A column is_symlink, where there is one, leaves those rows out.
    """
    parts = F.split("path", "/")
    name, folders = F.element_at(parts, -1), F.slice(parts, F.lit(1), F.size(parts) - 1)
    fit = F.exists(F.array(*map(F.lit, suffixes)), lambda s: F.lower(name).endswith(F.lower(s)))
    if ignored_folders:
        fit = fit & ~F.arrays_overlap(folders, F.array(*map(F.lit, ignored_folders)))
    if ignored_names:
        fit = fit & ~name.isin(*ignored_names)
    if "is_symlink" in files.columns:
        fit = fit & ~F.coalesce("is_symlink", F.lit(False))
    return files.filter(fit)


def file_format(content: bytes | None) -> str | None:
    """pdf or epub by the bytes themselves, else None."""
    if not content:
        return None
    if content.startswith(PDF_HEAD):
        return "pdf"
    if content.startswith(ZIP_HEAD):
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                return "epub" if z.read("mimetype").strip() == EPUB_TYPE else None
        except (KeyError, zipfile.BadZipFile, OSError, NotImplementedError, RuntimeError):
            return None
    return None


def formats(files: DataFrame) -> DataFrame:
    """(path, format) of files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([file_format(c) for c in batch.column(1).to_pylist()], pa.string())], ["path", "format"])

    return files.select("path", "content").mapInArrow(run, "path string, format string")


def outcomes(files: DataFrame, state: DataFrame, aliases: DataFrame, revisions: DataFrame, max_new: int | None = None) -> DataFrame:
    """(path, outcome, doc_id, rev_id) of files; one file's trouble is its own.

    files (path, size, mtime, size_after, mtime_after, sha256, format, error): what was seen before and after hashing;
    a null size is a file that is gone. state (path, size, mtime, sha256) is the last scan's. Beyond max_new new
    documents and revisions, by path, files are deferred, and so are those whose new content rests on one of these: they
    leave no trace, so that the next scan finds them again.
    """
    old = state.select("path", F.col("size").alias("__size"), F.col("mtime").alias("__mtime"), F.col("sha256").alias("__sha"))
    seen = files.join(old, "path", "left")
    early = (
        F.when(F.col("error").isNotNull(), "error").when(F.col("size").isNull(), "missing")
        .when(F.col("__sha").isNotNull() & (F.col("size") == F.col("__size")) & (F.col("mtime") == F.col("__mtime")), "unchanged")
        .when(~(F.col("size").eqNullSafe(F.col("size_after")) & F.col("mtime").eqNullSafe(F.col("mtime_after"))), "changed_during_scan").when(F.col("format").isNull(), "invalid")
    )
    marked = seen.select("path", "sha256", early.alias("early"))
    registered = resolve(marked.filter("early is null").select("path", "sha256"), aliases, revisions)
    both = marked.join(registered.drop("sha256"), "path", "left").select("path", F.coalesce("early", "status").alias("outcome"), "doc_id", "rev_id", "event")
    if max_new is None:
        return both.drop("event")
    made = both.filter(F.col("outcome").isin("new_document", "new_revision"))
    taken = made.orderBy("path").limit(max_new).select(F.col("path").alias("event"), F.lit(True).alias("__taken"))
    late = F.col("event").isNotNull() & F.col("__taken").isNull()
    held = both.join(taken, "event", "left")
    return held.select("path", F.when(late, "deferred").otherwise(F.col("outcome")).alias("outcome"), *(F.when(~late, F.col(c)).alias(c) for c in ("doc_id", "rev_id")))


def reports(found: DataFrame, roots: DataFrame, aliases: DataFrame) -> DataFrame:
    """(root, available, discovered, <a count for each outcome>) of found (path, outcome) below roots (root, available).

    Aliases below an available root that weren't found count as missing too. Roots are the configured ones, a handful.
    """
    below = F.broadcast(roots.select("root", "available", F.concat(F.regexp_replace("root", "/+$", ""), F.lit("/")).alias("__prefix")))
    inside = lambda d: d.join(below.filter("available"), F.col("path").startswith(F.col("__prefix")))
    gone = inside(aliases.select("path").distinct().join(found.select("path"), "path", "left_anti")).select("root", F.lit("missing").alias("outcome"), F.lit(0).alias("seen"))
    every = inside(found).select("root", "outcome", F.lit(1).alias("seen")).unionAll(gone)
    counted = every.groupBy("root").agg(F.sum("seen").alias("discovered"), *(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return roots.select("root", "available").join(counted, "root", "left").select("root", "available", *map(zero, ("discovered", *OUTCOMES)))


def archive_path(sha: Column) -> Column:
    """Where the archive keeps a content."""
    return F.concat(F.substring(sha, 1, 2), F.lit("/"), sha)


def archived(files: DataFrame, store: DataFrame) -> DataFrame:
    """(sha256, size, path, action) of files (sha256, size) against stored objects (path, size): copy, keep or replace."""
    wanted = files.select("sha256", "size").distinct().withColumn("path", archive_path(F.col("sha256")))
    held = store.select("path", F.col("size").alias("__held"))
    action = F.when(F.col("__held").isNull(), "copy").when(F.col("__held") == F.col("size"), "keep").otherwise("replace")
    return wanted.join(held, "path", "left").select("sha256", "size", "path", action.alias("action"))


def verified(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """(sha256, sound) of expected (sha256, size or null) against the stored objects' bytes (path, content)."""
    got = stored.select("path", F.sha2("content", 256).alias("__sha"), F.octet_length("content").alias("__size"))
    met = expected.withColumn("path", archive_path(F.col("sha256"))).join(got, "path", "left")
    sound = (F.col("__sha") == F.col("sha256")) & (F.col("size").isNull() | (F.col("size") == F.col("__size")))
    return met.select("sha256", F.coalesce(sound, F.lit(False)).alias("sound"))


def browse_path(root: str, relative: str) -> str:
    """The path of a folder below a root; ValueError for one that is absolute, holds a zero byte, or leaves the root."""
    if "\0" in relative or posixpath.isabs(relative.strip()):
        raise ValueError("not a path below the root")
    base = posixpath.normpath(root)
    path = posixpath.normpath(posixpath.join(base, relative.strip()))
    if path != base and not path.startswith(base.rstrip("/") + "/"):
        raise ValueError("the path leaves the root")
    return path


def active_of(paths: DataFrame, aliases: DataFrame, revisions: DataFrame) -> DataFrame:
    """(path, rev_id, size) of those paths that are known: the document's active revision, not the alias's own."""
    live = revisions.filter("is_active").select("doc_id", "rev_id", "size")
    return paths.select("path").distinct().join(aliases.select("path", "doc_id"), "path").join(live, "doc_id").select("path", "rev_id", "size")


def listing(entries: DataFrame, folder: str, types: tuple[str, ...], aliases: DataFrame, revisions: DataFrame) -> DataFrame:
    """(name, is_dir, size, rev_id, title, place) of a folder's entries (path, is_dir, is_symlink, size), folders first.

    Folders are all listed, files only of the given types in any case, symlinks not at all. A file in the catalog has
    its active revision, its size there, and its name without suffix as title.
    """
    below = folder.rstrip("/") + "/"
    name = F.substring("path", len(below) + 1, 1 << 20)
    own = entries.filter(F.col("path").startswith(below) & ~F.coalesce("is_symlink", F.lit(False))).withColumn("name", name).filter(~F.contains("name", F.lit("/")))
    fit = F.exists(F.array(*map(F.lit, types)), lambda t: F.lower("name").endswith(F.lower(t)))
    own = own.filter(F.col("is_dir") | fit)
    known = active_of(own.filter(~F.col("is_dir")), aliases, revisions).withColumnRenamed("size", "__size")
    title = F.when(F.col("rev_id").isNotNull(), F.regexp_replace("name", r"(?<=.)\.[^.]*$", ""))
    met = own.join(known, "path", "left").select("name", "is_dir", F.when(~F.col("is_dir"), F.coalesce("__size", "size")).alias("size"), "rev_id", title.alias("title"))
    # A folder's entries are ranked in one task; a folder holds what one screen lists.
    order = F.row_number().over(W.orderBy(~F.col("is_dir"), F.lower("name"), "name"))
    return met.withColumn("place", order)
