"""Folders of files as a data source: read and streamed through Spark's Python DataSource interface.

    spark.dataSource.register(FolderTree)
    spark.read.format("folder_tree").option("roots", "/books\\n/more").option("suffixes", ".pdf,.epub").load()
    spark.readStream.format("folder_tree").option(...).load()

Folders are dealt to partitions: from the roots down, folders are opened on the driver's side until there are enough of
them (or nothing is left to open); each of these is a partition, whose task walks all that lies below. Ignored folders are
never opened, nor are those that a filter on the path rules out, and symlinks are neither followed nor listed. A file
that vanishes on the way is left out. Content is read only with the option ``content``, and only of files that pass.

The folders have to be mounted on every machine, as a library's own disks are; other stores have Spark's binaryFile.

A stream's batch holds the files that arrived (changed, or were moved there) in its span of time and were still there when
it was read; a file that changes again comes again. Files are left alone until they have rested for ``settle`` seconds.
"""

from __future__ import annotations

import os
import stat
import time
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith,
)

FORMAT = "folder_tree"
SCHEMA = "root string, path string, size long, mtime double, arrived double"


@dataclass
class Folder(InputPartition):
    """A folder to walk, with all below it or without."""

    root: str
    path: str
    deep: bool


@dataclass
class Wanted:
    """What a file must be like, and which folders are opened."""

    suffixes: tuple[str, ...] = ()
    ignored_folders: frozenset[str] = frozenset()
    ignored_names: frozenset[str] = frozenset()
    prefixes: tuple[str, ...] = ()  # of which a path has one at least, if there are any
    roots: frozenset[str] | None = None
    least_size: int = 0
    most_size: int | None = None

    def opens(self, path: str) -> bool:
        """Whether files below a folder can be wanted."""
        below = path.rstrip("/") + "/"
        return not self.prefixes or any(below.startswith(p) or p.startswith(below) for p in self.prefixes)

    def takes(self, path: str, name: str) -> bool:
        fits = not self.suffixes or name.lower().endswith(self.suffixes)
        return fits and name not in self.ignored_names and (not self.prefixes or path.startswith(self.prefixes))


def _entries(path: str) -> list[os.DirEntry]:
    try:
        with os.scandir(path) as found:
            return sorted(found, key=lambda e: e.name)
    except OSError:
        return []  # gone, or not ours to read


def folders(path: str, wanted: Wanted) -> list[str]:
    """The folders in a folder that are to be opened."""
    inner = (e for e in _entries(path) if e.is_dir(follow_symlinks=False) and e.name not in wanted.ignored_folders)
    return [e.path for e in inner if wanted.opens(e.path)]


def deal(roots: list[str], wanted: Wanted, enough: int) -> list[Folder]:
    """Folders as partitions: opened level by level until there are enough that are still closed."""
    out: list[Folder] = []
    closed = deque((r, r) for r in roots if (wanted.roots is None or r in wanted.roots) and wanted.opens(r) and os.path.isdir(r))
    while closed and len(closed) < enough:
        root, path = closed.popleft()
        out.append(Folder(root, path, False))
        closed.extend((root, inner) for inner in folders(path, wanted))
    return out + [Folder(root, path, True) for root, path in closed]


def walk(part: Folder, wanted: Wanted, content: bool, since: float | None = None, until: float | None = None) -> Iterator[tuple]:
    """Rows of the files in a partition, that arrived after since and not after until."""
    left = [part.path]
    while left:
        path = left.pop()
        for entry in _entries(path):
            try:
                if entry.is_dir(follow_symlinks=False):
                    if part.deep and entry.name not in wanted.ignored_folders and wanted.opens(entry.path):
                        left.append(entry.path)
                    continue
                if not wanted.takes(entry.path, entry.name):
                    continue
                s = entry.stat(follow_symlinks=False)
                arrived = max(s.st_mtime, s.st_ctime)
                if not stat.S_ISREG(s.st_mode) or s.st_size < wanted.least_size or (wanted.most_size is not None and s.st_size > wanted.most_size):
                    continue
                if (since is not None and arrived <= since) or (until is not None and arrived > until):
                    continue
                row = (part.root, entry.path, s.st_size, s.st_mtime, arrived)
                if content:
                    with open(entry.path, "rb") as f:
                        row += (f.read(),)
                yield row
            except OSError:
                continue


class TreeReader(DataSourceReader):
    def __init__(self, roots: list[str], wanted: Wanted, content: bool, enough: int):
        self.roots, self.wanted, self.content, self.enough = roots, wanted, content, enough

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        w = self.wanted
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            value = getattr(f, "value", None)
            if isinstance(f, StringStartsWith) and column == "path" and not w.prefixes:
                w.prefixes = (value,)
            elif isinstance(f, (EqualTo, In)) and column == "root" and w.roots is None:
                w.roots = frozenset([value] if isinstance(f, EqualTo) else value)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and column == "size":
                w.least_size = max(w.least_size, value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)) and column == "size":
                most = value - isinstance(f, LessThan)
                w.most_size = most if w.most_size is None else min(w.most_size, most)
            else:
                yield f

    def partitions(self) -> list[Folder]:
        return deal(self.roots, self.wanted, self.enough) or [Folder("", "", False)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        return walk(partition, self.wanted, self.content) if partition.path else iter(())


class TreeStream(DataSourceStreamReader):
    def __init__(self, roots: list[str], wanted: Wanted, content: bool, enough: int, settle: float):
        self.roots, self.wanted, self.content, self.enough, self.settle = roots, wanted, content, enough, settle

    def initialOffset(self) -> dict:  # noqa: N802
        return {"until": 0.0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"until": time.time() - self.settle}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Span(f, start["until"], end["until"]) for f in deal(self.roots, self.wanted, self.enough)]

    def read(self, partition: _Span) -> Iterator[tuple]:
        return walk(partition.folder, self.wanted, self.content, partition.since, partition.until)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class _Span(InputPartition):
    folder: Folder
    since: float
    until: float


class FolderTree(DataSource):
    """Options: roots (one a line), suffixes, ignored_folders and ignored_names (comma-joined), content, partitions, settle."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA + (", content binary" if self._content() else "")

    def _content(self) -> bool:
        return str(self.options.get("content", "false")).lower() == "true"

    def _parts(self) -> tuple[list[str], Wanted, bool, int]:
        listed = lambda name: [x for x in (self.options.get(name) or "").split(",") if x]
        roots = [os.path.normpath(r) for r in (self.options.get("roots") or self.options.get("path") or "").split("\n") if r]
        if not roots:
            raise ValueError("the option roots names no folder")
        wanted = Wanted(tuple(s.lower() for s in listed("suffixes")), frozenset(listed("ignored_folders")), frozenset(listed("ignored_names")))
        return roots, wanted, self._content(), int(self.options.get("partitions", 64))

    def reader(self, schema) -> TreeReader:
        return TreeReader(*self._parts())

    def streamReader(self, schema) -> TreeStream:  # noqa: N802
        return TreeStream(*self._parts(), float(self.options.get("settle", 2)))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FolderTree)


def files(spark: SparkSession, roots: list[str], suffixes: tuple[str, ...] = (), ignored_folders: tuple[str, ...] = (), ignored_names: tuple[str, ...] = (), content: bool = False, partitions: int = 64, stream: bool = False):
    """(root, path, size, mtime, arrived[, content]) of the files below some roots."""
    register(spark)
    reader = (spark.readStream if stream else spark.read).format(FORMAT).option("roots", "\n".join(roots)).option("partitions", partitions)
    for name, value in (("suffixes", suffixes), ("ignored_folders", ignored_folders), ("ignored_names", ignored_names)):
        reader = reader.option(name, ",".join(value))
    return reader.option("content", str(content).lower()).load()
