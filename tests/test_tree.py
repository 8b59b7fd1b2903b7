"""The folder tree source against a plain walk, and that what is pruned is never opened."""

import os
import time

from pyspark.sql import functions as F

from pagemill.operators import scan
from pagemill.sources import tree


def grow(top):
    for path, size in {"a/x.pdf": 3, "a/deep/er/y.PDF": 5, "a/.git/z.pdf": 7, "b/Thumbs.pdf": 1, "b/n.txt": 2, "b/w.epub": 9, "c/.git/deep/q.pdf": 4, "top.pdf": 6}.items():
        os.makedirs(os.path.dirname(top / path), exist_ok=True)
        (top / path).write_bytes(b"x" * size)
    os.symlink(top / "a", top / "b" / "link")
    os.symlink(top / "a" / "x.pdf", top / "b" / "l.pdf")
    os.makedirs(top / "empty")


OPTIONS = {"suffixes": (".pdf", ".epub"), "ignored_folders": (".git",), "ignored_names": ("Thumbs.pdf",)}
FOUND = {"a/x.pdf": 3, "a/deep/er/y.PDF": 5, "b/w.epub": 9, "top.pdf": 6}


def test_files_of_a_tree(spark, tmp_path):
    grow(tmp_path)
    for partitions in (1, 3, 64):
        got = tree.files(spark, [str(tmp_path), str(tmp_path / "missing")], **OPTIONS, content=True, partitions=partitions).collect()
        assert {os.path.relpath(r.path, tmp_path): r.size for r in got} == FOUND and len(got) == len(FOUND)
        assert all(bytes(r.content) == b"x" * r.size and r.root == str(tmp_path) and r.mtime <= r.arrived <= time.time() for r in got)


def test_the_same_as_binary_files_and_predicates(spark, tmp_path):
    grow(tmp_path)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select(F.regexp_replace("path", "^file:", "").alias("path"), F.col("length").alias("size"))
    links = [str(tmp_path / "b" / "link"), str(tmp_path / "b" / "l.pdf")]
    marked = listed.withColumn("is_symlink", F.exists(F.array(*map(F.lit, links)), lambda x: F.startswith(F.col("path"), x)))
    want = scan.candidates(marked, OPTIONS["suffixes"], OPTIONS["ignored_folders"], OPTIONS["ignored_names"]).select("path", "size")
    got = tree.files(spark, [str(tmp_path)], **OPTIONS).select("path", "size")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_filters_reach_the_walk(spark, tmp_path):
    grow(tmp_path)
    every = tree.files(spark, [str(tmp_path), str(tmp_path / "a")], (".pdf",))
    some = every.filter(F.col("path").startswith(f"{tmp_path}/a/d") & (F.col("root") == str(tmp_path)) & (F.col("size") > 4))
    assert [(r.root, os.path.relpath(r.path, tmp_path)) for r in some.collect()] == [(str(tmp_path), "a/deep/er/y.PDF")]
    assert every.filter((F.col("size") >= 3) & (F.col("size") < 5)).count() == 3
    assert every.filter(F.col("path").startswith(str(tmp_path)) & F.col("path").startswith(f"{tmp_path}/b/T")).count() == 1


def test_pruned_folders_are_never_opened(tmp_path, monkeypatch):
    grow(tmp_path)
    opened = []
    real = os.scandir
    monkeypatch.setattr(tree.os, "scandir", lambda p: opened.append(os.path.relpath(p, tmp_path)) or real(p))
    wanted = tree.Wanted((".pdf",), frozenset([".git"]))
    parts = tree.deal([str(tmp_path)], wanted, 3)
    assert len(parts) == 5 and opened == ["."]
    rows = [r for p in parts for r in tree.walk(p, wanted, False)]
    assert sorted(os.path.relpath(r[1], tmp_path) for r in rows) == ["a/deep/er/y.PDF", "a/x.pdf", "b/Thumbs.pdf", "top.pdf"]
    assert not any(".git" in p or "link" in p for p in opened) and opened.count("a") == 1
    opened.clear()
    narrow = tree.Wanted((".pdf",), frozenset([".git"]), prefixes=(f"{tmp_path}/a/deep/",))
    assert len([r for p in tree.deal([str(tmp_path)], narrow, 1) for r in tree.walk(p, narrow, False)]) == 1
    assert sorted(opened) == [".", "a", "a/deep", "a/deep/er"]


def test_a_file_that_vanishes_is_left_out(tmp_path):
    grow(tmp_path)
    rows = tree.walk(tree.Folder(str(tmp_path), str(tmp_path), True), tree.Wanted(), True)
    next(rows)
    for f in ("a/x.pdf", "b/w.epub", "b/n.txt"):
        os.remove(tmp_path / f)
    assert all(os.path.exists(r[1]) for r in rows)


def test_a_stream_finds_what_arrives(spark, tmp_path):
    top, out = tmp_path / "in", tmp_path / "out"
    os.makedirs(top)
    grow(top)

    def step():
        frame = tree.files(spark, [str(top)], **OPTIONS, stream=True, partitions=2)
        frame.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
        return sorted(os.path.relpath(r.path, top) for r in spark.read.schema(tree.SCHEMA).parquet(str(out)).collect())

    time.sleep(2.1)
    assert step() == sorted(FOUND)
    (top / "a" / "late.pdf").write_bytes(b"late")
    os.rename(top / "a" / "x.pdf", top / "b" / "moved.pdf")  # keeps its time, but has arrived anew
    time.sleep(2.1)
    assert step() == sorted([*FOUND, "a/late.pdf", "b/moved.pdf"])
    assert step() == sorted([*FOUND, "a/late.pdf", "b/moved.pdf"])
