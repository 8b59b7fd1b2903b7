"""Pruned searches, searches under filters, scans beyond a budget, boxes, overlaps, removals and resampling, against plain versions."""

import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.operators import bm25, catalog, evidence, hybrid, pruned, reports, scan
from pagemill.sources import boxes


def corpus(r, n, words=60):
    return [(i, " ".join(f"w{min(int(r.expovariate(0.12)), words)}" for _ in range(r.randrange(0, 40))), "ab"[i % 2]) for i in range(n)]


def plain_search(rows, queries, k, only=lambda row: True):
    """BM25 with the statistics of all rows, over those that may be found."""
    split = {i: (t or "").lower().split() for i, t, *_ in rows}
    df = Counter(w for own in split.values() for w in set(own))
    n, mean = len(rows), sum(map(len, split.values())) / len(rows)

    def weights(words):
        tf = Counter(words)
        return {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * 2.5 / (c + 1.5 * (0.25 + 0.75 * len(words) / mean)) for t, c in tf.items() if t in df}

    out = []
    for q, text in queries:
        own = weights(text.lower().split())
        scored = []
        for row in rows:
            if only(row):
                w = weights(split[row[0]])
                s = round(sum(w[t] * own[t] for t in w.keys() & own.keys()), 6)
                if s:
                    scored.append((-s, row[0]))
        out += [(q, i, -s, rank) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def same(got, want):
    got = sorted((r.query_id, r.chunk_id, r.score, r["rank"]) for r in got)
    assert [(q, i, n) for q, i, _, n in got] == [(q, i, n) for q, i, _, n in want]
    assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want, strict=True))


@pytest.fixture(scope="module")
def small(spark):
    r = random.Random(5)
    rows = corpus(r, 300)
    queries = [(q, " ".join(f"w{r.randrange(60)}" for _ in range(r.randint(1, 8)))) for q in range(12)] + [(90, ""), (91, "unknown words")]
    return rows, queries, spark.createDataFrame(rows, "chunk_id long, text string, book string").repartition(3), spark.createDataFrame(queries, "query_id long, text string")


def test_a_filter_changes_no_score(spark, small):
    rows, queries, chunks, asked = small
    same(bm25.search(chunks, asked, 7).collect(), plain_search(rows, queries, 7))
    same(bm25.search(chunks, asked, 7, only=F.col("book") == "a").collect(), plain_search(rows, queries, 7, lambda r: r[2] == "a"))
    assert bm25.search(chunks, asked, 7, only=F.lit(False)).count() == 0


def test_a_search_in_one_book_weighs_terms_by_the_whole_corpus(spark, small):
    rows, queries, chunks, asked = small
    own = chunks.withColumn("rev_id", F.col("book")).withColumn("doc_id", F.col("book")).withColumn("tokens", F.lit(5))
    revisions = spark.createDataFrame([("a", "a", True), ("b", "b", True)], "rev_id string, doc_id string, is_active boolean")
    publications = spark.createDataFrame([("a", "active"), ("b", "active")], "rev_id string, state string")
    passages, _ = hybrid.search(asked, own, revisions, publications, only=F.col("book") == "a")
    want = {}
    for q, i, _, n in sorted(plain_search(rows, queries, 60, lambda r: r[2] == "a"), key=lambda x: (x[0], x[3])):
        if n <= 12:
            want.setdefault(q, []).append(i)
    got = {}
    for p in sorted(passages.collect(), key=lambda p: (p.query_id, p.place)):
        got.setdefault(p.query_id, []).append(p.chunk_id)
    assert got == want
    # A stale payload (another revision than the stored row) is found and then removed.
    stale = own.withColumn("rev_id", F.when(F.col("chunk_id") % 5 == 0, "b").otherwise(F.col("rev_id")))
    passages, counts = hybrid.search(asked, stale, revisions, publications, only=F.col("book") == "a", stored=own)
    assert not [p for p in passages.collect() if p.chunk_id % 5 == 0] and sum(c.postvalidation_removed for c in counts.collect()) > 0


def test_a_task_hands_on_its_best_only(spark, small, monkeypatch):
    rows, queries, chunks, asked = small
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    handed = []
    real = bm25.top
    monkeypatch.setattr(bm25, "top", lambda scores, k, by, *a: handed.append(scores.count()) or real(scores, k, by, *a))
    try:
        same(bm25.search(chunks.coalesce(2), asked, 3).collect(), plain_search(rows, queries, 3))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    assert handed[0] <= 3 * len(queries) * 2  # 15 batches in two tasks


@pytest.mark.parametrize("first", [1, 5])
def test_inverted_blocks_give_the_same_hits_and_read_less(spark, small, tmp_path, first):
    rows, queries, chunks, asked = small
    size = bm25.corpus_size(chunks).first()
    pruned.inverted(chunks, rows=16, parts=3).write.parquet(str(tmp_path / "i"))
    index = spark.read.parquet(str(tmp_path / "i"))
    blocks = index.collect()
    assert sorted(i for b in blocks for i in b.chunk_ids) == [r[0] for r in rows] and max(b.n for b in blocks) <= 16
    hits, report = pruned.search(index, bm25.document_frequencies(chunks), size["n"], size["avgdl"], asked, 5, first)
    same(hits.collect(), plain_search(rows, queries, 5))
    report = {r.query_id: r for r in report.collect()}
    df = Counter(w for _, t, _ in rows for w in set(t.split()))
    assert all(r.postings == sum(df.get(w, 0) for w in set(dict(queries)[q].split())) and r.blocks == len(blocks) for q, r in report.items())
    read, every = (sum(r[c] for r in report.values()) for c in ("postings_read", "postings"))
    assert read < every
    none = pruned.search(index, bm25.document_frequencies(chunks), size["n"], size["avgdl"], asked.filter("query_id >= 90"), 5)[0]
    assert none.count() == 0


def test_most_postings_are_not_read_for_rare_terms(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, " ".join(["the", "of"] * 5 + [f"t{r.randrange(4000)}" for _ in range(30)])) for i in range(4000)]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string").repartition(4)
    queries = [(q, "the of " + " ".join(rows[q * 97][1].split()[-12:])) for q in range(20)]
    asked = spark.createDataFrame(queries, "query_id long, text string")
    size = bm25.corpus_size(chunks).first()
    pruned.inverted(chunks, rows=32).write.parquet(str(tmp_path / "i"))
    hits, report = pruned.search(spark.read.parquet(str(tmp_path / "i")), bm25.document_frequencies(chunks), size["n"], size["avgdl"], asked, 1)
    want = bm25.search(chunks, asked, 1)
    assert sorted(map(tuple, hits.select("query_id", "chunk_id", "rank").collect())) == sorted(map(tuple, want.select("query_id", "chunk_id", "rank").collect()))
    total = report.agg(F.sum("postings_read").alias("read"), F.sum("postings").alias("all")).first()
    assert total["read"] < 0.25 * total["all"], total


def test_vector_cells_give_the_same_hits_and_score_less(spark, tmp_path):
    g = np.random.default_rng(4)
    centres = g.normal(size=(20, 16)) * 3
    own = np.concatenate([centres[g.integers(0, 20, 1500)] + g.normal(size=(1500, 16)) * 0.3, np.repeat(centres[:1], 500, 0)])  # a quarter are copies
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(own)], "chunk_id long, vector array<double>").repartition(4)
    asked = spark.createDataFrame([(q, own[q * 13].tolist()) for q in range(30)] + [(99, [0.0] * 16)], "query_id long, query array<double>")
    pruned.cells(vectors, pivots=20, rows=64).write.parquet(str(tmp_path / "c"))
    index = spark.read.parquet(str(tmp_path / "c"))
    assert index.agg(F.sum("n")).first()[0] == 2000 and index.agg(F.max("n")).first()[0] <= 64
    for size in (16 << 20, 300):
        hits, report = pruned.dense(index, asked, 6, query_bytes=size)
        want = hybrid.dense_topk(vectors, asked, 6)
        assert sorted(map(tuple, hits.select("query_id", "rank", "chunk_id", "score").collect())) == sorted(map(tuple, want.select("query_id", "rank", "chunk_id", "score").collect()))
    total = report.filter("query_id <> 99").agg(F.sum("vectors_read").alias("read"), F.sum("vectors").alias("all")).first()
    assert total["read"] < 0.5 * total["all"], total


def test_contents_beyond_a_budget_are_deferred_with_all_their_paths(spark):
    def run(files, aliases, revisions, max_new):
        rows = [(p, 1, 1.0, 1, 1.0, s, "pdf", None) for p, s in files]
        f = spark.createDataFrame(rows, "path string, size long, mtime double, size_after long, mtime_after double, sha256 string, format string, error string")
        state = spark.createDataFrame([], "path string, size long, mtime double, sha256 string")
        a = spark.createDataFrame(aliases, "path string, doc_id string, rev_id string")
        v = spark.createDataFrame(revisions, "rev_id string, doc_id string, sha256 string")
        return {r.path: r for r in scan.outcomes(f, state, a, v, max_new).collect()}

    got = run([("a", "s1"), ("b", "s2"), ("c", "s2")], [], [], 1)
    assert {p: r.outcome for p, r in got.items()} == {"a": "new_document", "b": "deferred", "c": "deferred"}
    assert got["b"].rev_id is None and got["c"].doc_id is None
    # A document's new bytes come first, and a later unknown path is an alias of that revision; d's content comes too late.
    old = ([("a", "d1", "r1"), ("x", "d2", "r2")], [("r1", "d1", "old"), ("r2", "d2", "old2")])
    files = [("a", "s1"), ("b", "s1"), ("c", "old2"), ("d", "s3"), ("e", "s3"), ("x", "s3")]
    got = run(files, *old, 2)
    assert {p: r.outcome for p, r in got.items()} == {"a": "new_revision", "b": "alias", "c": "alias", "d": "new_document", "e": "alias", "x": "deferred"}
    assert (got["b"].doc_id, got["b"].rev_id) == ("d1", got["a"].rev_id) and got["c"].rev_id == "r2" and got["e"].rev_id == got["d"].rev_id
    assert {p: r.outcome for p, r in run(files, *old, 0).items()} == {"a": "deferred", "b": "deferred", "c": "alias", "d": "deferred", "e": "deferred", "x": "deferred"}
    r = random.Random(2)
    for _ in range(3):
        paths = [f"p{i:02d}" for i in range(40)]
        known = {p: (f"d{r.randrange(6)}",) for p in r.sample(paths, 12)}
        files = [(p, f"s{r.randrange(14)}") for p in paths]
        revisions = [(f"r{i}", f"d{i}", f"s{20 + i}") for i in range(6)] + [("r9", "d9", "s3")]
        aliases = [(p, d, "r" + d[1:]) for p, (d,) in known.items()]
        budget = r.randrange(8)
        # One path after another, as a scan does it.
        by_sha, left, want = {"s3": "d9"}, budget, {}
        for p, s in files:
            if p in known or s not in by_sha:
                if left:
                    left -= 1
                    want[p] = "new_revision" if p in known else "new_document"
                    by_sha.setdefault(s, known.get(p, (None,))[0])
                else:
                    want[p] = "deferred"
            else:
                want[p] = "alias"
        assert {p: x.outcome for p, x in run(files, aliases, revisions, budget).items()} == want


def test_overlaps_by_comparing_all(spark):
    r = random.Random(6)
    side = lambda n: [(r.randrange(3), a := r.randrange(3000), a + r.choice([1, 5, 40, 900]), i) for i in range(n)]
    left, right = side(120), side(150)
    for width in (7, 100, 5000):
        got = evidence.overlaps(spark.createDataFrame(left, "u int, start int, end int, l int"), spark.createDataFrame(right, "u int, r_start int, r_end int, r int"), "u", width)
        pairs = [(x.l, x.r) for x in got.collect()]
        assert sorted(pairs) == sorted((x[3], y[3]) for x in left for y in right if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])


def test_manifest_carries_boxes_anchors_and_titles(spark):
    passages = spark.createDataFrame([(1, 1, "c1", "r1", [("u1", 12, [1.0, 2.0, 3.0, 4.0]), ("u2", 0, None)]), (1, 2, "c2", "r1", [("u9", 0, None)]), (1, 3, "c3", "r1", [("u2", 5, [5.0, 6.0, 7.0, 8.0]), ("u1", 0, [1.0])])], "query_id int, place int, chunk_id string, rev_id string, spans array<struct<unit_id: string, source_start: int, bbox: array<double>>>")
    units = spark.createDataFrame([("u1", "section", 0, "s.xhtml", ["x"], "One"), ("u2", "page", 4, "v", ["y"], None)], "unit_id string, kind string, position int, ref string, flags array<string>, section string")
    paragraphs = spark.createDataFrame([("u1", 0, "p0", "ten chars."), ("u1", 1, "p1", "more")], "unit_id string, position int, anchor string, text string")
    revisions = spark.createDataFrame([("r1", "book")], "rev_id string, title string")
    got = {r.evidence_id: r for r in evidence.manifest(passages, units, revisions, paragraphs).collect()}
    one, two, three = got["E1"], got["E2"], got["E3"]
    assert (one.kind, one.anchor, one.section, one.pages) == ("section", "p1", "One", None)
    assert [(b.unit_id, b.page, b.bbox) for b in one.boxes] == [("u1", None, [1.0, 2.0, 3.0, 4.0])] and one.flags == ["x", "y"]
    assert (two.kind, two.boxes, two.anchor) == ("unknown", [], None)
    assert (three.kind, three.anchor, three.section, three.pages) == ("page", None, None, [5, 1]) and [(b.page, b.bbox) for b in three.boxes] == [(5, [5.0, 6.0, 7.0, 8.0])]


def test_boxes_go_to_the_raster_and_back(spark):
    rows = [(w, h, turn, crop, [11.0, 22.0, 33.0, 44.0]) for w, h in ((612.0, 792.0), (5000.0, 100.0), (100.0, 5000.0)) for turn in (0, 90, 180, 270, -90, 450) for crop in (None, [5.0, 6.0, 50.0, 70.0])]
    frame = spark.createDataFrame(rows, "w double, h double, turn int, crop array<double>, box array<double>")
    m = boxes.page_to_raster(F.col("w"), F.col("h"), F.col("turn"), F.col("crop"), 300, 16_000)
    made = frame.select("*", m.alias("m")).select("*", boxes.apply(F.col("m"), F.col("box"), 6).alias("r")).select("*", boxes.apply(boxes.inverse(F.col("m")), F.col("r")).alias("back"))
    for x in made.collect():
        assert x.back == pytest.approx(x.box, abs=2e-3)
    plain = made.filter("turn = 0 AND crop IS NULL AND w = 612").first()
    assert plain.r == pytest.approx([v * 300 / 72 for v in plain.box], abs=1e-5)
    # A quarter turn: what was at the lower left is at the upper left.
    quarter = made.filter("turn = 90 AND crop IS NULL AND w = 612").first()
    assert quarter.r == pytest.approx([v * 300 / 72 for v in (792 - 22 - 44, 11, 44, 33)], abs=1e-5)
    sizes = {(r.w, r.h): (round(r.s["scale"], 6), r.s["render_w"], r.s["render_h"]) for r in frame.select("w", "h", boxes.raster(F.col("w"), F.col("h")).alias("s")).collect()}
    assert sizes == {(612.0, 792.0): (round(300 / 72, 6), 2550, 3300), (5000.0, 100.0): (3.2, 16_000, 320), (100.0, 5000.0): (3.2, 320, 16_000)}
    with pytest.raises(Exception, match="not a right angle"):
        frame.select(boxes.page_to_raster(F.col("w"), F.col("h"), F.lit(45), None)).collect()


def test_full_folding_finds_all_marks(spark):
    s = spark.createDataFrame([(1, "Erdős Pál", "A"), (2, "Šafařík", ""), (3, "ǎ été", None), (4, "ế Việt", "D"), (5, "x " * 300, "E")], "rev_id long, text string, title string")
    q = spark.createDataFrame([(1, "ERDOS"), (2, "safarik"), (3, "été"), (4, "viet"), (5, "É"), (6, "a")], "query_id long, text string")
    got = {(r.query_id, r.rev_id): r for r in reports.keyword_search(s, q).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 3)}
    assert [got[k].title for k in ((1, 1), (2, 2), (3, 3))] == ["A", "2", "3"]
    long = reports.keyword_search(s, spark.createDataFrame([(7, "x")], "query_id long, text string")).first()
    assert long.excerpt == ("x " * 300)[:280]


def test_a_cascade_follows_all_relations(spark):
    tables = {
        "a": spark.createDataFrame([(1,), (2,), (3,)], "id int"), "b": spark.createDataFrame([(10, 1), (11, 2), (12, None), (13, 9)], "id int, a int"), "c": spark.createDataFrame([(20, 10, 3), (21, 11, 1), (22, 11, 2), (23, None, None)], "id int, b int, a int"),
        "d": spark.createDataFrame([(5,)], "x int"),
    }
    relations = [("b", "a", "a", "id"), ("c", "b", "b", "id"), ("c", "a", "a", "id")]
    parted = catalog.cascade(tables, relations, "a", F.col("id") == 1)
    assert list(parted) == ["c", "b", "a"] and {n: sorted(r.id for r in gone.collect()) for n, (gone, _) in parted.items()} == {"c": [20, 21], "b": [10], "a": [1]}
    assert {n: (sorted(r.id for r in kept.collect()), kept.columns) for n, (_, kept) in parted.items()} == {"c": ([22, 23], ["id", "b", "a"]), "b": ([11, 12, 13], ["id", "a"]), "a": ([2, 3], ["id"])}
    assert all(r.dangling == 0 for r in catalog.removal_report(tables, relations, "a", F.col("id") < 3).collect())
    with pytest.raises(ValueError, match="depend on one another"):
        catalog.removal_order([*relations, ("a", "c", "c", "id")], "a")
    shared = catalog.orphans(spark.createDataFrame([("s1",), ("s2",)], "sha string"), spark.createDataFrame([("s2",)], "sha string"), "sha")
    assert [r.sha for r in shared.collect()] == ["s1"]


def test_runs_are_replaced_and_other_files_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    catalog.write_runs(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "run string, v int"), path, "run")
    before = {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("run=")}
    for _ in range(2):
        catalog.write_runs(spark.createDataFrame([("a", 9), ("d", 5)], "run string, v int"), path, "run")
    after = {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("run=")}
    assert sorted((r.run, r.v) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 3), ("c", 4), ("d", 5)]
    assert all(before[d] == after[d] for d in ("run=b", "run=c")) and before["run=a"] != after["run=a"]


def test_bootstrap_intervals_are_those_of_drawing_with_replacement(spark):
    g = np.random.default_rng(3)
    groups = {"a": g.exponential(3, 400), "b": g.normal(10, 1, 60), "few": np.array([1.0, 2.0, 3.0, 4.0])}
    rows = [(k, i, float(x)) for k, own in groups.items() for i, x in enumerate(own)] + [("a", 999, None)]
    got = {r.g: r for r in reports.bootstrap(spark.createDataFrame(rows, "g string, i int, v double"), ["g"], "v", "i").collect()}
    for k in ("a", "b"):
        low, high = (x / 1000 for x in reports.bootstrap_interval(groups[k].tolist(), 1000, reps=400))
        spread = high - low
        assert abs(got[k].low - low) < 0.25 * spread and abs(got[k].high - high) < 0.25 * spread and got[k].low < got[k]["mean"] < got[k].high
    assert (got["few"].n, got["few"].low, got["few"].high) == (4, None, None) and got["few"]["mean"] == 2.5
