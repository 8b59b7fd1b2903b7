"""Scans, artifacts, answers, epochs, job upkeep and reports on small cases."""

import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from pagemill.functions import ids
from pagemill.operators import answers, bm25, catalog, embed, evidence, hybrid, jobs, reports, scan
from pagemill.settings import Embedding
from pagemill.sources import artifacts, files


def zipped(names, method=zipfile.ZIP_STORED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for n, t in names.items():
            z.writestr(n, t)
    return bytearray(out.getvalue())


def test_formats_by_content(spark):
    cases = {
        "a": (bytearray(b"%PDF-1.7 x"), "pdf"), "b": (zipped({"mimetype": "application/epub+zip"}), "epub"), "c": (zipped({"x": "y", "mimetype": " application/epub+zip\n"}, zipfile.ZIP_DEFLATED), "epub"),
        "d": (zipped({"mimetype": "text/plain"}), None), "e": (zipped({"x": "y"}), None), "f": (bytearray(b"PK\x03\x04broken"), None), "g": (bytearray(b""), None), "h": (None, None), "i": (bytearray(b" %PDF-"), None),
    }
    got = scan.formats(spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "path string, content binary")).collect()
    assert {r.path: r.format for r in got} == {k: v[1] for k, v in cases.items()}


def test_candidates_prune(spark):
    paths = [("/a/x.PDF", False), ("/a/.git/y.pdf", False), ("/a/Thumbs.pdf", False), ("/a/z.txt", False), ("/a/link.epub", True), ("/a/b.c/w.epub", None)]
    got = scan.candidates(spark.createDataFrame(paths, "path string, is_symlink boolean"), (".pdf", ".epub"), (".git",), ("Thumbs.pdf",)).collect()
    assert {r.path for r in got} == {"/a/x.PDF", "/a/b.c/w.epub"}


@pytest.mark.parametrize("bad", ["/etc", "../x", "a/../../x", "a\0b", " /x"])
def test_browsing_stays_below_the_root(bad):
    with pytest.raises(ValueError):
        scan.browse_path("/lib", bad)


def test_browse_paths():
    assert [scan.browse_path("/lib/", p) for p in ("", ".", "a/", "a/./b", "a/../c", "..x")] == ["/lib", "/lib", "/lib/a", "/lib/a/b", "/lib/c", "/lib/..x"]


def test_vector_files_are_checked():
    raw = struct.pack("<4sIIBQ", b"LBEM", 1, 2, 0, 1) + struct.pack("<2f", 0.5, -1)
    import hashlib

    said = {"chunk_ids": ["c"], "dims": 2, "count": 1, "vector_sha256": hashlib.sha256(raw).hexdigest()}
    check = lambda data=raw, expected=("c",), **more: artifacts.vector_problem(data, json.dumps(said | more), list(expected))
    again = lambda **at: struct.pack("<4sIIBQ", *({"magic": b"LBEM", "version": 1, "dims": 2, "dtype": 0, "count": 1} | at).values()) + raw[21:]
    assert check() is None and check(None) == "missing" and check(raw[:20]) == "too_short" and check(raw + b"x") == "size"
    assert [check(again(magic=b"ABCD")), check(again(version=2)), check(again(dtype=1)), check(again(count=2))] == ["magic", "version", "dtype", "size"]
    assert artifacts.vector_problem(raw, None, ["c"]) == "missing" and artifacts.vector_problem(raw, "no json", ["c"]) == "manifest" and artifacts.vector_problem(raw, "[]", ["c"]) == "manifest"
    assert check(vector_sha256="0") == "hash" and check(expected=("d",)) == "chunk_ids" and check(dims=3) == "shape" and check(count=None) == "manifest"


def test_units_read_back(spark):
    made = artifacts.packed_units(spark.createDataFrame([("u", '{"text": "é", "b": 1}'), ("v", '{"b": 1, "text": "é"}')], "unit_id string, payload string")).collect()
    assert made[0].content == made[1].content and made[0].sha256 == made[1].sha256
    import gzip

    old = gzip.compress(b'{"schema": 0}')
    rows = [("ok", made[0].content, None), ("sum", made[0].content, "0"), ("old", old, None), ("list", gzip.compress(b"[]"), None), ("torn", made[0].content[:9], None), ("none", None, None)]
    got = {r.unit_id: (r.payload, r.problem) for r in artifacts.read_units(spark.createDataFrame(rows, "unit_id string, content binary, expected string")).collect()}
    assert got["ok"] == ('{"b": 1, "text": "\\u00e9"}', None)
    assert {k: p for k, (_, p) in got.items() if k != "ok"} == {"sum": "checksum", "old": "schema", "list": "schema", "torn": "unreadable", "none": "missing"}


def asked_of(spark):
    q = spark.createDataFrame([(1, "who?"), (2, "none?"), (3, "boom?")], "query_id int, text string")
    e = spark.createDataFrame([(i, n, "T", "page 1", "text") for i in (1, 3) for n in ("E2", "E10", "E1")], "query_id int, evidence_id string, title string, place string, text string")
    return q, e


def test_prompts_list_evidence_in_order(spark):
    p = {r.query_id: r for r in answers.prompts(*asked_of(spark)).collect()}
    assert p[1].known == ["E1", "E2", "E10"] and p[2].messages is None and p[2].known == []
    assert p[1].messages[1].content.startswith("Question: who?\n\nEvidence:\n[E1] (T: page 1)\ntext\n[E2]") and [m.role for m in p[1].messages] == ["system", "user"]


def test_answers_without_a_model(spark):
    got = {r.query_id: (r.status, r.abstain_reason, r.failure_reason) for r in answers.answers(*asked_of(spark), None).collect()}
    assert got == {1: ("failed", None, answers.NO_MODEL), 2: ("abstained", answers.NO_EVIDENCE, None), 3: ("failed", None, answers.NO_MODEL)}


def test_a_models_failure_is_its_questions_own(spark):
    def broken():
        def reply(messages):
            if "boom" in messages[1]["content"]:
                raise RuntimeError("out of reach")
            if len(messages) > 2:
                assert "E7" in messages[-1]["content"] and messages[-2]["role"] == "assistant"
                raise RuntimeError("gone")
            return "So it is [E7]."

        return reply

    got = {r.query_id: (r.status, r.failure_reason, r.repaired) for r in answers.answers(*asked_of(spark), broken).collect()}
    assert got == {1: ("failed", "answer model error during repair: gone", True), 2: ("abstained", None, False), 3: ("failed", "answer model error: out of reach", False)}


def test_epoch_policy():
    record = {"stats_sha": "s1", "bm25": "b1"}
    assert bm25.epoch_for(record, "b1", active=True) == "s1" and bm25.epoch_for(record, "b1", active=False) is None
    assert bm25.epoch_for(record, "b1", active=False, policy="frozen") == "s1" and bm25.epoch_for(record, "b2", active=True, policy="frozen") is None
    assert bm25.epoch_for(None, "b1", active=True) is None and (bm25.version_part(None), bm25.version_part(record)) == ("init", "s1")
    with pytest.raises(ValueError):
        bm25.epoch_for(record, "b1", True, "other")


def test_encoding_identity():
    a = Embedding("r1", dimensions=4)
    assert a.sha() == Embedding("r1", dimensions=4, batch=99).sha() == Embedding("r1", "r1", 4).sha() != Embedding("r1", dimensions=5).sha()
    with pytest.raises(ValueError):
        Embedding().sha()


def test_search_in_blocks_of_questions(spark, monkeypatch):
    c = spark.createDataFrame([(i, f"fox w{i % 5} dog {'fox ' * (i % 3)}", i % 2) for i in range(40)], "chunk_id int, text string, epoch int")
    q = spark.createDataFrame([(i, f"w{i} fox unknown{i}") for i in range(5)] + [(9, None), (8, "")], "query_id int, text string")
    whole = sorted(map(tuple, bm25.search(c, q, 7, ["epoch"]).collect()))
    monkeypatch.setattr(bm25, "CELLS", 4)
    assert len(bm25._question_blocks(q)) == 5 and sorted(map(tuple, bm25.search(c, q, 7, ["epoch"]).collect())) == whole and len(whole) == 2 * 5 * 7
    assert bm25.search(c, q.filter("query_id > 7"), 7).count() == 0 and bm25.search(c.limit(0), q, 7).count() == 0


def test_bm25_golden_weights(spark):
    c = spark.createDataFrame([(1, "fox fox dog"), (2, "Cat")], "chunk_id int, text string")
    w = {r.term: r.w for r in bm25.weights(bm25.term_counts(c, "chunk_id"), bm25.document_frequencies(c), bm25.corpus_size(c)).collect()}
    import math

    norm = 1.5 * (0.25 + 0.75 * 3 / 2)
    assert w["fox"] == pytest.approx(math.log(1 + 1.5 / 1.5) * 2 * 2.5 / (2 + norm)) and w["dog"] == pytest.approx(math.log(2) * 2.5 / (1 + norm)) and "cat" in w


def test_reranker_decides_within_the_cap(spark):
    v = spark.createDataFrame([(1, i, i + 1) for i in range(100)], "query_id int, chunk_id int, rank int")
    got = hybrid.reranked(v, F.col("chunk_id")).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == list(range(79, -1, -1))


def test_rekeying_leaves_held_keys(spark):
    j = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "job_id int, task_key string")
    w = spark.createDataFrame([(1, "b"), (2, "x"), (3, "x"), (4, "d")], "job_id int, task_key string")
    assert {r.job_id: r.task_key for r in catalog.rekey(j, w).collect()} == {1: "a", 2: "x", 3: "c", 4: "d"}


def test_points_and_paths(spark):
    p = spark.createDataFrame([("a", 1), ("b", 1)], "point_id string, v int")
    assert {tuple(r) for r in catalog.upsert_points(p, spark.createDataFrame([("b", 2), ("c", 2)], p.schema)).collect()} == {("a", 1), ("b", 2), ("c", 2)}
    paths = spark.createDataFrame([("/a_b/x",), ("/aXb/x",), ("/a_b",)], "path string")
    assert [r.path for r in paths.filter(catalog.under(F.col("path"), "/a_b/")).collect()] == ["/a_b/x"]


def test_claims_and_leases(spark):
    schema = "job_id int, state string, due double, lease_until double, owner string"
    j = spark.createDataFrame([(1, "running", None, 50.0, "w1"), (2, "retryable_failed", 200.0, None, None), (3, "pending", None, None, None), (4, "succeeded", None, None, None)], schema)
    first = lambda now, **k: [r.job_id for r in jobs.claimable(j, now, **k).collect()]
    assert (first(10), first(60), first(10, paused=True)) == ([3], [1], [])
    assert [r.job_id for r in jobs.dead_leases(j, spark.createDataFrame([("w2",)], "owner string")).collect()] == [1]
    assert jobs.dead_leases(j, spark.createDataFrame([("w1",)], "owner string")).count() == 0


def test_backoff(spark):
    b = spark.range(1).select(*(jobs.backoff(F.lit(n), jitter=F.lit(x)).alias(f"b{i}") for i, (n, x) in enumerate(((0, 0.0), (1, 0.0), (3, 1.0), (20, 0.5))))).first()
    assert list(b) == [1.0, 1.0, 4.8, 330.0]


def test_anchors_and_prompt_blocks(spark):
    d = spark.createDataFrame([([("a0000", "x"), ("a0001", "y")],)], "p array<struct<anchor: string, text: string>>")
    r = d.select(evidence.resolve_anchor(F.col("p"), F.lit("a0001")).alias("y"), evidence.resolve_anchor(F.col("p"), F.lit("a0009")).alias("n")).first()
    assert (r.y, r.n) == ("y", None)
    e = spark.createDataFrame([(1, "E2", None, "b"), (1, "E1", "T", "a")], "query_id int, evidence_id string, title string, text string")
    assert evidence.prompt(e).first().prompt == "[E1] T\na\n\n[E2] untitled\nb"


def test_log_tail(spark):
    d = spark.createDataFrame([(i, f"l{i}") for i in range(9)], "number int, value string")
    assert [r.value for r in files.log_tail(d, 3).collect()] == ["l6", "l7", "l8"]


def test_embedding_batches(spark):
    c = spark.createDataFrame([("a", "xx"), ("b", None)], "chunk_id string, text string")
    got = {r.chunk_id: r.vector for r in embed.embedded(c, lambda: lambda texts: [[float(len(t))] for t in texts]).collect()}
    assert got == {"a": [2.0], "b": [0.0]}
    assert c.select(embed.token_count(F.lit("a b")).alias("n")).first().n == 2


def test_identities_follow_their_form(spark):
    import uuid

    r = spark.range(1).select(ids.extraction_id(F.lit("s"), "p", "t", 32).alias("x"), ids.embedding_id(F.lit("r"), "m", "s", F.lit("c")).alias("e"), ids.unit_id(F.lit("r"), "page", F.lit(3)).alias("u")).first()
    space = lambda d: uuid.UUID(f"8f3e2a10-0000-4000-8000-0000000000{d}")
    assert r.e == str(uuid.uuid5(space("d4"), "embed:r:m:s:c")) and r.u == str(uuid.uuid5(space("d5"), "unit:r:page:3")) and r.x == str(uuid.uuid5(space("d4"), "extract:s:p:t:cap32"))


def test_bootstrap():
    low, high = reports.bootstrap_interval([1.0, 2.0, 3.0, 4.0, 5.0, 6.0], 10)
    assert 10 < low < 35 < high < 60 and reports.bootstrap_interval([1.0] * 4, 1) is None and reports.bootstrap_interval([2.0] * 5, 3) == [6, 6]


def test_evaluation_reads_as_text(spark):
    q = spark.createDataFrame([("a", True, ["c1", "c2"]), ("b", False, []), ("c", True, [])], "id string, answerable boolean, expected_chunks array<string>")
    found = spark.createDataFrame([("a", "c1", 1), ("a", "c2", 21)], "id string, chunk_id string, rank int")
    given = spark.createDataFrame([("a", "answered", ["E1"], 5.0, 7.0), ("b", "abstained", [], 6.0, None), ("c", "answered", ["E9"], 7.0, 8.0)], "id string, status string, citations array<string>, retrieval_ms double, model_ms double")
    per, summary = reports.evaluation(q, found, given, spark.createDataFrame([("a", "E1"), ("c", "E1")], "id string, evidence_id string"))
    text = reports.evaluation_text(per, summary)
    assert "recall@20: 0.500" in text and "1/1 (1.000)" in text and "1/2 (0.500)" in text and "6.0 / 7.0" in text and text.endswith("[answered] c")
    nothing = reports.evaluation(q.limit(0), found, given.limit(0), spark.createDataFrame([], "id string, evidence_id string"))
    assert "n/a" in reports.evaluation_text(*nothing) and nothing[1].first().recall_at_k is None
    assert reports.markdown(spark.createDataFrame([("x|y", 1.5, None)], "a string, b double, c int")) == "| a | b | c |\n|---|---|---|\n| x\\|y | 1.500 | n/a |"


def test_drain_and_totals(spark):
    j = spark.createDataFrame([("retryable_failed", "x", 100.0), ("retryable_failed", jobs.PARKED, 1.0), ("pending", None, 2.0)], "state string, detail string, due double")
    assert tuple(reports.drained(j, 50.0).first()) == (100.0, False) and tuple(reports.drained(j, 10.0).first()) == (100.0, True) and tuple(reports.drained(j.limit(0), 0.0).first()) == (None, True)
    r = spark.createDataFrame([(5, 1, 2, 1, 1, 0), (1, 1, 0, 0, 0, 0)], "discovered int, unchanged int, new_document int, new_revision int, alias int, deferred int")
    assert reports.pass_totals(r).first().asDict() == {"discovered": 6, "unchanged": 2, "new_document": 2, "new_revision": 1, "alias": 1, "deferred": 0, "jobs": 3}
