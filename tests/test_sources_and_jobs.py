import io
import uuid
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from pagemill.functions import ids
from pagemill.functions import text as T
from pagemill.operators import hybrid, jobs, sampling
from pagemill.plans.reporting import job_events
from pagemill.settings import Search
from pagemill.sources import markup
from pagemill.streaming.jobs import discover, fold_stream


def test_uuid5_is_pythons(spark):
    space = uuid.UUID(ids.NAMESPACES["doc"])
    names = ["", "a", "é中", "x" * 300]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.u for r in df.select(ids.document_id(F.col("n")).alias("u")).collect()] == [str(uuid.uuid5(space, n)) for n in names]


def test_clean_drops_active_content():
    body = markup.clean("<html><body onload='x'><p>a</p><script>b</script> tail<p><a href='http://x' id='k'>c</a></p><img src='//y'/></body></html>")
    assert "script" not in ElementTree.tostring(body, "unicode") and "http" not in ElementTree.tostring(body, "unicode")
    assert not body.attrib and markup.blocks(body) == (["a", "c"], None)
    assert markup.blocks(markup.clean("<b><h1> </h1><h2>T</h2><li><p>x</p></li></b>")) == (["T", "x", "x"], "T")


def test_sections_flag_bad_html(spark):
    rows = markup.sections(spark.createDataFrame([(1, "<b><p>x</p></b>"), (2, "<p>x<br></p>"), (3, None)], "page_id long, html string")).orderBy("page_id").collect()
    assert [(r.flags, [p.anchor for p in r.paragraphs]) for r in rows] == [([], ["a0000"]), (["bad_html"], []), (["bad_html"], [])]


def book(names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for n, t in names.items():
            z.writestr(n, t)
    return bytearray(out.getvalue())


def test_epub(spark):
    good = book({
        "META-INF/container.xml": "<c><rootfile full-path='o/p.opf'/></c>", "o/a.x": "<b><p>A</p></b>", "o/b.x": "<b/>",
        "o/p.opf": "<package><manifest><item id='1' href='a.x'/><item id='2' href='b.x'/></manifest><spine><itemref idref='2'/><itemref idref='1'/></spine></package>",
    })
    df = spark.createDataFrame([("g", good), ("t", book({"../x": "y"})), ("z", bytearray(b"no"))], "path string, content binary")
    rows = markup.epub_sections(df).orderBy("path", "position").collect()
    assert [(r.path, r.ref, r.error is None) for r in rows] == [("g", "o/b.x", True), ("g", "o/a.x", True), ("t", None, False), ("z", None, False)]


def test_ocr_table(spark):
    tsv = "level\n" + "\n".join("\t".join(map(str, (5, 1, b, 1, ln, w, 10 * w, 0, 20, 5, 90, t))) for b, ln, w, t in ((1, 1, 2, "b"), (1, 1, 1, "a"), (1, 2, 1, "c"), (2, 1, 1, " ")))
    words = markup.ocr_words(spark.createDataFrame([(1, tsv)], "page int, tsv string"), scale=2.0)
    assert [list(r.box) for r in words.orderBy("line", "word").collect()] == [[5, 0, 10, 2.5], [10, 0, 10, 2.5], [5, 0, 10, 2.5]]
    assert markup.ocr_text(words).first().text == "a b\nc"


def test_language(spark):
    cases = {"": "unknown", "12 !": "unknown", "the cat and the dog": "en", "der Hund und die Katze": "de", "xyz": "other", "Привет": "cyr", "日本": "cjk"}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.language(F.col("t")).alias("l")).collect()
    assert {r.t: r.l for r in got} == cases


def greedy(items, s):
    chosen, later, used = [], [], 0
    for x in items:
        if len(chosen) >= s.max_passages:
            break
        if used + x[2] > s.token_budget:
            continue
        if sum(c[1] == x[1] for c in chosen) >= s.max_per_book:
            later.append(x)
            continue
        chosen.append(x)
        used += x[2]
    for x in later:
        if len(chosen) >= s.min_passages:
            break
        if used + x[2] <= s.token_budget:
            chosen.append(x)
            used += x[2]
    return [c[0] for c in chosen]


@pytest.mark.parametrize("seed", range(4))
def test_selection_is_the_greedy_scan(spark, seed):
    import random

    r = random.Random(seed)
    items = [(i, r.choice("AB" if seed % 2 else "ABCDEFG"), r.choice((100, 900, 2500))) for i in range(50)]
    df = spark.createDataFrame([(1, i, b, n, i + 1) for i, b, n in items], "query_id int, chunk_id int, doc_id string, tokens int, rank int")
    assert [x.chunk_id for x in hybrid.select_passages(df).orderBy("place").collect()] == greedy(items, Search())


def test_quotas(spark):
    strata = spark.createDataFrame([("a", 50), ("b", 30), ("c", 1)], "stratum string, size long")
    got = {r.stratum: r.quota for r in sampling.quotas(strata, 20).collect()}
    assert got == {"a": 12, "b": 7, "c": 1}
    assert sum(r.quota for r in sampling.quotas(strata, 2).collect()) == 2


def test_job_rules():
    s = jobs.fold(jobs.State(), [(0, 0, "enqueue", None, None, None), (1, 1, "claim", "a", None, None), (2, 2, "fail", "a", True, "x")])
    assert (s.state, s.attempts, s.due) == ("retryable_failed", 1, 3.0)
    s = jobs.fold(s, [(2.5, 3, "claim", "b", None, None)])
    assert s.state == "retryable_failed"  # not due yet
    s = jobs.fold(s, [(3, 4, "claim", "b", None, None), (4, 5, "succeed", "a", None, None)])
    assert (s.state, s.stale) == ("running", 1)
    s = jobs.fold(s, [(5, 6, "release", "b", None, None)])
    assert (s.state, s.attempts, s.detail) == ("retryable_failed", 1, jobs.PARKED)
    s = jobs.fold(s, [(6, 7, "claim", "c", None, None), (400, 8, "claim", "d", None, None), (401, 9, "fail", "d", True, "y")])
    assert (s.state, s.attempts) == ("permanent_failed", 3)
    assert jobs.fold(s, [(402, 10, "retry", None, None, None)]).state == "permanent_failed"
    assert jobs.fold(s, [(403, 11, "retry_all", None, None, None)]).attempts == 0


def test_stream_gives_the_batch_result(spark, sf_dir, tmp_path):
    events = job_events(spark, sf_dir).filter("job_id < 'job3'")
    files = 3
    for i in range(files):  # a later file holds later events
        n = events.groupBy("job_id").agg(F.max("seq").alias("most"))
        events.join(n, "job_id").filter((F.col("seq") * files / (F.col("most") + 1)).cast("int") == i).drop("most").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    q = fold_stream(stream).writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {r.job_id: (r.state, r.attempts, r.due, r.detail) for r in jobs.fold_events(events).collect()}
    got = {r.job_id: (r.state, r.attempts, r.due, r.detail) for r in spark.table("folded").collect()}  # in the order of the batches
    assert got == want


def test_discovery_sees_files_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen: list = []
    take = lambda batch, _: seen.extend(r.path for r in batch.select("path").collect())
    for n in ("a.txt", "b.txt"):
        (tmp_path / "in" / n).write_text(n)
        discover(spark, str(tmp_path / "in"), str(tmp_path / "ck"), take).awaitTermination()
    assert sorted(p.rsplit("/", 1)[1] for p in seen) == ["a.txt", "b.txt"]


def test_files(spark, tmp_path):
    import json

    from pagemill.operators import embed
    from pagemill.sources import files

    (tmp_path / "s.jsonl").write_text('{"path": "a", "format": "pdf", "pages": 3}\n{"path": "b", "format": "invalid", "error": "x"}\n')
    s = files.read_survey(spark, str(tmp_path / "s.jsonl"))
    assert [r.stratum for r in files.candidates(s).collect()] == ["pdf|unknown|unknown"]
    assert files.merge_survey(s, s).count() == 2
    (tmp_path / "q.json").write_text(json.dumps({"questions": [{"id": "q007", "category": "unanswerable", "question": "x?", "answerable": False}, {"id": "q1", "category": "odd", "question": " "}]}))
    q = files.read_questions(spark, str(tmp_path / "q.json"))
    assert files.next_question_id(q).first().id == "q008"
    assert [tuple(r) for r in files.question_problems(q).collect()] == [("q1", "empty_question")]
    names = spark.createDataFrame([("7.attempt2.log",), ("x.log",)], "name string")
    assert [tuple(r) for r in files.job_logs(names, spark.createDataFrame([(7, "ocr", "running")], "job_id long, stage string, state string")).collect()] == [(7, "7.attempt2.log", 2, "ocr", "running")]
    f = lambda *rows: spark.createDataFrame(rows, "path string, size long, sha256 string")
    assert {tuple(r) for r in files.backup_problems(f(("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x")), f(("b", 2, "x"), ("c", 1, "y"), ("d", 1, "x"))).collect()} == {("a", "missing"), ("b", "size"), ("c", "content"), ("d", "extra")}
    calls = []

    def encode(batch):
        calls.append(len(batch))
        if len(batch) > 2:
            raise MemoryError
        return [[1.0]] * len(batch)

    assert len(embed.encode_halving(["a"] * 5, encode)) == 5 and calls == [5, 2, 3, 1, 2]
    df = spark.createDataFrame([("b", 2), ("a", 1), ("é", 1)], "term string, df long")
    import hashlib

    want = json.dumps({"N": 3, "avgdl": 1.5, "df": {"a": 1, "b": 2, "é": 1}, "k1": 1.5, "b": 0.75}, sort_keys=True, separators=(",", ":"))
    assert embed.stats_sha(df, 3, 1.5) == hashlib.sha256(want.encode()).hexdigest()
