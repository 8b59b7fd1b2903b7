"""Queries of the scan, artifact, answer, epoch and report operators, over tables that stand in for the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import ids
from pagemill.functions.text import tokens
from pagemill.operators import answers, bm25, catalog, embed, evidence, hybrid, reports, scan
from pagemill.plans.reporting import JOBS, _jobs
from pagemill.plans.retrieval import TOK, questions
from pagemill.session import table
from pagemill.settings import Chunking, Embedding
from pagemill.sources import artifacts, files, markup

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _publications(spark, sf_dir) -> DataFrame:
    """Labelled documents: those of quality 1 are active, the others staged."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("rev_id"), F.when(F.col("quality") == 1, "active").otherwise("staged").alias("state"))


def _library(spark, sf_dir) -> DataFrame:
    return _docs(spark, sf_dir).select(
        F.col("doc_id").alias("chunk_id"), "text", F.col("doc_id").alias("rev_id"), F.col("source").alias("doc_id"), F.size(tokens(F.col("text"))).alias("tokens"), (F.substring("source", 4, 9).cast("int") % 2).alias("epoch")
    )


@query(rf"""WITH {TOK}, p AS (SELECT doc_id, quality = 1 AS live, quality <> 1 AND doc_id % 3 = 0 AS next FROM labels)
SELECT 'active' AS variant, count(*) AS n, round(sum(len(w)) / count(*), 6) AS avgdl FROM tok WHERE chunk_id IN (SELECT doc_id FROM p WHERE live)
UNION ALL SELECT 'with_staged', count(*), round(sum(len(w)) / count(*), 6) FROM tok WHERE chunk_id IN (SELECT doc_id FROM p WHERE live OR next)""")
def active_corpus_stats(spark, sf_dir):
    """The corpus of statistics: active publications, and with those that are about to be published."""
    own, pubs = _library(spark, sf_dir), _publications(spark, sf_dir)
    coming = pubs.filter("state = 'staged' and rev_id % 3 = 0")
    out = None
    for name, include in (("active", None), ("with_staged", coming)):
        one = bm25.corpus_size(bm25.active_chunks(own, pubs, include)).select(F.lit(name).alias("variant"), "n", F.round("avgdl", 6).alias("avgdl"))
        out = one if out is None else out.unionAll(one)
    return out


@query(rf"""WITH {TOK} SELECT term, count(*) AS df FROM (SELECT DISTINCT chunk_id, unnest(w) AS term FROM tok WHERE chunk_id IN (SELECT doc_id FROM labels WHERE quality = 1)) GROUP BY term""")
def active_vocabulary(spark, sf_dir):
    _, terms = bm25.statistics(bm25.active_chunks(_library(spark, sf_dir), _publications(spark, sf_dir)), "epoch")
    return terms.select("term", "df")


def _searched(spark, sf_dir, dense: bool, only=None):
    labels = table(spark, sf_dir, "labels")
    own, pubs = _library(spark, sf_dir), _publications(spark, sf_dir)
    revisions = own.select("rev_id", "doc_id").join(labels.select(F.col("doc_id").alias("rev_id"), "toxic"), "rev_id", "left").select("rev_id", "doc_id", F.coalesce(F.col("toxic") == 0, F.lit(True)).alias("is_active"))
    asked, vectors = questions(spark, sf_dir), None
    if dense:
        vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
        asked = asked.join(vectors.select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query")), "query_id")
    return hybrid.search(asked, own, revisions, pubs, vectors, only)


@query()
def search_passages(spark, sf_dir):
    """Hybrid search of every question, from lists to selected passages."""
    return _searched(spark, sf_dir, True)[0]


@query()
def search_report(spark, sf_dir):
    """What each question's hybrid search found, removed and chose."""
    return _searched(spark, sf_dir, True)[1]


@query()
def search_degraded(spark, sf_dir):
    """The same without vectors: sparse only, and said so."""
    return _searched(spark, sf_dir, False)[1]


@query()
def search_one_book(spark, sf_dir):
    """Search in one book only: it may have all places."""
    return _searched(spark, sf_dir, False, F.col("doc_id") == "src1")[0]


@query()
def index_points(spark, sf_dir):
    """Points of every chunk that has a vector, with their payload and sparse weights."""
    own = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("chunk_id"), "text", F.col("source").alias("run_id"), F.col("doc_id").cast("string").alias("rev_id"), F.col("lang").alias("doc_id"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("vector"))
    size, frequencies = bm25.sizes_and_frequencies(own)
    # The statistics are of all chunks; only chunks that have a vector make points.
    counts = bm25.term_counts(own.join(vectors.select("chunk_id"), "chunk_id", "left_semi"), "chunk_id")
    sparse = bm25.weights(counts, bm25.sendable(frequencies), size)
    p = embed.build_points(own, vectors, sparse, "rev-1", Embedding("rev-1", dimensions=64).sha(), "stats-1")
    return p.select("point_id", "payload.chunk_id", "payload.gen_id", "payload.pub_id", F.size("dense").alias("dims"), F.size("sparse.indices").alias("terms"), F.round(F.aggregate("sparse.values", F.lit(0.0), lambda acc, v: acc + v), 4).alias("weight"))


@query("""SELECT doc_id AS unit_id, sha256(CASE WHEN doc_id % 3 = 0 THEN coalesce(array_to_string(string_split(text, chr(10)), chr(10) || chr(10)), '') WHEN doc_id % 3 = 1 THEN 'read ' || doc_id WHEN doc_id % 2 = 0 THEN coalesce(text, '') ELSE coalesce(text, '') END) AS sha256 FROM documents""")
def effective_texts(spark, sf_dir):
    d = _docs(spark, sf_dir)
    k = F.col("doc_id") % 3
    paragraphs = F.transform(F.split("text", "\n"), lambda t: F.struct(t.alias("text")))
    ocr = F.when(k == 1, F.concat(F.lit("read "), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 2 == 0, F.lit("unfinished"))
    text = artifacts.effective_text(F.when(k == 0, "section").otherwise("page"), F.when(k == 1, "done").otherwise("pending"), ocr, F.col("text"), paragraphs)
    return d.select(F.col("doc_id").alias("unit_id"), F.sha2(text, 256).alias("sha256"))


@query("""SELECT doc_id AS unit_id, CASE doc_id % 5 WHEN 1 THEN 'checksum' WHEN 2 THEN 'missing' WHEN 3 THEN 'unreadable' END AS problem, CASE WHEN doc_id % 5 IN (0, 4) THEN sha256(text) END AS text_sha256 FROM documents""")
def unit_artifacts(spark, sf_dir):
    """Units stored and read back, some of them spoilt in between."""
    d = _docs(spark, sf_dir).select(F.col("doc_id").alias("unit_id"), F.to_json(F.struct("text", "lang"), {"ignoreNullFields": "false"}).alias("payload"))
    k = F.col("unit_id") % 5
    spoilt = F.when(k == 3, F.encode(F.lit("not an archive"), "UTF-8")).when(k != 2, F.col("content"))
    stored = artifacts.packed_units(d).select("unit_id", spoilt.alias("content"), F.when(k == 1, "0" * 64).when(k != 3, F.col("sha256")).alias("expected"))
    return artifacts.read_units(stored).select("unit_id", "problem", F.sha2(F.get_json_object("payload", "$.text"), 256).alias("text_sha256"))


@query("""WITH b AS (SELECT vec_id // 8 AS batch_id, count(*) AS n, round(sum(list_sum(embedding::DOUBLE[])), 4) AS total FROM embeddings GROUP BY 1)
SELECT batch_id, CASE batch_id % 7 WHEN 1 THEN 'magic' WHEN 2 THEN 'size' WHEN 3 THEN 'chunk_ids' WHEN 4 THEN 'hash' WHEN 5 THEN 'missing' WHEN 6 THEN 'too_short' END AS problem, CASE WHEN batch_id % 7 = 0 THEN n END AS vectors, CASE WHEN batch_id % 7 = 0 THEN total END AS total FROM b""")
def vector_checkpoints(spark, sf_dir):
    """Batches of vectors stored and read back, some of them spoilt in between."""
    e = table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 8).alias("batch_id")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("v"))
    e = e.select("batch_id", F.transform("v", lambda x: x["vec_id"].cast("string")).alias("chunk_ids"), F.transform("v", lambda x: x["embedding"]).alias("vectors"))
    made = artifacts.packed_vectors(e, 64).join(e.select("batch_id", "chunk_ids"), "batch_id")
    k, c = F.col("batch_id") % 7, F.col("content")
    size = F.octet_length(c)
    tail = F.substring(c, F.lit(5), size)
    spoilt = (
        F.when(k == 1, F.concat(F.encode(F.lit("XXXX"), "UTF-8"), tail)).when(k == 2, F.substring(c, F.lit(1), size - 4)).when(k == 4, F.concat(F.substring(c, F.lit(1), size - 1), F.unhex(F.lit("FE"))))
        .when(k == 6, F.substring(c, 1, 9)).when(k != 5, c)
    )
    expected = F.when(k == 3, F.array(F.lit("other"))).otherwise(F.col("chunk_ids"))
    read = artifacts.read_vectors(made.select("batch_id", spoilt.alias("content"), "manifest", expected.alias("expected")))
    total = F.aggregate(F.flatten("vectors"), F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return read.select("batch_id", "problem", F.when(F.col("vectors").isNotNull(), F.size("vectors")).cast("long").alias("vectors"), F.round(total, 4).alias("total"))


SCANNED = """f AS (SELECT doc_id, '/lib/' || source || '/' || doc_id || '.PDF' AS path, CASE WHEN doc_id % 40 IN (19, 20, 39) THEN 'pair' || (doc_id // 40) ELSE 'new' || doc_id END AS content,
  CASE WHEN doc_id % 10 = 5 THEN 'error' WHEN doc_id % 10 = 7 THEN 'missing' WHEN doc_id % 4 = 2 THEN 'unchanged' WHEN doc_id % 10 = 3 THEN 'changed_during_scan' WHEN doc_id % 10 = 1 THEN 'invalid'
  WHEN doc_id % 4 = 0 THEN 'changed' WHEN doc_id % 20 = 9 THEN 'alias' ELSE 'fresh' END AS kind FROM documents),
g AS (SELECT *, CASE kind WHEN 'changed' THEN path WHEN 'fresh' THEN min(CASE WHEN kind IN ('changed', 'fresh') THEN path END) OVER (PARTITION BY content) END AS event FROM f),
h AS (SELECT *, CASE WHEN kind = 'changed' THEN 'new_revision' WHEN kind = 'fresh' AND path = event THEN 'new_document' WHEN kind = 'fresh' THEN 'alias' ELSE kind END AS plain FROM g),
e AS (SELECT path AS event, row_number() OVER (ORDER BY path) AS place FROM h WHERE plain IN ('new_document', 'new_revision')),
o AS (SELECT h.path, CASE WHEN place > 60 THEN 'deferred' ELSE plain END AS outcome FROM h LEFT JOIN e USING (event))"""


def _scanned(spark, sf_dir):
    d = _docs(spark, sf_dir)
    i, ten = F.col("doc_id"), F.col("doc_id") % 10
    known = lambda n: F.sha2(F.concat(F.lit("old"), n.cast("string")), 256)
    new = F.when((i % 40).isin(19, 20, 39), F.concat(F.lit("pair"), F.floor(i / 40).cast("string"))).otherwise(F.concat(F.lit("new"), i.cast("string")))
    sha = F.when(i % 4 == 2, known(i)).when(i % 20 == 9, known(i - 1)).otherwise(F.sha2(new, 256))
    path = F.concat(F.lit("/lib/"), "source", F.lit("/"), i.cast("string"), F.lit(".PDF"))
    size = F.when(ten != 7, F.col("n_chars"))
    seen = d.select(
        path.alias("path"), size.alias("size"), i.cast("double").alias("mtime"), size.alias("size_after"), F.when(ten == 3, i + 1).otherwise(i).cast("double").alias("mtime_after"), sha.alias("sha256"),
        F.when(ten != 1, "pdf").alias("format"), F.when(ten == 5, "denied").alias("error"), i.alias("doc_id"),
    )
    old = seen.filter("doc_id % 2 = 0")
    named = old.select("path", ids.document_id(known(F.col("doc_id"))).alias("d"), ids.revision_id(ids.document_id(known(F.col("doc_id"))), known(F.col("doc_id"))).alias("r"), known(F.col("doc_id")).alias("s"))
    state = old.select("path", F.coalesce("size", F.lit(0).cast("long")).alias("size"), F.when(F.col("doc_id") % 4 == 2, F.col("mtime")).otherwise(F.lit(-1.0)).alias("mtime"), known(F.col("doc_id")).alias("sha256"))
    aliases, revisions = named.select("path", F.col("d").alias("doc_id"), F.col("r").alias("rev_id")), named.select(F.col("r").alias("rev_id"), F.col("d").alias("doc_id"), F.col("s").alias("sha256"))
    return scan.outcomes(scan.candidates(seen.drop("doc_id"), (".pdf", ".epub")), state, aliases, revisions, max_new=60), aliases


@query(f"WITH {SCANNED} SELECT path, outcome FROM o")
def scan_outcomes(spark, sf_dir):
    """All nine outcomes of a scan, with a budget of 60 new books; some new contents lie on several paths."""
    return _scanned(spark, sf_dir)[0].select("path", "outcome")


_COUNTS = ", ".join(f"coalesce(count_if(outcome = '{o}'), 0)::BIGINT AS {o}" for o in scan.OUTCOMES)


@query(f"WITH {SCANNED}, r AS (SELECT DISTINCT '/lib/' || source AS root, source <> 'src3' AS available FROM documents) SELECT root, available, coalesce(count(path), 0) AS discovered, {_COUNTS} FROM r LEFT JOIN o ON available AND starts_with(path, root || '/') GROUP BY root, available")
def scan_reports(spark, sf_dir):
    found, aliases = _scanned(spark, sf_dir)
    roots = _docs(spark, sf_dir).select("source").distinct().select(F.concat(F.lit("/lib/"), "source").alias("root"), (F.col("source") != "src3").alias("available"))
    return scan.reports(found, roots, aliases)


@query("""WITH s AS (SELECT DISTINCT sha256(text) AS sha256, strlen(text) AS size, min(doc_id) OVER (PARTITION BY text) AS i FROM documents)
SELECT sha256, size, sha256[1:2] || '/' || sha256 AS path, CASE i % 3 WHEN 0 THEN 'copy' WHEN 1 THEN 'keep' ELSE 'replace' END AS action FROM s""")
def archive_actions(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"), "doc_id")
    held = d.groupBy("sha256", "size").agg(F.min("doc_id").alias("i")).filter("i % 3 <> 0")
    return scan.archived(d, held.select(scan.archive_path(F.col("sha256")).alias("path"), F.when(F.col("i") % 3 == 1, F.col("size")).otherwise(F.col("size") + 1).alias("size")))


@query("SELECT sha256(text) AS sha256, min(doc_id) % 4 IN (1, 2) AS sound FROM documents GROUP BY text")
def archive_checks(spark, sf_dir):
    d = _docs(spark, sf_dir).groupBy("text").agg(F.min("doc_id").alias("i")).withColumn("sha256", F.sha2("text", 256))
    content = F.when(F.col("i") % 4 == 0, F.encode(F.concat("text", F.lit("!")), "UTF-8")).otherwise(F.encode("text", "UTF-8"))
    stored = d.filter("i % 4 <> 3").select(scan.archive_path(F.col("sha256")).alias("path"), content.alias("content"))
    return scan.verified(d.select("sha256", F.when(F.col("i") % 2 == 0, F.octet_length("text")).alias("size")), stored)


@query("""WITH e AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Dir' || doc_id WHEN doc_id % 5 = 1 THEN 'b' || doc_id || '.PDF' WHEN doc_id % 5 = 2 THEN 'A' || doc_id || '.epub' WHEN doc_id % 5 = 3 THEN 'x' || doc_id || '.txt' ELSE 'l' || doc_id || '.pdf' END AS name FROM documents WHERE source = 'src1')
SELECT name, doc_id % 5 = 0 AS is_dir, CASE WHEN doc_id % 5 > 0 THEN CASE WHEN doc_id % 2 = 0 THEN doc_id * 10 ELSE doc_id END END AS size, CASE WHEN doc_id % 5 > 0 AND doc_id % 2 = 0 THEN 'r' || doc_id END AS rev_id,
  CASE WHEN doc_id % 5 > 0 AND doc_id % 2 = 0 THEN regexp_replace(name, '\\.[^.]*$', '') END AS title, row_number() OVER (ORDER BY doc_id % 5 > 0, lower(name), name)::INT AS place FROM e WHERE doc_id % 5 IN (0, 1, 2)""")
def browse_listing(spark, sf_dir):
    """One folder of the library, with what the catalog knows of its files."""
    d = _docs(spark, sf_dir)
    five = F.col("doc_id") % 5
    i = F.col("doc_id").cast("string")
    name = F.when(five == 0, F.concat(F.lit("Dir"), i)).when(five == 1, F.concat(F.lit("b"), i, F.lit(".PDF"))).when(five == 2, F.concat(F.lit("A"), i, F.lit(".epub"))).when(five == 3, F.concat(F.lit("x"), i, F.lit(".txt"))).otherwise(F.concat(F.lit("l"), i, F.lit(".pdf")))
    folder = F.concat(F.lit("/lib/"), "source", F.lit("/"))
    e = d.select(F.concat(folder, name).alias("path"), (five == 0).alias("is_dir"), (five == 4).alias("is_symlink"), F.col("doc_id").alias("size"), "doc_id")
    aliases = e.filter("doc_id % 2 = 0").select("path", "doc_id")
    revisions = aliases.select("doc_id", F.inline(F.array(*(F.struct(F.concat(F.lit(p), F.col("doc_id").cast("string")).alias("rev_id"), (F.col("doc_id") * 10).alias("size"), F.lit(p == "r").alias("is_active")) for p in ("r", "old")))))
    return scan.listing(e.drop("doc_id"), scan.browse_path("/lib", "src1/"), (".pdf", ".epub"), aliases, revisions)


@query("""WITH s AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'epub' ELSE 'txt' END AS format, CASE WHEN doc_id % 4 = 0 THEN 'native' ELSE 'unknown' END AS ocr, lang, doc_id % 11 = 0 AS bad FROM documents)
SELECT 'format' AS part, format AS name, count(*) AS n FROM s GROUP BY format UNION ALL SELECT 'stratum', format || '|' || ocr || '|' || lang, count(*) FROM s WHERE format <> 'txt' AND NOT bad GROUP BY 2 UNION ALL SELECT 'errors', '', count(*) FROM s WHERE bad""")
def survey_summary(spark, sf_dir):
    k = F.col("doc_id") % 3
    d = _docs(spark, sf_dir).select(
        F.when(k == 0, "pdf").when(k == 1, "epub").otherwise("txt").alias("format"), F.when(F.col("doc_id") % 4 == 0, "native").otherwise("unknown").alias("ocr_class"), F.col("lang").alias("language"), F.when(F.col("doc_id") % 11 == 0, "torn").alias("error")
    )
    return reports.survey_summary(d)


@query(f"""WITH c AS (SELECT unnest({list(files.CATEGORIES)}) AS category), b AS (SELECT {list(files.CATEGORIES)}[item_id % 5 + 1] AS category, item_id % 7 > 0 AS ok FROM benchmark)
SELECT category, (SELECT count(*) FROM b WHERE b.category = c.category) AS n, (SELECT count(*) FROM b) AS total, (SELECT count_if(ok)::BIGINT FROM b) AS answerable,
  (SELECT CASE WHEN count(*) = 0 THEN 'empty' WHEN count(*) < 100 THEN 'in progress (' || count(*) || '/100)' ELSE 'target met' END FROM b) AS status FROM c""")
def bank_counts(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    category = F.element_at(F.array(*map(F.lit, files.CATEGORIES)), (F.col("item_id") % 5 + 1).cast("int"))
    return reports.bank_counts(b.select(category.alias("category"), (F.col("item_id") % 7 > 0).alias("answerable")), files.CATEGORIES)


@query(f"WITH {JOBS}, d AS (SELECT min(updated_at) AS t FROM j WHERE state = 'retryable_failed' AND detail <> 'book_budget_parked') SELECT round(t, 3) AS next_attempt, t IS NULL OR t > 60 AS drained FROM d")
def drain_probe(spark, sf_dir):
    return reports.drained(_jobs(spark, sf_dir).withColumn("due", F.col("updated_at")), 0.0).select(F.round("next_attempt", 3).alias("next_attempt"), "drained")


@query("SELECT event_id, strftime(make_timestamp(floor(epoch(ts))::BIGINT * 1000000), '%Y-%m-%d %H:%M:%S') AS stamp FROM events")
def event_stamps(spark, sf_dir):
    from pagemill.plans.reporting import _seconds

    return table(spark, sf_dir, "events").select("event_id", reports.stamp(F.floor(_seconds(F.col("ts")))).alias("stamp"))


@query("""WITH j AS (SELECT event_id AS job_id, 'k' || event_id AS task_key FROM events), w AS (SELECT job_id, 'k' || (CASE WHEN job_id % 3 = 0 THEN job_id + 1 WHEN job_id % 3 = 1 THEN -job_id ELSE -(job_id // 6) END) AS key FROM j WHERE job_id % 2 = 0),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY job_id) AS n FROM w) WHERE n = 1 AND key NOT IN (SELECT task_key FROM j))
SELECT job_id, coalesce(key, task_key) AS task_key FROM j LEFT JOIN f USING (job_id)""")
def rekey_jobs(spark, sf_dir):
    """New task keys for jobs, but for those that another job holds."""
    j = table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("task_key"))
    i = F.col("job_id")
    key = F.when(i % 3 == 0, i + 1).when(i % 3 == 1, -i).otherwise(-F.floor(i / 6))
    return catalog.rekey(j, j.filter("job_id % 2 = 0").select("job_id", F.concat(F.lit("k"), key.cast("string")).alias("task_key")))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT conv_id FROM conversations)")
def missing_summaries(spark, sf_dir):
    """Active documents for which nothing was written yet; conversations stand in for the summaries."""
    written = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    return catalog.without(_docs(spark, sf_dir).select("doc_id"), written, "doc_id", _publications(spark, sf_dir).withColumnRenamed("rev_id", "doc_id"))


@query(f"""WITH u AS (SELECT source, sha256('[' || string_agg('[' || doc_id || ',"' || sha256(text) || '"]', ',' ORDER BY doc_id) || ']') AS units FROM documents GROUP BY source)
SELECT source AS run_id, sha256(units || ':norm:{Chunking().sha()}') AS fingerprint, substr(source, 4)::INT % 3 <> 0 AS stale FROM u""")
def chunk_fingerprints(spark, sf_dir):
    """Each run's chunk fingerprint, and whether the stored one differs; every third is as it was."""
    units = _docs(spark, sf_dir).groupBy(F.col("source").alias("run_id")).agg(ids.units_fingerprint(F.col("doc_id"), F.sha2("text", 256)).alias("units"))
    now = units.select("run_id", ids.chunk_fingerprint(F.col("units"), "norm", Chunking().sha()).alias("fingerprint"))
    stored = now.select("run_id", F.when(F.substring("run_id", 4, 9).cast("int") % 3 == 0, F.col("fingerprint")).when(F.substring("run_id", 4, 9).cast("int") % 3 == 1, "0").alias("stored"))
    return now.join(stored, "run_id").select("run_id", "fingerprint", (~F.col("fingerprint").eqNullSafe(F.col("stored"))).alias("stale"))


def _evidence(spark, sf_dir) -> DataFrame:
    """Two pieces of evidence for each question but every seventh: documents by number."""
    q = questions(spark, sf_dir).filter("query_id % 7 <> 0").select("query_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    d = _docs(spark, sf_dir).select("doc_id", "source", "text")
    met = q.withColumn("doc_id", F.col("query_id") + F.col("n") - 1).join(d, "doc_id", "left")
    where = answers.place(F.when(F.col("n") == 1, "page").otherwise("section"), F.col("n"), F.lit("iv"), F.lit("c.xhtml"), F.lit("a0001"))
    return met.select("query_id", F.concat(F.lit("E"), F.col("n").cast("string")).alias("evidence_id"), F.col("source").alias("title"), where.alias("place"), "text")


def _scripted():
    """A model that answers by the question's first word's length and by how often it was asked."""

    def reply(messages: list[dict[str, str]]) -> str:
        size, again = len(messages[1]["content"].split("\n")[0]), len(messages) > 2
        return ("It is so [E1].", "ABSTAIN\nIt doesn't say.", "It is so [E2], [E1]." if again else "It is so.", "As told [E9].", "Nobody knows.")[size % 5]

    return reply


@query("""WITH q AS (SELECT item_id, item_id % 7 = 0 AS none, (length(split_part(text, chr(10), 1)) + 10) % 5 AS k FROM benchmark)
SELECT item_id AS query_id, CASE WHEN none OR k = 1 THEN 'abstained' WHEN k IN (0, 2) THEN 'answered' ELSE 'failed' END AS status,
  CASE WHEN none OR k = 1 THEN NULL WHEN k = 0 THEN 'It is so [E1].' WHEN k = 2 THEN 'It is so [E2], [E1].' WHEN k = 3 THEN 'As told [E9].' ELSE 'Nobody knows.' END AS answer_text,
  CASE WHEN none THEN 'no evidence found for this query' WHEN k = 1 THEN 'It doesn''t say.' END AS abstain_reason,
  CASE WHEN none THEN NULL WHEN k = 3 THEN 'unknown evidence IDs after one repair attempt: E9' WHEN k = 4 THEN 'answer contained no citations after one repair attempt' END AS failure_reason,
  CASE WHEN none THEN '' WHEN k = 0 THEN 'E1' WHEN k = 2 THEN 'E2,E1' ELSE '' END AS citations, NOT none AND k >= 2 AS repaired FROM q""")
def answer_questions(spark, sf_dir):
    """Every question through prompt, model, verdict and one repair; the model is a scripted one."""
    a = answers.answers(questions(spark, sf_dir), _evidence(spark, sf_dir), _scripted)
    return a.withColumn("citations", F.array_join("citations", ","))


def _evaluated(spark, sf_dir):
    q = questions(spark, sf_dir)
    some = F.when(F.col("query_id") % 3 > 0, F.array(F.col("query_id").cast("string"), (F.col("query_id") + 1).cast("string"))).otherwise(F.array().cast("array<string>"))
    bank = q.select(F.col("query_id").alias("id"), (F.col("query_id") % 4 != 1).alias("answerable"), some.alias("expected_chunks"))
    found = q.select(F.col("query_id").alias("id"), F.explode(F.array(F.lit(0), F.lit(2))).alias("step")).select("id", (F.col("id") + F.col("step")).cast("string").alias("chunk_id"), (F.col("step") * 11 + 1).alias("rank"))
    given = answers.answers(q, _evidence(spark, sf_dir), _scripted).select(F.col("query_id").alias("id"), "status", "citations", (F.col("query_id") * 1.5).alias("retrieval_ms"), F.when(F.col("query_id") % 2 == 0, F.col("query_id") * 2.0).alias("model_ms"))
    return reports.evaluation(bank, found, given, _evidence(spark, sf_dir).select(F.col("query_id").alias("id"), "evidence_id"))


@query("""WITH q AS (SELECT item_id AS id, item_id % 4 <> 1 AS answerable, item_id % 3 > 0 AS labeled, item_id % 7 = 0 AS none, (length(split_part(text, chr(10), 1)) + 10) % 5 AS k FROM benchmark),
a AS (SELECT *, CASE WHEN none OR k = 1 THEN 'abstained' WHEN k IN (0, 2) THEN 'answered' ELSE 'failed' END AS status FROM q)
SELECT 20 AS k, count(*) AS questions, count_if(labeled)::BIGINT AS labeled, round(avg(CASE WHEN labeled THEN 0.5::DOUBLE END), 6) AS recall_at_k, count_if(NOT answerable)::BIGINT AS unanswerable, count_if(NOT answerable AND status = 'abstained')::BIGINT AS abstained,
  round(count_if(NOT answerable AND status = 'abstained') / nullif(count_if(NOT answerable), 0)::DOUBLE, 6) AS abstention_rate, count_if(status = 'answered')::BIGINT AS answered, count_if(status = 'answered')::BIGINT AS all_valid,
  round(count_if(status = 'answered') / nullif(count_if(status = 'answered'), 0)::DOUBLE, 6) AS citation_rate, quantile_disc(id * 1.5::DOUBLE, 0.5) AS retrieval_ms_p50, quantile_disc(id * 1.5::DOUBLE, 0.95) AS retrieval_ms_p95,
  quantile_disc(id * 2.0::DOUBLE, 0.5) FILTER (WHERE id % 2 = 0) AS model_ms_p50, quantile_disc(id * 2.0::DOUBLE, 0.95) FILTER (WHERE id % 2 = 0) AS model_ms_p95 FROM a""")
def evaluation_report(spark, sf_dir):
    return _evaluated(spark, sf_dir)[1]


@query("""WITH e AS (SELECT doc_id % 97 AS archive, doc_id AS i, n_chars AS size FROM documents), p AS (SELECT archive, count(*) AS n, sum(size) AS size, sum(1 + i % 400) AS packed, bool_or(i % 211 = 0) AS a, bool_or(i % 173 = 0) AS c FROM e GROUP BY archive)
SELECT archive, CASE WHEN size > 100 * packed THEN 'ratio' WHEN a THEN 'absolute_path' WHEN c THEN 'path_traversal' END AS problem FROM p WHERE size > 100 * packed OR a OR c""")
def unsafe_archives(spark, sf_dir):
    i = F.col("doc_id")
    name = F.when(i % 211 == 0, F.concat(F.lit("/etc/"), i.cast("string"))).when(i % 173 == 0, F.concat(F.lit("a/../../"), i.cast("string"))).otherwise(F.concat(F.lit("text/"), i.cast("string")))
    return markup.unsafe_entries(_docs(spark, sf_dir).select((i % 97).alias("archive"), name.alias("name"), F.col("n_chars").alias("size"), (1 + i % 400).alias("packed")))


@query("""WITH r AS (SELECT doc_id, doc_id % 5 AS k FROM documents) SELECT 'p' || doc_id AS path, CASE k WHEN 0 THEN 'missing' WHEN 1 THEN 'extra' WHEN 2 THEN 'size' ELSE 'content' END AS problem FROM r WHERE k < 4""")
def backup_checks(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"), F.sha2("text", 256).alias("sha256"), (F.col("doc_id") % 5).alias("k"))
    found = d.filter("k <> 0").select("path", F.when(F.col("k") == 2, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(F.col("k") == 3, "other").otherwise(F.col("sha256")).alias("sha256"))
    return files.backup_problems(d.filter("k <> 1").drop("k"), found)


@query("""SELECT CASE WHEN event_id % 9 = 0 THEN 'x' || event_id || '.log' ELSE event_id || '.attempt' || (event_id % 3 + 1) || '.log' END AS name, event_id AS job_id, (event_id % 3 + 1)::INT AS attempt, event_type AS stage FROM events WHERE event_id % 9 <> 0""")
def attempt_logs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    name = F.when(i % 9 == 0, F.concat(F.lit("x"), i.cast("string"), F.lit(".log"))).otherwise(F.concat(i.cast("string"), F.lit(".attempt"), (i % 3 + 1).cast("string"), F.lit(".log")))
    return files.job_logs(e.select(name.alias("name")), e.select(i.alias("job_id"), F.col("event_type").alias("stage"), F.lit("succeeded").alias("state"))).drop("state")


@query("""SELECT doc_id, n AS n_pages, array_to_string(CASE WHEN n = 0 THEN [] WHEN n = 1 THEN [0] ELSE list_transform(generate_series(0, least(n, 16) - 1), lambda i: round_even(i * (n - 1) / (least(n, 16) - 1)::DOUBLE, 0)::INT) END, ',') AS sampled FROM (SELECT doc_id, (doc_id % 70)::INT AS n FROM documents)""")
def sampled_pages(spark, sf_dir):
    from pagemill.functions.text import sample_pages

    n = (F.col("doc_id") % 70).cast("int")
    return _docs(spark, sf_dir).select("doc_id", n.alias("n_pages"), F.array_join(sample_pages(n), ",").alias("sampled"))


@query("""SELECT doc_id, round(least(1.0::DOUBLE, (doc_id % 13 * (doc_id % 5) + greatest(0, doc_id % 7 - 3) * 10) / 100.0::DOUBLE), 6) AS ratio FROM documents""")
def image_areas(spark, sf_dir):
    from pagemill.functions.text import image_area_ratio

    i = F.col("doc_id").cast("double")
    boxes = F.array(F.array(F.lit(0.0), F.lit(0.0), i % 13, i % 5), F.array(F.lit(3.0), F.lit(0.0), i % 7, F.lit(10.0)))
    return _docs(spark, sf_dir).select("doc_id", F.round(image_area_ratio(boxes, F.lit(10.0), F.lit(10.0)), 6).alias("ratio"))


@query("""WITH c AS (SELECT conv_id * 1000 + turn AS answer_id, turn, text FROM conversations WHERE role = 'assistant'), n AS (SELECT *, row_number() OVER (ORDER BY turn DESC, answer_id DESC) AS r FROM c)
SELECT answer_id, length(text) % 4 AS citation_count FROM n WHERE r <= 50""")
def cited_history(spark, sf_dir):
    """The newest answers with their number of citations."""
    a = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.col("turn").alias("created_at"), "text")
    cited = a.select("answer_id", F.explode(F.sequence(F.lit(0), F.length("text") % 4)).alias("n")).filter("n > 0")
    return answers.history(a, cited).select("answer_id", "citation_count")


@query("""SELECT item_id AS query_id, 'E1' AS evidence_id, item_id % 3 <> 0 AS frozen, item_id % 3 = 1 AS live FROM benchmark""")
def resolved_citations(spark, sf_dir):
    """Citations with their frozen evidence, and whether its revision still is active."""
    q = questions(spark, sf_dir).select("query_id", F.lit("E1").alias("evidence_id"))
    frozen = q.filter("query_id % 3 <> 0").select("query_id", "evidence_id", F.col("query_id").alias("rev_id"))
    revisions = q.select(F.col("query_id").alias("rev_id"), (F.col("query_id") % 3 == 1).alias("is_active"))
    return evidence.resolve(q, frozen, revisions).select("query_id", "evidence_id", F.col("rev_id").isNotNull().alias("frozen"), "live")
