"""Queries of the job, funnel, evaluation, latency and summary reports, over tables that stand in for the job log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import ocr_class
from pagemill.operators import bm25, jobs, reports
from pagemill.plans.retrieval import RANKED, SCORED, STATS, TOK, chunks, questions
from pagemill.session import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_STATES = ("pending", "running", "retryable_failed", "permanent_failed", "succeeded", "succeeded", "succeeded", "succeeded")
_STAGES = ("extract", "ocr", "chunk", "embed", "publish")
JOBS = f"""j AS (SELECT event_id AS job_id, user_id AS rev_id, {list(_STAGES)}[user_id % 5 + event_id % 2 * 0 + 1] AS stage, {list(_STATES)}[event_id * 7 % 8 + 1] AS state,
  epoch(ts)::DOUBLE AS created_at, epoch(ts)::DOUBLE + value AS updated_at, CASE WHEN event_id % 3 > 0 THEN 'v' || event_id % 3 END AS created_by, CASE WHEN event_id % 6 = 0 THEN 'book_budget_parked' ELSE event_type END AS detail FROM events)"""


def _seconds(ts):
    """Seconds since 1970 of a wall clock, whatever the session's time zone and the column's kind of timestamp."""
    day = F.unix_date(F.to_date(ts)).cast("double") * 86400
    return day + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.date_part(F.lit("SECOND"), ts).cast("double")


def _jobs(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    made = _seconds(F.col("ts"))
    return e.select(
        F.col("event_id").alias("job_id"), F.col("user_id").alias("rev_id"), pick(_STAGES, F.col("user_id") % 5).alias("stage"), pick(_STATES, F.col("event_id") * 7 % 8).alias("state"),
        made.alias("created_at"), (made + F.col("value")).alias("updated_at"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("v"), (F.col("event_id") % 3).cast("string"))).alias("created_by"),
        F.when(F.col("event_id") % 6 == 0, jobs.PARKED).otherwise(F.col("event_type")).alias("detail"),
    )


@query(f"WITH {JOBS} SELECT state, count(*) AS n FROM j GROUP BY state")
def jobs_by_state(spark, sf_dir):
    return _jobs(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"))


@query(f"WITH {JOBS} SELECT stage, count(*) AS n FROM j WHERE state IN ('retryable_failed', 'permanent_failed') GROUP BY stage")
def failed_by_stage(spark, sf_dir):
    return _jobs(spark, sf_dir).filter(F.col("state").isin("retryable_failed", "permanent_failed")).groupBy("stage").agg(F.count("*").alias("n"))


@query(f"""WITH {JOBS} SELECT stage, count(*) AS jobs, count_if(state = 'succeeded')::BIGINT AS succeeded, count_if(state IN ('retryable_failed', 'permanent_failed'))::BIGINT AS failed,
  round(sum(updated_at - created_at), 1) AS seconds, round(max(updated_at - created_at), 1) AS seconds_max FROM j GROUP BY stage""")
def stage_stats(spark, sf_dir):
    return reports.stage_stats(_jobs(spark, sf_dir))


@query(f"WITH {JOBS} SELECT coalesce(created_by, 'legacy') AS created_by, count(*) AS n FROM j WHERE state IN ('pending', 'running', 'retryable_failed') AND coalesce(created_by, 'legacy') <> 'v2' GROUP BY 1")
def version_gate(spark, sf_dir):
    return reports.version_gate(_jobs(spark, sf_dir), "v2")


RANK = "CASE state WHEN 'running' THEN 4 WHEN 'pending' THEN 3 WHEN 'succeeded' THEN 1 ELSE 2 END"


@query(f"WITH {JOBS} SELECT rev_id, stage, job_id, state FROM (SELECT *, row_number() OVER (PARTITION BY rev_id, stage ORDER BY {RANK} DESC, job_id) AS n FROM j) WHERE n = 1")
def urgent_job(spark, sf_dir):
    return jobs.most_urgent(_jobs(spark, sf_dir), ["rev_id", "stage"]).select("rev_id", "stage", "job_id", "state")


SPREAD = JOBS.replace("user_id % 5 + event_id % 2 * 0", "event_id % 5").replace("event_id * 7 % 8", "event_id // 5 * 7 % 8")


@query(f"""WITH {SPREAD}, u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rev_id, stage ORDER BY {RANK} DESC, job_id) AS n FROM j) WHERE n = 1),
s AS (SELECT rev_id, max_by(stage, job_id) FILTER (WHERE state LIKE '%failed') AS fs, max_by(detail, job_id) FILTER (WHERE state LIKE '%failed') AS fd, min(stage) FILTER (WHERE state = 'running') AS rs,
  bool_or(state = 'pending') AS w, bool_or(stage = 'extract' AND state = 'succeeded') AS x FROM u GROUP BY rev_id)
SELECT c_custkey AS rev_id, CASE WHEN fd = 'book_budget_parked' THEN 'parked' WHEN fs IS NOT NULL THEN 'failed' WHEN rs IS NOT NULL THEN 'processing' WHEN w THEN 'queued'
  WHEN x THEN CASE WHEN c_custkey % 4 = 0 THEN 'superseded' WHEN c_custkey % 3 = 0 THEN 'published' ELSE 'processing' END ELSE 'unknown' END AS status, coalesce(fs, rs) AS stage
FROM customer LEFT JOIN s ON rev_id = c_custkey""")
def manual_selection_status(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rev_id"))
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    j = _jobs(spark, sf_dir).withColumn("stage", pick(_STAGES, F.col("job_id") % 5)).withColumn("state", pick(_STATES, F.floor(F.col("job_id") / 5) * 7 % 8))
    return reports.selection_status(c, c.withColumn("is_active", F.col("rev_id") % 4 != 0), j, c.filter("rev_id % 3 = 0"))


@query("""SELECT o_orderkey AS rev_id, o_orderstatus AS format, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS units, (SELECT coalesce(sum(l_quantity), 0)::BIGINT FROM lineitem WHERE l_orderkey = o_orderkey) AS chars,
  (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N') AS chunks FROM orders""")
def per_book_rollup(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("units"), F.sum("l_quantity").cast("long").alias("chars"), F.count_if(F.col("l_returnflag") == "N").alias("chunks"))
    o = table(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select(F.col("o_orderkey").alias("rev_id"), F.col("o_orderstatus").alias("format"), *(F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("units", "chars", "chunks")))


@query("""SELECT (SELECT count(*) FROM customer) AS documents, (SELECT count(*) FROM orders) AS revisions, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'O') AS extracted,
  (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS ocr_routed, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS chunked, (SELECT coalesce(sum(l_linenumber), 0)::BIGINT FROM lineitem WHERE l_linestatus = 'F') AS points,
  (SELECT count(*) FROM labels WHERE quality = 1) AS published""")
def coverage_funnel(spark, sf_dir):
    c, o, li, la = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem", "labels"))
    count = lambda t: t.agg(F.count("*"))
    return reports.funnel({
        "documents": count(c), "revisions": count(o), "extracted": o.filter("o_orderstatus = 'O'").agg(F.countDistinct("o_custkey")), "ocr_routed": count(li.filter("l_returnflag = 'R'")),
        "chunked": li.agg(F.countDistinct("l_orderkey")), "points": li.filter("l_linestatus = 'F'").agg(F.coalesce(F.sum("l_linenumber"), F.lit(0))), "published": count(la.filter("quality = 1")),
    })


@query("""SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'indexed' WHEN doc_id % 5 = 0 THEN 'embedded' WHEN doc_id % 3 = 0 THEN 'chunked' WHEN doc_id % 2 = 0 THEN 'extracted' ELSE 'registered' END AS stage,
  CASE WHEN doc_id % 6 = 0 THEN 4 WHEN doc_id % 5 = 0 THEN 3 WHEN doc_id % 3 = 0 THEN 2 WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS step FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def stalled_docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    reached = {name: d.filter(f"doc_id % {n} = 0") for name, n in (("extracted", 2), ("chunked", 3), ("embedded", 5), ("indexed", 6))}
    return reports.stalled(d, reached, table(spark, sf_dir, "labels").filter("quality = 1"))


@query("""SELECT d.doc_id, d.source, quality IS NOT NULL AS published, (SELECT count(*) FROM conversations WHERE conv_id = d.doc_id) AS chunks FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND quality = 1""")
def library_listing(spark, sf_dir):
    published = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id", F.lit(True).alias("published"))
    n = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("chunks"))
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(published, "doc_id", "left").join(n, "doc_id", "left")
    return d.select("doc_id", "source", F.coalesce("published", F.lit(False)).alias("published"), F.coalesce("chunks", F.lit(0).cast("long")).alias("chunks"))


@query("SELECT lang, count(*) AS documents, count(DISTINCT source) AS sources, sum(n_chars)::BIGINT AS chars, max(n_chars) AS longest FROM documents GROUP BY lang")
def catalog_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


@query("""SELECT conv_id * 1000 + turn AS answer_id, length(text) AS n_chars FROM conversations WHERE role = 'assistant' ORDER BY turn DESC, answer_id DESC LIMIT 20""")
def answer_history(spark, sf_dir):
    a = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.length("text").alias("n_chars"), "turn")
    return a.orderBy(F.desc("turn"), F.desc("answer_id")).limit(20).drop("turn")


@query("""WITH c AS (SELECT source, lang, n_chars, CASE WHEN doc_id % 10 / 10.0 >= 0.75 THEN 'native' WHEN doc_id % 10 / 10.0 <= 0.25 THEN 'scanned' ELSE 'mixed' END AS ocr FROM documents)
SELECT 'language' AS part, lang AS name, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM c GROUP BY lang UNION ALL SELECT 'ocr_class', ocr, count(*), sum(n_chars)::BIGINT FROM c GROUP BY ocr UNION ALL SELECT 'source', source, count(*), sum(n_chars)::BIGINT FROM c GROUP BY source""")
def corpus_section(spark, sf_dir):
    # One scan: each row is counted once in each part.
    d = table(spark, sf_dir, "documents").select("n_chars", "lang", "source", ocr_class(F.col("doc_id") % 10 / 10.0).alias("ocr"))
    part = lambda name, c: F.struct(F.lit(name).alias("part"), F.col(c).alias("name"))
    return d.select("n_chars", F.inline(F.array(part("language", "lang"), part("ocr_class", "ocr"), part("source", "source")))).groupBy("part", "name").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(f"""WITH {JOBS}, s AS (SELECT stage, round(sum(updated_at - created_at), 1) AS seconds, count(*) AS units FROM j GROUP BY stage)
SELECT stage, round(seconds / units, 6) AS seconds_per_unit, round(seconds / units * 4097557 / 3600, 3) AS hours, round(seconds / units * 4097557 / 3600 / 24, 3) AS days FROM s""")
def projections(spark, sf_dir):
    s = reports.stage_stats(_jobs(spark, sf_dir)).select("stage", "seconds", F.col("jobs").alias("units"))
    return reports.projected(s, 4097557)


@query("""SELECT source, count(*) AS books, sum(strlen(text))::BIGINT AS archive_bytes, count(*) * 64 * 4 AS vector_bytes, round(sum(strlen(text)) * 34371.0::DOUBLE / count(*) / 1e9, 3) AS library_gb FROM documents GROUP BY source""")
def storage_estimate(spark, sf_dir):
    b = F.sum(F.octet_length("text"))
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count("*").alias("books"), b.alias("archive_bytes"), (F.count("*") * 64 * 4).alias("vector_bytes"), F.round(b * 34371.0 / F.count("*") / 1e9, 3).alias("library_gb")
    )


@query(f"""WITH {TOK}, {STATS}, {SCORED}, r AS ({RANKED}), l AS (SELECT item_id AS query_id, doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))
SELECT query_id, count(*) AS expected, count(r.rank) AS found, round(count(r.rank) / count(*)::DOUBLE, 6) AS recall FROM l LEFT JOIN (SELECT * FROM r WHERE rank <= 20) r USING (query_id, chunk_id) GROUP BY query_id""")
def recall_at_k(spark, sf_dir):
    found = bm25.search(chunks(spark, sf_dir), questions(spark, sf_dir), 20)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    q = questions(spark, sf_dir).withColumnRenamed("text", "passage")
    # A stated question set against all documents; the questions are the evaluation's own, a few hundred.
    labels = d.join(F.broadcast(q), F.contains("text", "passage")).select("query_id", "chunk_id")
    return reports.recall(found, labels)


@query("""SELECT event_type, count(*) AS n, round(avg(value), 3) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS max FROM events GROUP BY event_type""")
def latency_percentiles(spark, sf_dir):
    return reports.percentiles(table(spark, sf_dir, "events").select("event_type", "value"), ["event_type"], "value")


WORDS = "regexp_extract_all(strip_accents(lower({t})), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+')"


@query(f"""WITH s AS (SELECT doc_id AS rev_id, {WORDS.format(t='text')} AS w FROM documents), size AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM s),
tf AS (SELECT rev_id, any_value(len) AS len, term, count(*) AS tf FROM (SELECT rev_id, len(w) AS len, unnest(w) AS term FROM s) GROUP BY rev_id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id AS query_id, unnest({WORDS.format(t='text')}) AS term FROM benchmark),
sc AS (SELECT query_id, rev_id, round(-sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term), size GROUP BY query_id, rev_id)
SELECT r.*, CASE WHEN rev_id % 3 = 0 THEN rev_id::VARCHAR ELSE source END AS title, substr(text, 1, 280) AS excerpt FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, rev_id) AS rank FROM sc) r JOIN documents ON doc_id = rev_id WHERE rank <= 10""")
def keyword_search(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rev_id"), "text", F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("title"))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return reports.keyword_search(s, q)


@query("""WITH p AS (SELECT source AS book, text, row_number() OVER b - 1 AS idx, count(*) OVER (PARTITION BY source) AS n, first_value(length(text)) OVER b AS first FROM documents WINDOW b AS (PARTITION BY source ORDER BY doc_id)),
k AS (SELECT *, least(16, (n - 2) // 2) AS k FROM p),
m AS (SELECT DISTINCT book, n, k, 1 + round_even((n - 1) * i / (k + 1.0::DOUBLE), 0)::BIGINT AS idx FROM (SELECT book, n, k, unnest(generate_series(1, k)) AS i FROM (SELECT DISTINCT book, n, k FROM k WHERE n > 2 AND k > 0))),
parts AS (SELECT book, 0 AS ord, substr(text, 1, 4000) AS part FROM k WHERE idx = 0
  UNION ALL SELECT book, idx, substr(text, 1, greatest(128, (16000 - least(first, 4000) - 4000) // k)::BIGINT) FROM k JOIN m USING (book, n, k, idx)
  UNION ALL SELECT book, n, right(text, 4000) FROM k WHERE n > 1 AND idx = n - 1),
j AS (SELECT book, left(string_agg(part, chr(10) || chr(10) ORDER BY ord), 16000) AS sample FROM parts GROUP BY book)
SELECT book, length(sample)::INT AS n_chars, sha256(sample) AS sha256 FROM j""")
def summary_sample(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("position"), "text")
    return reports.summary_sample(c).select("book", F.length("sample").alias("n_chars"), F.sha2("sample", 256).alias("sha256"))


CATEGORIES = (*jobs.PERMANENT, "ocr_error", "ocr_timeout", "io_error")


@query(f"""SELECT event_id, {list(CATEGORIES)}[event_id % {len(CATEGORIES)} + 1] AS category, event_id % {len(CATEGORIES)} < {len(jobs.PERMANENT)} AS permanent,
  round(least(300.0::DOUBLE, power(2.0::DOUBLE, greatest(0, event_id % 12 - 1))) * (1 + 0.2::DOUBLE * (event_id % 7) / 6), 6) AS delay FROM events""")
def retry_policy(spark, sf_dir):
    """What a failed job's category and tries lead to; the jitter is given, so that it can be checked."""
    e = table(spark, sf_dir, "events")
    category = F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.col("event_id") % len(CATEGORIES) + 1).cast("int"))
    delay = jobs.backoff(F.col("event_id") % 12, jitter=(F.col("event_id") % 7) / 6)
    return e.select("event_id", category.alias("category"), jobs.is_permanent(category).alias("permanent"), F.round(delay, 6).alias("delay"))


def job_events(spark, sf_dir) -> DataFrame:
    """A job per user: enqueued, then claimed and ended in turn."""
    e = table(spark, sf_dir, "events")
    order = F.row_number().over(bm25.W.partitionBy("user_id").orderBy("ts", "event_id"))
    kinds = ("enqueue", "claim", "heartbeat", "fail", "claim", "defer", "claim", "release", "retry", "claim", "succeed", "retry_all")
    n = e.withColumn("n", order)
    return n.select(
        F.concat(F.lit("job"), F.col("user_id").cast("string")).alias("job_id"), _seconds(F.col("ts")).alias("at"), F.col("n").cast("long").alias("seq"),
        F.element_at(F.array(*map(F.lit, kinds)), ((F.col("n") - 1) % (len(kinds) - F.col("user_id") % 3) + 1).cast("int")).alias("kind"), F.lit("t").alias("token"),
        (F.col("event_id") % 5 != 0).alias("transient"), F.col("event_type").alias("detail"),
    )


@query()
def job_fold(spark, sf_dir):
    return jobs.fold_events(job_events(spark, sf_dir))
