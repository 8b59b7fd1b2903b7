"""Queries of coverage, system checks and capacity. A document's text is its content, a label its publication, a vector its point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.operators import health
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


def _tables(spark, sf_dir) -> dict[str, DataFrame]:
    d, labels, v = (table(spark, sf_dir, t) for t in ("documents", "labels", "embeddings"))
    content = F.sha2(F.coalesce("text", F.lit("")), 256)
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    revisions = d.select(F.col("doc_id").alias("rev_id"), content.alias("sha256"), size.alias("size"), (F.col("n_chars") > 500).alias("is_active"))
    named = d.select(F.col("doc_id").alias("rev_id"), F.col("lang"), "n_chars").join(labels.withColumnRenamed("doc_id", "rev_id"), "rev_id", "left")
    ocr = F.col("n_chars") < 400
    state = F.when(F.col("quality") == 1, "active").when(F.col("toxic") == 1, "superseded").otherwise("staged")
    points = v.select(F.col("vec_id").alias("doc_id")).join(labels, "doc_id", "left").select(F.coalesce(F.col("quality") == 1, F.lit(False)).alias("active"))
    return {
        "documents": d.select(F.col("source").alias("doc_id")).distinct(), "revisions": revisions, "archive": revisions.join(labels.select(F.col("doc_id").alias("rev_id")), "rev_id").select("sha256", "size").distinct(),
        "runs": d.select(F.col("doc_id").alias("run_id"), F.col("doc_id").alias("rev_id"), F.when(F.col("n_chars") < 200, "failed").otherwise("succeeded").alias("state")),
        "units": named.select(F.when(ocr, "ocr").otherwise("native").alias("route"), F.when(ocr, F.when(F.col("quality") == 1, "done").when(F.col("quality") == 0, "failed").otherwise("pending")).alias("ocr_state")),
        "chunks": d.filter("n_chars > 0").select(F.col("doc_id").alias("rev_id")), "batches": v.select(F.col("vec_id").alias("run_id")),
        "generations": v.select(F.col("vec_id").alias("rev_id"), F.lit("ready").alias("state"), F.size("embedding").cast("long").alias("point_count")),
        "publications": labels.join(d.select("doc_id", "source"), "doc_id").select(F.col("doc_id").alias("rev_id"), F.col("source").alias("doc_id"), state.alias("state"), F.lit(1).cast("long").alias("expected_points")),
        "points": points, "named_artifacts": v.select(F.concat(F.lit("v/"), F.col("vec_id").cast("string")).alias("path")), "artifacts": d.select(F.concat(F.lit("v/"), F.col("doc_id").cast("string")).alias("path")),
    }


BASE = """r AS (SELECT doc_id, source, n_chars, sha256(coalesce(text, '')) AS sha, strlen(coalesce(text, '')) AS size FROM documents), a AS (SELECT DISTINCT sha, size FROM r WHERE doc_id IN (SELECT doc_id FROM labels)),
p AS (SELECT l.doc_id, source, CASE WHEN quality = 1 THEN 'active' WHEN toxic = 1 THEN 'superseded' ELSE 'staged' END AS state FROM labels l JOIN documents USING (doc_id)),
u AS (SELECT CASE WHEN quality = 1 THEN 'done' WHEN quality = 0 THEN 'failed' ELSE 'pending' END AS state FROM documents LEFT JOIN labels USING (doc_id) WHERE n_chars < 400)"""


@query(f"""WITH {BASE} SELECT (SELECT count(DISTINCT source) FROM r) AS documents, (SELECT count(*) FROM r) AS revisions, (SELECT count_if(n_chars > 500) FROM r) AS active_revisions,
  (SELECT count(*) FROM r WHERE sha IN (SELECT sha FROM a)) AS archived, (SELECT count(*) FROM r WHERE sha NOT IN (SELECT sha FROM a)) AS archive_missing, (SELECT count(*) FROM r WHERE NOT n_chars < 200) AS extracted, (SELECT count(*) FROM r WHERE n_chars < 200) AS failed_extractions,
  (SELECT count(*) FROM u) AS ocr_routed, (SELECT count(*) FROM u WHERE state = 'done') AS ocr_done, (SELECT count(*) FROM u WHERE state = 'pending') AS ocr_pending, (SELECT count(*) FROM u WHERE state = 'failed') AS ocr_failed, (SELECT count(*) FROM r WHERE n_chars > 0) AS chunked,
  (SELECT count(*) FROM embeddings WHERE vec_id IN (SELECT doc_id FROM r)) AS embedded, (SELECT count(*) FROM embeddings) AS indexed, (SELECT sum(len(embedding))::BIGINT FROM embeddings) AS indexed_points, (SELECT count(*) FROM p WHERE state = 'active') AS published, (SELECT count(*) FROM p WHERE state = 'staged') AS staged,
  (SELECT count(*) FROM p WHERE state = 'superseded') AS superseded, (SELECT count(DISTINCT source) FROM p WHERE state = 'active') AS published_docs, (SELECT count(*) FROM p WHERE state = 'active') AS points_expected,
  (SELECT count(*) FROM embeddings JOIN labels ON doc_id = vec_id WHERE quality = 1) AS points_active, (SELECT count(*) FROM embeddings) AS points_total""")
def coverage_counts(spark, sf_dir):
    """All counts of the coverage report, one scan a table."""
    return health.coverage(_tables(spark, sf_dir))


@query(f"""WITH {BASE}, m AS (SELECT doc_id::VARCHAR AS one FROM r WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.sha = r.sha AND a.size = r.size)), v AS (SELECT 'v/' || vec_id AS one FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM r)),
n AS (SELECT (SELECT count(*) FROM p WHERE state = 'active') AS wanted, (SELECT count(*) FROM embeddings JOIN labels ON doc_id = vec_id WHERE quality = 1) AS got)
SELECT 'archive.links' AS name, (SELECT count(*) FROM m) = 0 AS ok, (SELECT count(*) FROM r) AS checked, (SELECT count(*) FROM m) AS missing, (SELECT coalesce(string_agg(one, ',' ORDER BY one), '') FROM (SELECT one FROM m ORDER BY one LIMIT 5)) AS first
UNION ALL SELECT 'artifacts.links', (SELECT count(*) FROM v) = 0, (SELECT count(*) FROM embeddings), (SELECT count(*) FROM v), (SELECT coalesce(string_agg(one, ',' ORDER BY one), '') FROM (SELECT one FROM v ORDER BY one LIMIT 5))
UNION ALL SELECT 'catalog.keys publications.rev_id', TRUE, (SELECT count(*) FROM p), 0, '' UNION ALL SELECT 'catalog.keys chunks.rev_id', TRUE, (SELECT count(*) FROM r WHERE n_chars > 0), 0, ''
UNION ALL SELECT 'index.points', wanted = 0 OR wanted = got, wanted, greatest(wanted - got, 0), '' FROM n
UNION ALL SELECT 'search.smoke', TRUE, (SELECT count(*) FROM documents WHERE contains(text, 'the')), 0, '' UNION ALL SELECT 'backup.files', count(*) = 0, count(*), count(*), coalesce((SELECT string_agg(one, ',' ORDER BY one) FROM (SELECT one FROM v ORDER BY one LIMIT 5)), '') FROM v""")
def system_checks(spark, sf_dir):
    """Links of revisions and artifacts, keys, points, a search and a backup."""
    t = _tables(spark, sf_dir)
    problems = t["named_artifacts"].join(t["artifacts"], "path", "left_anti")
    checks = health.system_checks(t, table(spark, sf_dir, "documents").filter(F.contains("text", F.lit("the"))), problems)
    return checks.withColumn("first", F.array_join("first", ","))


@query(f"""WITH {BASE}, w AS (SELECT doc_id FROM r WHERE n_chars < 200), e AS (SELECT vec_id AS doc_id FROM embeddings WHERE label = 0), mv AS (SELECT doc_id FROM w UNION SELECT doc_id FROM e),
s AS (SELECT count_if(doc_id IN (SELECT doc_id FROM mv)) AS superseded, count(*) AS active_points FROM p WHERE state = 'active'), c AS (SELECT *, CASE WHEN superseded > 0 THEN (5000000::HUGEINT * superseded // greatest(active_points, 1))::BIGINT END AS second FROM s)
SELECT (SELECT count(*) FROM w) AS rechunk, (SELECT count(*) FROM e) AS reembed, superseded, superseded AS migrating_points, active_points, second AS second_generation_bytes, coalesce(5000000 + second <= 6000000, TRUE) AS fits, NOT coalesce(5000000 + second <= 6000000, TRUE) AS window_required FROM c""")
def migration_capacity(spark, sf_dir):
    """What a migration makes anew, and whether both generations fit."""
    t = _tables(spark, sf_dir)
    anew = table(spark, sf_dir, "embeddings").filter("label = 0").select(F.col("vec_id").alias("rev_id"))
    return health.migration_plan(t["runs"].filter("state = 'failed'").select("rev_id"), anew, t["publications"], 5_000_000, 6_000_000)
