"""Queries of the identity, catalog, merge and publication operators, over tables that stand in for the catalog's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import ids
from pagemill.operators import catalog
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


def _uuid_sql(kind: str, name: str) -> str:
    """uuid5 in DuckDB."""
    space = ids.NAMESPACES[kind].replace("-", "")
    h = f"sha1(unhex('{space}') || encode({name}))"
    return f"(SELECT h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || printf('%x', (('0x' || h[17:17])::INT & 3) | 8) || h[18:20] || '-' || h[21:32] FROM (SELECT {h} AS h))"


DOC_SQL = _uuid_sql("doc", "sha")


def _files(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.lit("/library/"), F.col("source"), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt")).alias("path"), F.sha2("text", 256).alias("sha256"), F.length("text").alias("size"))


FILES = "files AS (SELECT doc_id AS n, '/library/' || source || '/' || lpad(doc_id::VARCHAR, 8, '0') || '.txt' AS path, sha256(text) AS sha, length(text) AS size FROM documents)"


@query(f"WITH {FILES}, d AS (SELECT n AS doc_id, sha, {DOC_SQL} AS document FROM files) SELECT doc_id, document, {_uuid_sql('rev', 'document || chr(58) || sha')} AS revision FROM d")
def doc_identity(spark, sf_dir):
    f = _files(spark, sf_dir).withColumn("document", ids.document_id(F.col("sha256")))
    return f.select("doc_id", "document", ids.revision_id(F.col("document"), F.col("sha256")).alias("revision"))


@query(f"WITH {FILES} SELECT n AS doc_id, {_uuid_sql('task', chr(39) + 'extract:' + chr(39) + ' || n::VARCHAR || chr(58) || sha || chr(58)')} AS task_key FROM files")
def task_keys(spark, sf_dir):
    return _files(spark, sf_dir).select("doc_id", ids.task_key("extract", F.col("doc_id"), F.col("sha256")).alias("task_key"))


def _catalog(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files now; aliases and revisions as of before, when every third file was known, half of these with other bytes."""
    f = _files(spark, sf_dir)
    before = f.filter("doc_id % 3 = 0").withColumn("old", F.when(F.col("doc_id") % 2 == 0, F.col("sha256")).otherwise(F.sha2(F.concat(F.lit("old"), "sha256"), 256)))
    holders = before.groupBy("old").agg(F.min("doc_id").alias("k"))
    revisions = holders.select(F.concat(F.lit("r"), F.col("k").cast("string")).alias("rev_id"), F.concat(F.lit("d"), F.col("k").cast("string")).alias("doc_id"), F.col("old").alias("sha256"))
    aliases = before.join(holders, "old").select("path", F.concat(F.lit("d"), F.col("k").cast("string")).alias("doc_id"), F.concat(F.lit("r"), F.col("k").cast("string")).alias("rev_id"))
    return f, aliases, revisions


REGISTER = f"""{FILES}, b AS (SELECT *, CASE WHEN n % 2 = 0 THEN sha ELSE sha256('old' || sha) END AS old FROM files WHERE n % 3 = 0),
revisions AS (SELECT 'r' || min(n) AS rev_id, 'd' || min(n) AS doc_id, old AS sha FROM b GROUP BY old),
aliases AS (SELECT path, doc_id, rev_id, old FROM b JOIN revisions r ON r.sha = b.old),
s AS (SELECT f.path, f.sha, a.doc_id AS kd, a.rev_id AS kr, a.old AS ks, r.doc_id AS hd, r.rev_id AS hr FROM files f LEFT JOIN aliases a USING (path) LEFT JOIN revisions r ON r.sha = f.sha),
e AS (SELECT sha, min(path) AS fp FROM s WHERE CASE WHEN kd IS NOT NULL THEN ks <> sha ELSE hd IS NULL END GROUP BY sha),
t AS (SELECT s.*, fp, fd FROM s LEFT JOIN (SELECT e.sha, fp, kd AS fd FROM e JOIN s ON s.path = fp) USING (sha)),
u AS (SELECT path, sha AS sha256, kr, hr, kd, hd, coalesce(kd, hd, fd, {DOC_SQL}) AS doc_id, CASE WHEN kd IS NOT NULL AND ks = sha THEN 'unchanged' WHEN kd IS NOT NULL THEN 'new_revision' WHEN hd IS NOT NULL THEN 'alias' WHEN path = fp THEN 'new_document' ELSE 'alias' END AS status, sha FROM t)"""


@query(f"""WITH {REGISTER} SELECT path, sha256, doc_id, CASE WHEN status = 'unchanged' THEN kr WHEN kd IS NULL AND hd IS NOT NULL THEN hr ELSE {_uuid_sql('rev', 'doc_id || chr(58) || sha')} END AS rev_id, status FROM u""")
def register_batch(spark, sf_dir):
    return catalog.register(*(x if i else x.select("path", "sha256") for i, x in enumerate(_catalog(spark, sf_dir))))


@query(f"""WITH {FILES}, v AS (SELECT path, size, n * 10 AS mtime, sha FROM files WHERE n % 7 <> 0), o AS (SELECT path, CASE WHEN n % 4 = 1 THEN size + 1 ELSE size END AS size, CASE WHEN n % 4 = 2 THEN 0 ELSE n * 10 END AS mtime, CASE WHEN n % 4 = 1 THEN 'x' ELSE sha END AS sha FROM files WHERE n % 5 <> 0),
d AS (SELECT path, CASE WHEN v.size IS NULL THEN 'missing' WHEN o.size IS NULL THEN 'new' WHEN v.size = o.size AND v.mtime = o.mtime THEN 'unchanged' WHEN v.sha = o.sha THEN 'touched' ELSE 'changed' END AS outcome FROM v FULL JOIN o USING (path)),
t AS (SELECT path FROM d WHERE outcome IN ('new', 'changed') ORDER BY path LIMIT 50)
SELECT path, CASE WHEN outcome IN ('new', 'changed') AND path NOT IN (SELECT path FROM t) THEN 'deferred' ELSE outcome END AS outcome FROM d""")
def scan_diff(spark, sf_dir):
    f = _files(spark, sf_dir)
    visible = f.filter("doc_id % 7 <> 0").select("path", "size", (F.col("doc_id") * 10).alias("mtime"), "sha256")
    k = F.col("doc_id") % 4
    state = f.filter("doc_id % 5 <> 0").select(
        "path", F.when(k == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(k == 2, 0).otherwise(F.col("doc_id") * 10).alias("mtime"), F.when(k == 1, "x").otherwise(F.col("sha256")).alias("sha256")
    )
    return catalog.scan_diff(visible, state, 50)


@query("""WITH o AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new ' || c_name END AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 5 <> 0)
SELECT c_custkey, coalesce(n.c_name, o.c_name) AS c_name, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal FROM o FULL JOIN n USING (c_custkey)""")
def merge_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = c.filter("c_custkey % 5 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("new "), "c_name")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return catalog.merge(c.filter("c_custkey % 3 <> 0"), new, ["c_custkey"], keep=("c_name",))


@query("""WITH o AS (SELECT c_custkey % 400 AS k, min(c_custkey) AS v FROM customer WHERE c_custkey % 400 < 200 GROUP BY 1), n AS (SELECT c_custkey % 400 AS k, min(c_custkey) AS v FROM customer GROUP BY 1)
SELECT * FROM o UNION ALL SELECT * FROM n WHERE k NOT IN (SELECT k FROM o)""")
def insert_or_ignore(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 400).alias("k"), F.col("c_custkey").alias("v"))
    return catalog.insert_or_ignore(c.filter("k < 200").groupBy("k").agg(F.min("v").alias("v")), c, ["k"], ["v"])


@query(f"WITH {FILES} SELECT path FROM files WHERE (path LIKE '/library/src1/%' OR path LIKE '/library/src2/%') AND n % 3 = 0")
def alias_prune(spark, sf_dir):
    f = _files(spark, sf_dir)
    mounts = spark.createDataFrame([("/library/src1", True), ("/library/src2/", True), ("/library/src3", False)], "root string, present boolean")
    return catalog.prune_aliases(f.select("path"), f.filter("doc_id % 3 <> 0").select("path"), mounts)


@query(f"WITH {FILES} SELECT path, n * 10.0::DOUBLE AS mtime FROM files WHERE n * 10 <= 4400 AND n NOT IN (SELECT doc_id FROM labels)")
def gc_candidates(spark, sf_dir):
    f = _files(spark, sf_dir)
    used = f.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("path")
    return catalog.unreferenced(f.select("path", (F.col("doc_id") * 10.0).alias("mtime")), used, "path", now=5000.0)


@query(f"WITH {FILES} SELECT path FROM files WHERE n IN (SELECT doc_id FROM labels) AND n % 9 = 0")
def missing_artifacts(spark, sf_dir):
    f = _files(spark, sf_dir)
    used = f.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("path")
    return catalog.missing(used, f.filter("doc_id % 9 <> 0").select("path"), "path")


STATES = "CASE o_orderstatus WHEN 'F' THEN 'superseded' WHEN 'O' THEN 'active' ELSE 'staged' END"


def _publications(spark, sf_dir) -> DataFrame:
    s = F.when(F.col("o_orderstatus") == "F", "superseded").when(F.col("o_orderstatus") == "O", "active").otherwise("staged")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pub_id"), (F.col("o_orderkey") % 5000).alias("rev_id"), F.col("o_custkey").alias("doc_id"), s.alias("state"))


@query(f"""WITH p AS (SELECT o_orderkey AS pub_id, o_orderkey % 5000 AS rev_id, o_custkey AS doc_id, {STATES} AS state FROM orders), n AS (SELECT * FROM p WHERE state = 'staged' AND pub_id % 3 = 0)
SELECT pub_id, rev_id, doc_id, CASE WHEN pub_id IN (SELECT pub_id FROM n) THEN 'active' WHEN state = 'active' AND doc_id IN (SELECT doc_id FROM n) THEN 'superseded' WHEN state = 'staged' AND rev_id IN (SELECT rev_id FROM n) THEN 'superseded' ELSE state END AS state FROM p""")
def publish_snapshot(spark, sf_dir):
    p = _publications(spark, sf_dir)
    return catalog.publish(p, p.filter("state = 'staged' AND pub_id % 3 = 0").select("pub_id", "rev_id", "doc_id"))


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS pub_id, l_orderkey * 10 + l_linenumber AS point FROM lineitem), g AS (SELECT pub_id, point, pub_id % 3 = 0 AS active FROM e WHERE point % 11 <> 0),
c AS (SELECT pub_id, count(e.point) AS w, count(g.point) AS got, count_if(active) AS live FROM e LEFT JOIN g USING (pub_id, point) GROUP BY pub_id)
SELECT o_orderkey AS pub_id, CASE WHEN coalesce(w, 0) = o_orderkey % 7 + 1 AND coalesce(got, 0) = coalesce(w, 0) THEN CASE WHEN live > 0 THEN 'promote' WHEN o_custkey % 2 = 0 THEN 'leave' ELSE 'delete' END ELSE 'leave' END AS action FROM orders LEFT JOIN c ON pub_id = o_orderkey""")
def reconcile_states(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    staged = o.select(F.col("o_orderkey").alias("pub_id"), F.col("o_custkey").alias("rev_id"), (F.col("o_orderkey") % 7 + 1).alias("expected_points"))
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pub_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point_id")).distinct()
    points = e.filter("point_id % 11 <> 0").withColumn("active", F.col("pub_id") % 3 == 0)
    return catalog.reconcile(staged, e, points, o.filter("o_custkey % 2 = 0").select(F.col("o_custkey").alias("rev_id")))


@query(f"SELECT DISTINCT o_orderkey % 5000 AS rev_id FROM orders WHERE {STATES} = 'active' AND o_orderpriority[1] <> '1' AND o_orderkey % 2 = 0")
def epoch_fanout(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    p = _publications(spark, sf_dir).withColumn("gen_id", F.col("pub_id"))
    g = o.select(F.col("o_orderkey").alias("gen_id"), F.substring("o_orderpriority", 1, 1).alias("stats_sha"), (F.col("o_orderkey") % 2).alias("embedding_sha"))
    return catalog.epoch_fanout(p, g, F.lit("1"), F.lit(0))


@query("""SELECT 'customer' AS name, count(*) AS rows FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey = 7
UNION ALL SELECT 'lineitem', count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey = 7""")
def remove_cascade_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    lines = table(spark, sf_dir, "lineitem").join(o, F.col("o_orderkey") == F.col("l_orderkey")).select("k")
    return catalog.removal_counts({"customer": table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "k"), "orders": o, "lineitem": lines}, "k", 7)


@query("""SELECT l_orderkey % 500 AS run_id, count(*) AS chunks, ceil(count(*) / 8.0)::BIGINT AS expected, count(DISTINCT CASE WHEN l_quantity < 40 THEN l_linenumber END) AS found FROM lineitem GROUP BY 1
HAVING ceil(count(*) / 8.0) <> count(DISTINCT CASE WHEN l_quantity < 40 THEN l_linenumber END)""")
def embedding_gaps(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("run_id", F.col("l_orderkey") % 500)
    return catalog.embedding_gaps(li, li.filter("l_quantity < 40").select("run_id", F.col("l_linenumber").alias("batch_index")))


@query("""WITH r AS (SELECT o_custkey AS rev_id, o_orderpriority[1] AS parser, o_orderstatus AS settings, CASE WHEN o_totalprice > 100000 THEN 'succeeded' ELSE 'failed' END AS state FROM orders)
SELECT DISTINCT rev_id FROM r WHERE rev_id NOT IN (SELECT rev_id FROM r WHERE parser = '2' AND settings = 'O' AND state = 'succeeded')""")
def version_drift(spark, sf_dir):
    r = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("rev_id"), F.substring("o_orderpriority", 1, 1).alias("parser"), F.col("o_orderstatus").alias("settings"), F.when(F.col("o_totalprice") > 100000, "succeeded").otherwise("failed").alias("state"))
    return catalog.drift(r, "2", "O")


@query("""SELECT s_suppkey, s_nationkey, CASE WHEN s_nationkey = 3 AND s_suppkey NOT IN (4, 8) THEN FALSE ELSE s_acctbal > 0 END AS active FROM supplier WHERE NOT (s_nationkey IN (1, 2) AND s_acctbal IS DISTINCT FROM 0)""")
def point_filters(spark, sf_dir):
    p = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal", (F.col("s_acctbal") > 0).alias("active"))
    p = catalog.set_active(p, [("s_nationkey", "eq", 3), ("s_suppkey", "ne", 4), ("s_suppkey", "ne", 8)], False)
    return catalog.delete_points(p, [("s_nationkey", "in", [1, 2]), ("s_acctbal", "ne", 0.0)]).select("s_suppkey", "s_nationkey", "active")
