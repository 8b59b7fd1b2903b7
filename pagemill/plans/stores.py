"""Queries of stored structures: folder trees, snapshots and epochs, inverted blocks and vector cells, boxes, removals."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import bm25, catalog, epochs, evidence, pruned, reports, snapshots
from pagemill.plans.documents import PARAGRAPHS
from pagemill.plans.retrieval import ORACLE_SQL as RETRIEVAL
from pagemill.plans.retrieval import chunks, questions
from pagemill.session import durable, forget, table
from pagemill.sources import boxes, tree

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


def _folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    durable(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


@query("SELECT source, sum(strlen(text) + 1)::BIGINT AS bytes FROM documents WHERE source <> 'src3' GROUP BY source")
def folder_tree(spark, sf_dir):
    """Documents written to a folder for each source, and found there again; one folder is ignored and never opened."""
    path = _folder(spark)
    _docs(spark, sf_dir).select(F.coalesce("text", F.lit("")).alias("text"), "source").write.partitionBy("source").text(path)
    where = urlparse(path)
    if where.scheme not in ("", "file"):
        raise ValueError("folders are walked on mounted disks only")
    found = tree.files(spark, [where.path], (".txt",), ("source=src3",))
    sizes = found.groupBy(F.regexp_extract("path", "/source=([^/]*)/", 1).alias("source")).agg(F.sum("size").alias("bytes")).checkpoint()
    forget(spark, path)
    return sizes


REVISIONS = "c AS (SELECT doc_id, source, doc_id // 20 % 2 AS edition, text FROM documents), live AS (SELECT * FROM c WHERE edition = CASE WHEN substr(source, 4)::INT % 3 = 0 THEN 1 ELSE 0 END)"


def _editions(spark, sf_dir) -> tuple[snapshots.Store, DataFrame, str]:
    """A store in which every source was published once, and every third one again by its second edition."""
    path = _folder(spark)
    half = F.floor(F.col("doc_id") / 20) % 2
    rev = F.concat_ws("-", "source", half.cast("string"))
    own = _docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), half.alias("edition"), rev.alias("rev_id"), F.col("source").alias("doc_id"), "text")
    store = snapshots.Store(spark, path)
    for edition, which in ((0, F.lit(True)), (1, F.substring("doc_id", 4, 9).cast("int") % 3 == 0)):
        wave = own.filter((F.col("edition") == edition) & which)
        pub = F.concat(F.lit("p-"), "rev_id").alias("pub_id")
        epochs.publish(store, wave.select(pub, "rev_id", "doc_id").distinct(), wave.select(pub, "doc_id", F.col("chunk_id").cast("string").alias("point_id")), own.select("chunk_id", "rev_id", "text"))
    return store, own, path


@query(rf"WITH {REVISIONS} SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '\S+'))) AS term FROM live) GROUP BY term")
def epoch_terms(spark, sf_dir):
    """Document frequencies of the present epoch, kept through publications that supersede others."""
    store, _, path = _editions(spark, sf_dir)
    terms = epochs.statistics(store)[0].checkpoint()
    forget(spark, path)
    return terms


@query(rf"""WITH {REVISIONS}, s AS (SELECT count(*) AS n, sum(len(regexp_extract_all(lower(text), '\S+')))::BIGINT AS total FROM live)
SELECT n, total, round(total / n, 6) AS avgdl FROM s""")
def epoch_record(spark, sf_dir):
    """The record that was committed with the last switch."""
    store, _, path = _editions(spark, sf_dir)
    record = store.record()
    forget(spark, path)
    return spark.createDataFrame([(record["n"], record["total"], round(record["avgdl"], 6))], "n long, total long, avgdl double")


@query(f"""WITH {REVISIONS}, p AS (SELECT source, edition, count(*) AS points FROM c WHERE edition = 0 OR substr(source, 4)::INT % 3 = 0 GROUP BY source, edition)
SELECT 'p-' || source || '-' || edition AS pub_id, CASE WHEN edition = CASE WHEN substr(source, 4)::INT % 3 = 0 THEN 1 ELSE 0 END THEN 'active' ELSE 'superseded' END AS state,
  points, CASE WHEN edition = CASE WHEN substr(source, 4)::INT % 3 = 0 THEN 1 ELSE 0 END THEN points ELSE 0 END AS active FROM p""")
def snapshot_points(spark, sf_dir):
    """Publications and their points, as one snapshot shows both."""
    store, _, path = _editions(spark, sf_dir)
    points = store.read(epochs.POINTS).groupBy("pub_id").agg(F.count("*").alias("points"), F.count_if("active").alias("active"))
    out = store.read(epochs.PUBLICATIONS).select("pub_id", "state").join(points, "pub_id").select("pub_id", "state", "points", "active").checkpoint()
    forget(spark, path)
    return out


def _inverted(spark, sf_dir, avgdl: float) -> tuple[DataFrame, str]:
    """Stored inverted blocks of all documents."""
    path = _folder(spark)
    # Blocks of like texts, by language and length, have closer bounds.
    own = chunks(spark, sf_dir, "lang", "n_chars")
    pruned.inverted(own, ["lang", "n_chars", "chunk_id"], avgdl=avgdl).write.parquet(path)
    return spark.read.parquet(path), path


@query(RETRIEVAL["bm25_search"])
def block_max_search(spark, sf_dir):
    """The hits of bm25_search, from a stored index of which most postings are never read."""
    asked = questions(spark, sf_dir)
    n, avgdl, df = bm25.asked_statistics(chunks(spark, sf_dir), asked)
    index, path = _inverted(spark, sf_dir, avgdl)
    hits = pruned.search(index, df, n, avgdl, asked, 20)[0].checkpoint()
    forget(spark, path)
    return hits


@query(RETRIEVAL["dense_topk"])
def cell_topk(spark, sf_dir):
    """The hits of dense_topk, from stored cells of which some are never scored."""
    path = _folder(spark)
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    pruned.cells(v).write.parquet(path)
    asked = v.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query"))
    hits = pruned.dense(spark.read.parquet(path), asked, 10)[0].checkpoint()
    forget(spark, path)
    return hits


WORD_BOXES = """w AS (SELECT doc_id, i, word, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
  FROM (SELECT doc_id, unnest(parts) AS word, generate_subscripts(parts, 1) AS i FROM (SELECT doc_id, string_split(text, ' ') AS parts FROM documents)))"""


def _word_boxes(spark, sf_dir) -> DataFrame:
    """(unit_id, r_start, r_end, box): the words of each document, set in lines of a thousand characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                size = np.array([len(w) for w in text.split(" ")] if text else [], np.int64)
                start, full = np.cumsum(size + 1) - size - 1, size > 0
                yield pa.RecordBatch.from_arrays([pa.repeat(unit, int(full.sum())), pa.array(start[full]), pa.array(size[full])], ["unit_id", "r_start", "size"])

    d = _docs(spark, sf_dir).select("doc_id", "text")
    placed = d.mapInArrow(run, f"unit_id {d.schema['doc_id'].dataType.simpleString()}, r_start long, size long")
    number = lambda c: c.cast("double")
    box = F.array(number(F.col("r_start") % 1000), number(F.floor(F.col("r_start") / 1000)), number(F.col("size")), F.lit(1.0))
    return placed.select("unit_id", "r_start", (F.col("r_start") + F.col("size")).alias("r_end"), box.alias("box"))


def _spans(spark, sf_dir) -> DataFrame:
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.length("text") - 1, F.lit(0)).cast("long"), F.lit(700).cast("long"))).alias("start")
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("unit_id"), at).withColumn("end", F.col("start") + 450)


@query(f"""WITH {WORD_BOXES}, s AS (SELECT doc_id, unnest(generate_series(0, greatest(length(text) - 1, 0), 700)) AS s FROM documents),
m AS (SELECT s.doc_id, s, min(a % 1000) AS x0, min(a // 1000) AS y0, max(a % 1000 + length(word)) AS x1, max(a // 1000 + 1) AS y1 FROM s JOIN w ON s.doc_id = w.doc_id AND word <> '' AND a < s + 450 AND s < a + length(word) GROUP BY 1, 2)
SELECT s.doc_id AS unit_id, s.s AS start, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM s LEFT JOIN m ON s.doc_id = m.doc_id AND s.s = m.s""")
def span_boxes(spark, sf_dir):
    """The united boxes of the words under spans of every document."""
    b = evidence.span_boxes(_spans(spark, sf_dir), _word_boxes(spark, sf_dir))
    return b.select("unit_id", "start", *(F.col("bbox")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))))


@query(f"""WITH {PARAGRAPHS}, u AS (SELECT doc_id, length(text) // 2 AS half, doc_id % 2 = 0 AS section, 'part ' || lang AS title, source FROM documents),
b AS (SELECT u.doc_id, any_value(half) AS half, any_value(section) AS section, any_value(title) AS title, any_value(source) AS source, min(position) FILTER (WHERE half >= s AND half < s + n) AS position FROM u LEFT JOIN bounds ON u.doc_id = unit_id GROUP BY u.doc_id)
SELECT b.doc_id AS query_id, CASE WHEN b.section THEN 'section' ELSE 'page' END AS kind, CASE WHEN b.section AND position IS NOT NULL THEN 'a' || lpad(position::VARCHAR, 4, '0') END AS anchor, CASE WHEN b.section THEN b.title END AS section,
  CASE WHEN NOT b.section THEN CASE WHEN next.doc_id IS NULL OR next.section OR next.doc_id % 100 = b.doc_id % 100 THEN (b.doc_id % 100 + 1)::VARCHAR ELSE '' END END AS pages,
  array_to_string(list_filter([CASE WHEN b.section THEN '-' ELSE (b.doc_id % 100 + 1)::VARCHAR END || ':' || (half % 1000)::VARCHAR || ':' || (half // 1000)::VARCHAR, CASE WHEN next.doc_id IS NOT NULL THEN CASE WHEN next.section THEN '-' ELSE (next.doc_id % 100 + 1)::VARCHAR END || ':1:2' END], lambda x: x IS NOT NULL), ',') AS boxes
FROM b LEFT JOIN (SELECT doc_id, section FROM u) AS next ON next.doc_id = b.doc_id + 2""")
def manifest_locations(spark, sf_dir):
    """Where evidence stands: sections with the anchor of their paragraph and title, pages with boxes."""
    d = _docs(spark, sf_dir)
    half = F.floor(F.length("text") / 2)
    at = lambda k, x, y: F.struct((F.col("doc_id") + k).alias("unit_id"), half.alias("source_start"), F.array(*(v.cast("double") for v in (x, y, x + 9, y + 1))).alias("bbox"))
    spans = F.array(at(0, half % 1000, F.floor(half / 1000)), at(2, F.lit(1), F.lit(2)))
    passages = d.select(F.col("doc_id").alias("query_id"), F.lit(1).alias("place"), F.col("doc_id").alias("chunk_id"), F.col("lang").alias("rev_id"), spans.alias("spans"))
    kind = F.when(F.col("doc_id") % 2 == 0, "section").otherwise("page")
    units = d.select(F.col("doc_id").alias("unit_id"), kind.alias("kind"), (F.col("doc_id") % 100).alias("position"), F.col("source").alias("ref"), F.array().cast("array<string>").alias("flags"), F.when(kind == "section", F.concat(F.lit("part "), "lang")).alias("section"))
    paragraphs = d.select(F.col("doc_id").alias("unit_id"), F.posexplode(F.split("text", "\n")).alias("position", "text")).withColumn("anchor", F.format_string("a%04d", "position"))
    m = evidence.manifest(passages, units, d.select(F.col("lang").alias("rev_id")).distinct().withColumn("title", F.col("rev_id")), paragraphs)
    number = lambda c: c.cast("long").cast("string")
    listed = F.array_join(F.transform("boxes", lambda b: F.concat_ws(":", F.coalesce(number(b["page"]), F.lit("-")), number(b["bbox"][0]), number(b["bbox"][1]))), ",")
    one = F.when(F.size("pages") == 1, F.col("pages")[0].cast("string")).when(F.col("pages").isNotNull(), "")
    return m.select("query_id", "kind", "anchor", "section", one.alias("pages"), listed.alias("boxes"))


PAGE = """p AS (SELECT doc_id, 200 + n_chars % 700 AS w, 300 + n_chars % 400 AS h, doc_id % 4 AS turn, n_chars % 100 AS x, n_chars % 150 AS y FROM documents),
q AS (SELECT *, CASE WHEN turn % 2 = 0 THEN w ELSE h END - 30 AS cw, CASE WHEN turn % 2 = 0 THEN h ELSE w END - 50 AS ch FROM p),
s AS (SELECT *, CASE WHEN greatest(cw, ch) * 300 / 72.0 > 1500 THEN 1500::DOUBLE / greatest(cw, ch) ELSE 300::DOUBLE / 72 END AS k FROM q),
r AS (SELECT *, CASE turn WHEN 0 THEN x WHEN 1 THEN h - y - 20 WHEN 2 THEN w - x - 40 ELSE y END - 10 AS rx, CASE turn WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN h - y - 20 ELSE w - x - 40 END - 20 AS ry,
  CASE WHEN turn % 2 = 0 THEN 40 ELSE 20 END AS rw, CASE WHEN turn % 2 = 0 THEN 20 ELSE 40 END AS rh FROM s)"""


@query(f"""WITH {PAGE} SELECT doc_id, round(rx * k, 3) AS rx, round(ry * k, 3) AS ry, round(rw * k, 3) AS rw, round(rh * k, 3) AS rh, x::DOUBLE AS x, y::DOUBLE AS y, 40.0::DOUBLE AS w, 20.0::DOUBLE AS h,
  CASE WHEN greatest(cw, ch) * 300 / 72.0 > 1500 THEN CASE WHEN cw >= ch THEN 1500 ELSE ceil(cw * 1500::DOUBLE / ch) END ELSE ceil(cw * 300 / 72.0::DOUBLE) END::BIGINT AS render_w FROM r""")
def box_transforms(spark, sf_dir):
    """Boxes of rotated and cropped pages on their rasters, and back."""
    w, h, turn = 200 + F.col("n_chars") % 700, 300 + F.col("n_chars") % 400, (F.col("doc_id") % 4).cast("int")
    odd = turn % 2 == 1
    crop = F.array(F.lit(10.0), F.lit(20.0), (F.when(odd, h).otherwise(w) - 30).cast("double"), (F.when(odd, w).otherwise(h) - 50).cast("double"))
    box = F.array((F.col("n_chars") % 100).cast("double"), (F.col("n_chars") % 150).cast("double"), F.lit(40.0), F.lit(20.0))
    made = _docs(spark, sf_dir).select("doc_id", box.alias("box"), crop.alias("crop"), boxes.page_to_raster(w, h, turn * 90, crop, 300, 1500).alias("m"))
    raster = boxes.apply(F.col("m"), F.col("box")).alias("r")
    back = boxes.apply(boxes.inverse(F.col("m")), boxes.apply(F.col("m"), F.col("box"), 9), 3).alias("b")
    shown = made.select("doc_id", raster, back, boxes.raster(F.col("crop")[2], F.col("crop")[3], 300, 1500)["render_w"].alias("render_w"))
    return shown.select("doc_id", *(F.col("r")[i].alias(n) for i, n in enumerate(("rx", "ry", "rw", "rh"))), *(F.col("b")[i].alias(n) for i, n in enumerate("xywh")), "render_w")


@query("""SELECT source AS run, count(*) AS n, sum(CASE WHEN source IN ('src1', 'src2') THEN strlen(text) + 1 ELSE strlen(text) END)::BIGINT AS bytes FROM documents WHERE source NOT IN ('src1', 'src2') OR doc_id // 20 % 2 = 0 GROUP BY source""")
def rewrite_runs(spark, sf_dir):
    """Two runs written anew, twice, in a stored table of all; the others' files stay."""
    path = _folder(spark)
    d = _docs(spark, sf_dir).select("doc_id", F.col("source").alias("run"), "text")
    catalog.write_runs(d, path, "run")
    anew = d.filter("run IN ('src1', 'src2') AND floor(doc_id / 20) % 2 = 0").withColumn("text", F.concat("text", F.lit("!")))
    for _ in range(2):
        catalog.write_runs(anew, path, "run")
    out = spark.read.parquet(path).groupBy("run").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).checkpoint()
    forget(spark, path)
    return out


RELATIONS: list[catalog.Relation] = [
    ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
]


@query("""WITH n AS (SELECT n_nationkey, n_nationkey = 7 AS gone FROM nation), c AS (SELECT c_custkey, coalesce(gone, FALSE) AS gone FROM customer LEFT JOIN n ON c_nationkey = n_nationkey), s AS (SELECT s_suppkey, coalesce(gone, FALSE) AS gone FROM supplier LEFT JOIN n ON s_nationkey = n_nationkey),
o AS (SELECT o_orderkey, coalesce(gone, FALSE) AS gone FROM orders LEFT JOIN c ON o_custkey = c_custkey), l AS (SELECT coalesce(o.gone, FALSE) OR coalesce(s.gone, FALSE) AS gone FROM lineitem LEFT JOIN o ON l_orderkey = o_orderkey LEFT JOIN s ON l_suppkey = s_suppkey)
SELECT *, 0::BIGINT AS dangling FROM (SELECT 1 AS place, 'lineitem' AS name, count_if(gone) AS removed, count_if(NOT gone) AS kept FROM l UNION ALL SELECT 2, 'orders', count_if(gone), count_if(NOT gone) FROM o UNION ALL SELECT 3, 'customer', count_if(gone), count_if(NOT gone) FROM c
UNION ALL SELECT 4, 'supplier', count_if(gone), count_if(NOT gone) FROM s UNION ALL SELECT 5, 'nation', count_if(gone), count_if(NOT gone) FROM n)""")
def removal_cascade(spark, sf_dir):
    """One nation and all that depends on it, through both ways to a line; nothing that stays refers to what goes."""
    tables = {t: table(spark, sf_dir, t) for t in ("nation", "customer", "supplier", "orders", "lineitem")}
    return catalog.removal_report(tables, RELATIONS, "nation", F.col("n_nationkey") == 7)


_POISSON = [repr(p) for p in reports._AT_MOST]


@query(f"""WITH e AS (SELECT event_type, value::DOUBLE AS v, event_id FROM events WHERE value IS NOT NULL), b AS (SELECT *, md5('42|' || event_id || '|' || block) AS h FROM e, unnest(generate_series(0, 49)) AS t(block)),
u AS (SELECT event_type, v, block * 4 + i AS rep, ('0x' || substr(h, 8 * i + 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM b, unnest(generate_series(0, 3)) AS s(i)),
w AS (SELECT event_type, rep, v, len(list_filter([{', '.join(_POISSON)}], lambda p: u >= p)) AS w FROM u), m AS (SELECT event_type, rep, sum(w * v) / sum(w) AS mean FROM w GROUP BY 1, 2),
q AS (SELECT event_type, list_sort(list(mean)) AS l FROM m GROUP BY 1)
SELECT event_type, n, round(mean, 6) AS mean, CASE WHEN n >= 5 THEN round(l[6], 6) END AS low, CASE WHEN n >= 5 THEN round(l[196], 6) END AS high FROM (SELECT event_type, count(*) AS n, avg(v) AS mean FROM e GROUP BY 1) JOIN q USING (event_type)""")
def bootstrap_means(spark, sf_dir):
    """Means of events' values with their intervals by resampling, in one aggregation."""
    return reports.bootstrap(table(spark, sf_dir, "events"), ["event_type"], "value", "event_id")
