"""Queries of the encoding and retrieval operators. A document is a chunk of its own here: chunk_id is doc_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import ids
from pagemill.functions.text import tokens
from pagemill.operators import bm25, hybrid
from pagemill.settings import Search
from pagemill.session import durable, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def chunks(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", *more)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


#: DuckDB: tokens, statistics and weights, to build on.
TOK = r"""tok AS (SELECT doc_id AS chunk_id, source, lang, regexp_extract_all(lower(text), '\S+') AS w FROM documents),
qtok AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '\S+') AS w FROM benchmark),
tf AS (SELECT chunk_id, any_value(len) AS len, term, count(*) AS tf FROM (SELECT chunk_id, len(w) AS len, unnest(w) AS term FROM tok) GROUP BY chunk_id, term),
qtf AS (SELECT query_id, any_value(len) AS len, term, count(*) AS tf FROM (SELECT query_id, len(w) AS len, unnest(w) AS term FROM qtok) GROUP BY query_id, term)"""
STATS = """df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
size AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS avgdl FROM tok)"""
WEIGHT = "ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl)))"
SCORED = f"""dw AS (SELECT chunk_id, term, {WEIGHT} AS w FROM tf JOIN df USING (term), size),
qw AS (SELECT query_id, term, {WEIGHT} AS w FROM qtf JOIN df USING (term), size),
scored AS (SELECT query_id, chunk_id, round(sum(dw.w * qw.w), 6) AS score FROM dw JOIN qw USING (term) GROUP BY query_id, chunk_id)"""
RANKED = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored WHERE score <> 0"


@query(r"""SELECT doc_id, len(w)::INT AS n_tokens, len(list_distinct(w))::INT AS n_distinct, w[1] AS first_token, w[-1] AS last_token
FROM (SELECT doc_id, regexp_extract_all(lower(text), '\S+') AS w FROM documents)""")
def tokenize_docs(spark, sf_dir):
    t = F.col("t")
    listed = table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("t"))
    return listed.select(
        "doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"), F.try_element_at(t, F.lit(1)).alias("first_token"), F.try_element_at(t, F.lit(-1)).alias("last_token")
    )


@query(f"WITH {TOK}, {STATS} SELECT term, df FROM df")
def vocabulary_df(spark, sf_dir):
    return bm25.document_frequencies(chunks(spark, sf_dir))


@query(f"""WITH {TOK}, {STATS}, h AS (SELECT term, sha256(term) AS h FROM df)
SELECT term, ('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2])::BIGINT AS term_id FROM h""")
def term_ids(spark, sf_dir):
    return bm25.document_frequencies(chunks(spark, sf_dir)).select("term", ids.term_id(F.col("term")).alias("term_id"))


@query(f"WITH {TOK}, {STATS} SELECT n, round(avgdl, 6) AS avgdl FROM size")
def corpus_stats(spark, sf_dir):
    return bm25.corpus_size(chunks(spark, sf_dir)).select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"""WITH {TOK}, {STATS}, dw AS (SELECT chunk_id, term, round({WEIGHT}, 6) AS w FROM tf JOIN df USING (term), size)
SELECT chunk_id, term, w, rank FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY w DESC, term) AS rank FROM dw) WHERE rank <= 5""")
def bm25_doc_weights(spark, sf_dir):
    own = chunks(spark, sf_dir)
    size, frequencies = bm25.sizes_and_frequencies(own)
    heavy = bm25.heavy_terms(own, "chunk_id", frequencies, size, 5)
    weighted = bm25.weights(heavy, bm25.sendable(frequencies), size).withColumn("w", F.round("w", 6))
    return bm25.top(weighted, 5, ["chunk_id"], F.col("w"), "term").select("chunk_id", "term", "w", "rank")


@query(f"WITH {TOK}, {STATS}, {SCORED} SELECT query_id, chunk_id, score, rank FROM ({RANKED}) WHERE rank <= 20")
def bm25_search(spark, sf_dir):
    return bm25.search(chunks(spark, sf_dir), questions(spark, sf_dir), 20)


@query("""SELECT query_id, chunk_id, score, rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, v.vec_id) AS rank
  FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0) WHERE rank <= 10""")
def dense_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    q = v.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query"))
    return hybrid.dense_topk(v, q, 10)


@query("""SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS norm, len(e)::INT AS dims, sqrt(list_dot_product(e, e)) = 0 AS is_zero
FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""")
def l2_norm_check(spark, sf_dir):
    norm = F.sqrt(hybrid.dot(F.col("embedding"), F.col("embedding")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(norm, 6).alias("norm"), F.size("embedding").alias("dims"), (norm == 0).alias("is_zero"))


EPOCHS = TOK.replace("SELECT doc_id AS chunk_id,", "SELECT doc_id AS chunk_id, substr(source, 4)::INT % 2 AS epoch,").replace("SELECT chunk_id, any_value(len)", "SELECT chunk_id, any_value(epoch) AS epoch, any_value(len)").replace("SELECT chunk_id, len(w)", "SELECT chunk_id, epoch, len(w)")


@query(f"""WITH {EPOCHS}, df AS (SELECT epoch, term, count(*) AS df FROM tf GROUP BY epoch, term),
size AS (SELECT epoch, count(*) AS n, sum(len(w)) / count(*) AS avgdl FROM tok GROUP BY epoch),
dw AS (SELECT epoch, chunk_id, term, {WEIGHT} AS w FROM tf JOIN df USING (epoch, term) JOIN size USING (epoch)),
qw AS (SELECT epoch, query_id, term, {WEIGHT} AS w FROM qtf JOIN df USING (term) JOIN size USING (epoch)),
scored AS (SELECT epoch, query_id, chunk_id, round(sum(dw.w * qw.w), 6) AS score FROM dw JOIN qw USING (epoch, term) GROUP BY ALL)
SELECT epoch, query_id, chunk_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY epoch, query_id ORDER BY score DESC, chunk_id) AS rank FROM scored WHERE score <> 0) WHERE rank <= 10""")
def epoch_sparse_search(spark, sf_dir):
    own = chunks(spark, sf_dir, (F.substring("source", 4, 9).cast("int") % 2).alias("epoch"))
    return bm25.search(own, questions(spark, sf_dir), 10, ["epoch"])


VECTORS = """dense AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
  FROM embeddings v, embeddings q WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
lists AS (SELECT query_id, 'dense' AS side, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dense
  UNION ALL SELECT query_id, 'sparse', chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) FROM scored WHERE score <> 0)"""


def lists(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Ranked dense and sparse lists of every benchmark item; its vector is that of equal id."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    asked = questions(spark, sf_dir)
    q = v.join(asked.select(F.col("query_id").alias("chunk_id")), "chunk_id", "left_semi").select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query"))
    dense = hybrid.dense_topk(v, q, k).select("query_id", F.lit("dense").alias("side"), F.lit("").alias("epoch"), "chunk_id", "rank")
    sparse = bm25.search(chunks(spark, sf_dir), asked, k).select("query_id", F.lit("sparse").alias("side"), F.lit("e0").alias("epoch"), "chunk_id", "rank")
    return dense.unionByName(sparse)


FUSED = """SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf,
  min(rank) FILTER (WHERE side = 'dense') AS dense_rank, min(rank) FILTER (WHERE side = 'sparse') AS sparse_rank
  FROM lists WHERE rank <= {limit} GROUP BY query_id, chunk_id"""


@query(f"""WITH {TOK}, {STATS}, {SCORED}, {VECTORS}, fused AS ({FUSED.format(limit=60)})
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) AS rank FROM fused""")
def rrf_hybrid(spark, sf_dir):
    return hybrid.fuse(lists(spark, sf_dir, 60))


@query(f"""WITH {TOK}, {STATS}, {SCORED} SELECT query_id, chunk_id, score, rank FROM (
  SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM scored JOIN tok USING (chunk_id) WHERE score <> 0 AND lang = 'en') WHERE rank <= 10""")
def search_candidates_filtered(spark, sf_dir):
    """Only English documents may be found; the statistics are of all documents."""
    return bm25.search(chunks(spark, sf_dir, "lang"), questions(spark, sf_dir), 10, only=F.col("lang") == "en")


@query(f"""WITH {TOK}, {STATS}, {SCORED}, hits AS (SELECT query_id, chunk_id, rank, chunk_id - (chunk_id % 7 = 0)::INT AS claimed FROM ({RANKED}) WHERE rank <= 60)
SELECT query_id, chunk_id, rank FROM hits JOIN documents d ON d.doc_id = chunk_id JOIN labels l ON l.doc_id = chunk_id
WHERE l.quality = 1 AND l.toxic = 0 AND claimed = chunk_id""")
def postvalidate_hits(spark, sf_dir):
    hits = bm25.search(chunks(spark, sf_dir), questions(spark, sf_dir), 60)
    # Every seventh chunk's payload names another revision than its row.
    hits = hits.withColumn("rev_id", F.col("chunk_id") - (F.col("chunk_id") % 7 == 0).cast("int")).withColumn("doc_id", F.col("chunk_id"))
    labels = table(spark, sf_dir, "labels")
    revisions = labels.select(F.col("doc_id").alias("rev_id"), "doc_id", (F.col("toxic") == 0).alias("is_active"))
    publications = labels.select(F.col("doc_id").alias("rev_id"), F.when(F.col("quality") == 1, "active").otherwise("superseded").alias("state"))
    rows = chunks(spark, sf_dir).select("chunk_id", F.col("chunk_id").alias("rev_id"))
    return hybrid.validate(hits, rows, revisions, publications).select("query_id", "chunk_id", "rank")


ROUNDS = " UNION ALL ".join(f"SELECT {i} AS round, {n} AS \"limit\", * FROM ({FUSED.format(limit=n)})" for i, n in ((1, 60), (2, 120), (3, 240)))


@query(f"""WITH {TOK}, {STATS}, {SCORED}, {VECTORS}, fused AS ({ROUNDS})
SELECT query_id, round, "limit", chunk_id, rrf, row_number() OVER (PARTITION BY query_id, round ORDER BY rrf DESC, chunk_id) AS rank FROM fused""")
def topup_rounds(spark, sf_dir):
    return hybrid.rounds(lists(spark, sf_dir, 240))


def _selected(spark, sf_dir, settings: Search = Search()):
    # The lists have a bounded number of rows a query and are read by several branches: they are made once.
    durable(spark)
    ranked = hybrid.rounds(lists(spark, sf_dir, 240).checkpoint())
    found = ranked.select("chunk_id").distinct()
    books = table(spark, sf_dir, "documents").join(F.broadcast(found), F.col("doc_id") == F.col("chunk_id"), "left_semi")
    books = books.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), F.size(tokens(F.col("text"))).alias("tokens"))
    labels = table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("chunk_id"))
    # The texts of hits alone are counted, and once.
    valid = ranked.join(labels, "chunk_id", "left_anti").join(books, "chunk_id").checkpoint()
    last = hybrid.chosen_round(valid, ranked, settings)
    return ranked.join(last, ["query_id", "round"]), valid.join(last, ["query_id", "round"])


def _passages(valid: DataFrame) -> DataFrame:
    order = F.row_number().over(hybrid.W.partitionBy("query_id").orderBy("rank"))
    return hybrid.select_passages(valid.withColumn("rank", order))


@query()
def select_passages(spark, sf_dir):
    return _passages(_selected(spark, sf_dir)[1])


@query()
def search_counts(spark, sf_dir):
    """Per query: hits of the last round, valid ones, those reranked and those selected."""
    s = Search()
    ranked, valid = _selected(spark, sf_dir)
    chosen = _passages(valid).groupBy("query_id").agg(F.count("*").alias("selected"), F.sum("tokens").alias("tokens"))
    n = ranked.groupBy("query_id", "limit").agg(F.count("*").alias("candidates"))
    ok = valid.groupBy("query_id").agg(F.count("*").alias("valid"))
    out = n.join(ok, "query_id", "left").join(chosen, "query_id", "left")
    return out.select("query_id", "limit", "candidates", F.coalesce("valid", F.lit(0)).alias("valid"), F.least(F.coalesce("valid", F.lit(0)), F.lit(s.rerank_max)).alias("reranked"), F.coalesce("selected", F.lit(0)).alias("selected"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
