"""DuckDB SQL of whole searches, written from the rules: lists, rounds, validation, the round that is taken, the selection."""

from pagemill.plans.retrieval import SCORED, STATS, TOK, VECTORS, WEIGHT

#: The library of a search: a book a source, two epochs, and what publications and labels leave visible.
LIBRARY = r"""lib AS (SELECT doc_id AS chunk_id, source AS book, substr(source, 4)::INT % 2 AS epoch, regexp_extract_all(lower(text), '\S+') AS w FROM documents),
vis AS (SELECT * FROM lib WHERE chunk_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
qtok AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '\S+') AS w FROM benchmark),
tf AS (SELECT epoch, chunk_id, any_value(len) AS len, term, count(*) AS tf FROM (SELECT epoch, chunk_id, len(w) AS len, unnest(w) AS term FROM vis) GROUP BY epoch, chunk_id, term),
qtf AS (SELECT query_id, any_value(len) AS len, term, count(*) AS tf FROM (SELECT query_id, len(w) AS len, unnest(w) AS term FROM qtok) GROUP BY query_id, term),
df AS (SELECT epoch, term, count(*) AS df FROM tf GROUP BY epoch, term), size AS (SELECT epoch, count(*) AS n, sum(len(w)) / count(*) AS avgdl FROM vis GROUP BY epoch),
""" + f"""dw AS (SELECT epoch, chunk_id, term, {WEIGHT} AS w FROM tf JOIN df USING (epoch, term) JOIN size USING (epoch)),
qw AS (SELECT epoch, query_id, term, {WEIGHT} AS w FROM qtf JOIN df USING (term) JOIN size USING (epoch)),
scored AS (SELECT epoch, query_id, chunk_id, round(sum(dw.w * qw.w), 6) AS score FROM dw JOIN qw USING (epoch, term) GROUP BY ALL)"""


def library(dense: bool, only: str = "TRUE") -> str:
    """lists, valid (whether a chunk may be returned) and asked, for searches over the library."""
    sparse = f"SELECT query_id, 'sparse' AS side, chunk_id, row_number() OVER (PARTITION BY epoch, query_id ORDER BY score DESC, chunk_id) AS rank FROM scored JOIN lib USING (chunk_id, epoch) WHERE score <> 0 AND {only}"
    vectors = f"""SELECT query_id, 'dense', chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) FROM (
  SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings v JOIN vis ON v.vec_id = chunk_id AND {only}, embeddings q WHERE q.vec_id IN (SELECT item_id FROM benchmark))"""
    asked = "SELECT item_id AS query_id FROM benchmark" + (" WHERE item_id IN (SELECT vec_id FROM embeddings)" if dense else "")
    every = f"{sparse} UNION ALL {vectors}" if dense else sparse
    return f"""{LIBRARY}, asked AS ({asked}), lists AS (SELECT * FROM ({every}) WHERE rank <= 240 AND query_id IN (SELECT query_id FROM asked)),
sound AS (SELECT chunk_id, book, len(w) AS tokens FROM vis LEFT JOIN labels ON doc_id = chunk_id WHERE coalesce(toxic = 0, TRUE))"""


#: The lists of the plain queries, without publications; chunks of labelled quality 0 may not be returned.
PLAIN = f"""{TOK}, {STATS}, {SCORED}, {VECTORS.replace('lists AS', 'ranked AS')}, lists AS (SELECT * FROM ranked WHERE rank <= 240), asked AS (SELECT DISTINCT query_id FROM lists),
sound AS (SELECT chunk_id, source AS book, len(w) AS tokens FROM tok WHERE chunk_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0))"""

ROUNDS = """steps AS (SELECT * FROM (VALUES (1, 60), (2, 120), (3, 240)) AS t(round, lim)),
fused AS (SELECT query_id, round, lim, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf FROM lists JOIN steps ON rank <= lim GROUP BY ALL),
every AS (SELECT *, row_number() OVER (PARTITION BY query_id, round ORDER BY rrf DESC, chunk_id) AS rank FROM fused),
met AS (SELECT query_id, round, any_value(lim) AS lim, count(*) AS n, count_if(chunk_id IN (SELECT chunk_id FROM sound)) AS ok FROM every GROUP BY query_id, round),
stops AS (SELECT *, lag(n) OVER (PARTITION BY query_id ORDER BY round) AS before FROM met),
last AS (SELECT query_id, min(round) AS round FROM stops WHERE ok >= 8 OR lim >= 240 OR round >= 3 OR n = before GROUP BY query_id),
kept AS (SELECT query_id, chunk_id, book, tokens, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM every JOIN last USING (query_id, round) JOIN sound USING (chunk_id))"""


def selection(per_book: int | None = 4) -> str:
    """chosen (query_id, chunk_id, doc_id, tokens, place): one hit after another, by budget, room and book."""
    crowded = f"len(list_filter(g.books, lambda b: b = i.book)) >= {per_book}" if per_book else "FALSE"
    fits = "g.used + i.tokens <= 6000 AND len(g.taken) < 12"
    return f"""items AS (SELECT * FROM kept WHERE place <= 80),
g AS (SELECT DISTINCT query_id, 0::BIGINT AS place, []::BIGINT[] AS taken, []::VARCHAR[] AS books, []::BIGINT[] AS later, 0::BIGINT AS used FROM items
  UNION ALL SELECT g.query_id, i.place, CASE WHEN {fits} AND NOT ({crowded}) THEN list_append(g.taken, i.place) ELSE g.taken END, CASE WHEN {fits} AND NOT ({crowded}) THEN list_append(g.books, i.book) ELSE g.books END,
  CASE WHEN {fits} AND ({crowded}) THEN list_append(g.later, i.place) ELSE g.later END, CASE WHEN {fits} AND NOT ({crowded}) THEN g.used + i.tokens ELSE g.used END FROM g JOIN items i ON i.query_id = g.query_id AND i.place = g.place + 1),
scanned AS (SELECT query_id, arg_max(taken, place) AS taken, arg_max(later, place) AS later, arg_max(used, place) AS used FROM g GROUP BY query_id),
h AS (SELECT query_id, 0::BIGINT AS k, taken, later, used FROM scanned
  UNION ALL SELECT h.query_id, h.k + 1, CASE WHEN len(h.taken) < 8 AND h.used + i.tokens <= 6000 THEN list_append(h.taken, i.place) ELSE h.taken END, h.later, CASE WHEN len(h.taken) < 8 AND h.used + i.tokens <= 6000 THEN h.used + i.tokens ELSE h.used END
  FROM h JOIN items i ON i.query_id = h.query_id AND i.place = h.later[h.k + 1]),
ended AS (SELECT query_id, arg_max(taken, k) AS taken FROM h GROUP BY query_id),
chosen AS (SELECT e.query_id, i.chunk_id, i.book AS doc_id, i.tokens, e.place FROM (SELECT query_id, unnest(taken) AS item, generate_subscripts(taken, 1) AS place FROM ended) e JOIN items i ON i.query_id = e.query_id AND i.place = e.item)"""


def report(dense: bool) -> str:
    """Counts of every question's search."""
    reason = "NULL::VARCHAR" if dense else "'embedding model not configured; sparse-only search'"
    return f"""WITH RECURSIVE {library(dense)}, {ROUNDS}, {selection()},
sides AS (SELECT query_id, count_if(side = 'dense') AS dense, count_if(side = 'sparse') AS sparse FROM lists JOIN last USING (query_id) JOIN steps USING (round) WHERE rank <= lim GROUP BY query_id)
SELECT a.query_id, coalesce(dense, 0) AS dense, coalesce(sparse, 0) AS sparse, coalesce(n, 0) AS fused, coalesce(ok, 0) AS validated, coalesce(n - ok, 0) AS postvalidation_removed, least(coalesce(ok, 0), 80) AS reranked,
  coalesce(c.selected, 0) AS selected, coalesce(last.round - 1, 0)::INT AS topup_rounds, {str(not dense).upper()} AS degraded, {reason} AS degraded_reason
FROM asked a LEFT JOIN last USING (query_id) LEFT JOIN met ON met.query_id = a.query_id AND met.round = last.round LEFT JOIN sides ON sides.query_id = a.query_id LEFT JOIN (SELECT query_id, count(*) AS selected FROM chosen GROUP BY query_id) c ON c.query_id = a.query_id"""


BOOK = "book = 'src1'"
SELECT = "SELECT query_id, chunk_id, doc_id, tokens, place FROM chosen"
SQL = {
    "select_passages": f"WITH RECURSIVE {PLAIN}, {ROUNDS}, {selection()} {SELECT}",
    "search_counts": f"""WITH RECURSIVE {PLAIN}, {ROUNDS}, {selection()}, c AS (SELECT query_id, count(*) AS selected, sum(tokens) AS tokens FROM chosen GROUP BY query_id)
SELECT query_id, lim AS "limit", n AS candidates, ok AS valid, least(ok, 80) AS reranked, coalesce(selected, 0) AS selected, coalesce(tokens, 0)::BIGINT AS tokens FROM last JOIN met USING (query_id, round) LEFT JOIN c USING (query_id)""",
    "search_passages": f"WITH RECURSIVE {library(True)}, {ROUNDS}, {selection()} {SELECT}",
    "search_one_book": f"WITH RECURSIVE {library(False, BOOK)}, {ROUNDS}, {selection(None)} {SELECT}",
    "search_report": report(True),
    "search_degraded": report(False),
}
