"""Queries of the text, page, chunk, language, sampling and evidence operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import embed, evidence, pages, sampling
from pagemill.session import table
from pagemill.settings import Chunking
from pagemill.sources import files, markup

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


def _pages(spark, sf_dir) -> DataFrame:
    """A source is a book, its documents are the pages."""
    return _docs(spark, sf_dir).select(F.col("source").alias("book"), F.col("doc_id").alias("position"), "text")


FLAGS = """f AS (SELECT doc_id, list_filter([
  CASE WHEN length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) = 0 THEN 'no_text' END,
  CASE WHEN length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) BETWEEN 1 AND 39 THEN 'sparse' END,
  CASE WHEN length(text) > 0 AND length(text) - length(replace(text, chr(65533), '')) > 0.05 * length(text) THEN 'many_replacement' END], lambda x: x IS NOT NULL) AS flags,
  (doc_id % 4) / 3.0 AS ratio FROM documents)"""


@query(f"WITH {FLAGS} SELECT doc_id, array_to_string(flags, ',') AS flags FROM f")
def quality_flags(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.quality_flags(F.col("text")), ",").alias("flags"))


@query(f"""WITH {FLAGS} SELECT doc_id, CASE WHEN list_contains(flags, 'many_replacement') THEN 'ocr'
  WHEN len(flags) > 0 THEN CASE WHEN ratio >= 0.5 THEN 'ocr' ELSE 'skip' END ELSE 'reuse' END AS route FROM f""")
def ocr_route(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.ocr_route(T.quality_flags(F.col("text")), (F.col("doc_id") % 4) / 3.0).alias("route"))


EDGES = r"""e AS (SELECT source, trim(split_part(text, chr(10), 1), ' ' || chr(9)) AS first, trim(split_part(regexp_replace(text, chr(10) || '$', ''), chr(10), -1), ' ' || chr(9)) AS last FROM documents),
lines AS (SELECT source AS book, 'header' AS kind, first AS line FROM e UNION ALL SELECT source, 'footer', last FROM e)"""


@query(f"WITH {EDGES} SELECT book, kind, line, count(*) AS n FROM lines WHERE length(line) BETWEEN 3 AND 80 GROUP BY ALL HAVING count(*) >= 2")
def header_footer_lines(spark, sf_dir):
    return pages.running_lines(_pages(spark, sf_dir))


@query()
def normalize_text(spark, sf_dir):
    done = pages.normalized(pages.removed_ranges(_pages(spark, sf_dir)))
    n = F.aggregate("runs", F.lit(0), lambda acc, r: acc + r["n"])
    return done.select("book", "position", F.sha2("searchable", 256).alias("sha256"), F.length("searchable").alias("n_chars"), n.alias("n_spans"))


def _chunks(spark, sf_dir) -> DataFrame:
    done = pages.normalized(pages.removed_ranges(_pages(spark, sf_dir)))
    return pages.chunked(done.withColumn("title", F.lit(None).cast("string")), Chunking(256, 40))


@query()
def chunk_documents(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    return c.select("book", "position", "chunk_id", "token_count", F.sha2("text", 256).alias("text_sha256"), F.size("spans").alias("n_units"))


@query()
def chunk_links(spark, sf_dir):
    return pages.linked(_chunks(spark, sf_dir).select("book", "position", "chunk_id"))


STRIDES = r"""t AS (SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS n FROM documents),
c AS (SELECT doc_id, n, CASE WHEN n <= 256 THEN 1 ELSE ceil((n - 256) / 216.0)::INT + 1 END AS k FROM t WHERE n > 0),
s AS (SELECT doc_id, p::INT AS position, p * 216 AS first, least(256, n - p * 216) AS n FROM (SELECT *, unnest(generate_series(0, k - 1)) AS p FROM c))"""


@query(f"WITH {STRIDES} SELECT doc_id, position, first::INT AS first, n::INT AS n FROM s")
def stride_chunks(spark, sf_dir):
    n = _docs(spark, sf_dir).select("doc_id", F.size(T.tokens(F.col("text"))).alias("n_tokens"))
    return pages.strides(n, 256, 40)


@query(f"WITH {STRIDES} SELECT doc_id, count(*) AS chunks, sum(n)::BIGINT AS tokens, min(n)::INT AS least, max(n)::INT AS most, round(avg(n), 6) AS mean FROM s GROUP BY doc_id")
def chunk_stats(spark, sf_dir):
    return stride_chunks(spark, sf_dir).groupBy("doc_id").agg(
        F.count("*").alias("chunks"), F.sum("n").alias("tokens"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean")
    )


def _xhtml(spark, sf_dir) -> DataFrame:
    """(page_id, html): every document as XHTML with things to be cut out; every tenth isn't well-formed."""
    d = _docs(spark, sf_dir)
    safe = F.col("text")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(char), F.lit(entity))
    paragraphs = F.array_join(F.transform(F.split(safe, "\n"), lambda t, i: F.concat(F.lit('<p id="p" onclick="x()">'), t, F.lit("</p><script>var y;</script>"))), "")
    end = F.when(F.col("doc_id") % 10 == 9, F.lit("</div>")).otherwise(F.lit(""))
    html = F.concat(F.lit('<html xmlns="http://www.w3.org/1999/xhtml"><head><title>t</title><style>p</style></head><body><h1>Book <em>'), "source", F.lit("</em></h1>"), paragraphs, F.lit("<ul><li>last</li></ul>"), end, F.lit("</body></html>"))
    return d.select(F.col("doc_id").alias("page_id"), html.alias("html"))


@query(r"""WITH d AS (SELECT doc_id, source, doc_id % 10 = 9 OR regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]') AS bad,
  list_concat(['Book ' || source], list_filter(list_transform(string_split(replace(text, chr(13), chr(10)), chr(10)), lambda t: trim(t, ' ' || chr(9) || chr(160))), lambda t: t <> ''), ['last']) AS p FROM documents)
SELECT doc_id AS page_id, CASE WHEN NOT bad THEN 'Book ' || source END AS title, CASE WHEN bad THEN 'bad_html' ELSE '' END AS flags, CASE WHEN bad THEN 0 ELSE len(p) END::INT AS n_paragraphs,
  CASE WHEN bad THEN 0 ELSE length(array_to_string(p, '')) END::INT AS char_count, CASE WHEN NOT bad THEN 'a' || lpad((len(p) - 1)::VARCHAR, 4, '0') END AS last_anchor, sha256(CASE WHEN bad THEN '' ELSE array_to_string(p, '|') END) AS paragraphs_sha256 FROM d""")
def page_paragraphs(spark, sf_dir):
    s = markup.sections(_xhtml(spark, sf_dir))
    joined = F.array_join(F.transform("paragraphs", lambda p: p["text"]), "|")
    return s.select(
        "page_id", "title", F.array_join("flags", ",").alias("flags"), F.size("paragraphs").alias("n_paragraphs"), "char_count", F.try_element_at("paragraphs", F.lit(-1))["anchor"].alias("last_anchor"), F.sha2(joined, 256).alias("paragraphs_sha256")
    )


@query()
def page_texts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length(markup.lenient_text(F.col("html"))).alias("n_chars"))


def _language_sql() -> str:
    head = "substr(coalesce(text, ''), 1, 4000)"
    scripts = {k: f"length(regexp_replace({head}, '[^{v}]', '', 'g'))" for k, v in T.SCRIPTS.items()}
    words = f"list_distinct(regexp_extract_all(lower({head}), '{T.WORDS}'))"
    stop = {k: f"len(list_intersect(w, {v}))" for k, v in T.STOPWORDS.items()}
    pick = lambda scores, none: "CASE WHEN greatest(" + ", ".join(scores) + f") = 0 THEN '{none}' " + " ".join(f"WHEN {k} = greatest(" + ", ".join(scores) + f") THEN '{k.removeprefix('l_')}'" for k in sorted(scores)) + " END"
    inner = ", ".join(f"{v} AS {k}" for k, v in scripts.items())
    counted = ", ".join(f"{v} AS l_{k}" for k, v in stop.items())
    return f"""a AS (SELECT doc_id, lang, {words} AS w, {inner} FROM documents),
b AS (SELECT doc_id, lang, {pick(dict(scripts), 'unknown')} AS script, {counted} FROM a),
d AS (SELECT doc_id, lang, CASE WHEN script = 'lat' THEN {pick({f'l_{k}': v for k, v in stop.items()}, 'other')} ELSE script END AS detected FROM b)"""


@query(f"WITH {_language_sql()} SELECT doc_id, detected FROM d")
def detect_language(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.language(F.col("text")).alias("detected"))


@query(f"WITH {_language_sql()} SELECT lang, detected, count(*) AS n FROM d GROUP BY ALL")
def language_confusion(spark, sf_dir):
    return _docs(spark, sf_dir).select("lang", T.language(F.col("text")).alias("detected")).groupBy("lang", "detected").agg(F.count("*").alias("n"))


HASHED = "h AS (SELECT *, sha256('42:' || doc_id::VARCHAR) AS hash FROM documents)"


@query(f"WITH {HASHED} SELECT doc_id, hash FROM h ORDER BY hash, doc_id LIMIT 40")
def hash_sample(spark, sf_dir):
    return sampling.hash_sample(_docs(spark, sf_dir).select("doc_id"), "doc_id", 40).select("doc_id", "hash")


@query("""WITH d AS (SELECT doc_id, source || '|' || lang AS stratum, ('0x' || substr(sha256('m6pilot:42:' || doc_id::VARCHAR), 1, 4))::INT AS place FROM documents),
s AS (SELECT stratum, count(*) AS size, ('0x' || substr(sha256('m6pilot:42:' || stratum), 1, 4))::INT AS rank FROM d GROUP BY stratum),
t AS (SELECT *, count(*) OVER () AS k, 200 - count(*) OVER () AS rest, sum(size) OVER () AS total FROM s),
i AS (SELECT *, rest * size / total::DOUBLE AS ideal, floor(rest * size / total::DOUBLE) AS whole FROM t),
q AS (SELECT *, rest - sum(whole) OVER () AS remains, row_number() OVER (ORDER BY ideal - whole DESC, rank, stratum) AS by_rest, row_number() OVER (ORDER BY rank, stratum) AS by_place FROM i),
quotas AS (SELECT stratum, least(size, CASE WHEN k > 200 THEN (by_place <= 200)::BIGINT ELSE 1 + whole::BIGINT + (by_rest <= remains)::BIGINT END) AS quota FROM q),
p AS (SELECT doc_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY place, doc_id) AS place FROM d)
SELECT doc_id, stratum, place::INT AS place, quota FROM p JOIN quotas USING (stratum) WHERE place <= quota""")
def stratified_manifest(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.concat_ws("|", "source", "lang").alias("stratum"))
    return sampling.stratified(d, "stratum", "doc_id", 200)


SENTENCES = r"""s AS (SELECT doc_id, hash, i, trim(u, ' ' || chr(9) || chr(13)) AS s FROM (SELECT doc_id, hash, unnest(parts) AS u, generate_subscripts(parts, 1) AS i FROM (SELECT doc_id, hash, string_split(replace(text, chr(10), ' '), '. ') AS parts FROM h))),
best AS (SELECT doc_id, any_value(hash) AS hash, arg_min(s, (-length(s), i)) AS s FROM s WHERE length(s) >= 40 GROUP BY doc_id)"""
CUT = "CASE WHEN length(s) > {n} THEN CASE WHEN contains(substr(s, 1, {n}), ' ') THEN regexp_extract(substr(s, 1, {n}), '(?s)^(.*) ', 1) ELSE substr(s, 1, {n}) END || '...' ELSE s END"


@query(f"WITH {HASHED}, {SENTENCES} SELECT doc_id, {CUT.format(n=300)} AS probe FROM best ORDER BY hash, doc_id LIMIT 10")
def probe_queries(spark, sf_dir):
    probe = _docs(spark, sf_dir).select("doc_id", T.longest_sentence(F.col("text"), 300).alias("probe")).filter("probe is not null")
    return sampling.hash_sample(probe, "doc_id", 10).select("doc_id", "probe")


@query(rf"""WITH {HASHED.replace('FROM documents)', 'FROM documents ORDER BY hash, doc_id LIMIT 40)')}, {SENTENCES},
w AS (SELECT doc_id, i, t FROM (SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '\S+') AS ts FROM h)) WHERE length(t) > 5 AND regexp_full_match(t, '\p{{L}}+')),
terms AS (SELECT doc_id, arg_min(t, (-length(t), i)) AS term FROM w GROUP BY doc_id)
SELECT doc_id, 'exact_term' AS category, term AS text FROM terms UNION ALL SELECT doc_id, 'conceptual', {CUT.format(n=200)} FROM best""")
def suggest_candidates(spark, sf_dir):
    sample = sampling.hash_sample(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id", 40)
    both = F.array(
        F.struct(F.lit("exact_term").alias("category"), T.longest_term(F.col("text")).alias("text")), F.struct(F.lit("conceptual").alias("category"), T.longest_sentence(F.col("text"), 200).alias("text"))
    )
    return sample.select("doc_id", F.inline(both)).filter("text is not null")


#: Answers: assistant turns, and literal ones that cite.
ANSWERS = [
    (-1, "It was dawn [E1]. Then noon [E2][E1]."), (-2, "Night fell [E7]."), (-3, "Nobody says."), (-4, "abstain\nNo passage speaks of it.\n"), (-5, "ABSTAIN"),
    (-6, "ABSTAIN here"), (-7, "[E12345] [e1] [E0003]"), (-8, "  \n ABSTAIN \n one \n two "), (-9, ""),
]
KNOWN = ("E1", "E2", "E3", "E0003")
_VALUES = ", ".join("({}, {})".format(i, "'" + t.replace("\n", "' || chr(10) || '") + "'") for i, t in ANSWERS)
ANSWER_SQL = f"""a AS (SELECT conv_id * 1000 + turn AS answer_id, text FROM conversations WHERE role = 'assistant' UNION ALL SELECT * FROM (VALUES {_VALUES}) v(answer_id, text)),
c AS (SELECT answer_id, list(cite ORDER BY pos) AS cites FROM (SELECT answer_id, cite, min(pos) AS pos FROM (SELECT answer_id, unnest(m) AS cite, generate_subscripts(m, 1) AS pos FROM (SELECT answer_id, regexp_extract_all(text, '\\[(E[0-9]{{1,4}})\\]', 1) AS m FROM a)) GROUP BY ALL) GROUP BY answer_id),
l AS (SELECT answer_id, string_split(trim(text, ' ' || chr(10) || chr(9)), chr(10)) AS lines FROM a),
b AS (SELECT answer_id, CASE WHEN upper(trim(lines[1])) = 'ABSTAIN' THEN coalesce(nullif(trim(array_to_string(list_transform(lines[2:], lambda x: trim(x)), ' ')), ''), 'evidence insufficient') END AS reason FROM l)"""
_KNOWN_SQL = "['" + "', '".join(KNOWN) + "']"


def _answers(spark, sf_dir) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "text")
    return turns.unionByName(spark.createDataFrame(ANSWERS, "answer_id long, text string"))


def _known():
    return F.array(*map(F.lit, KNOWN))


@query(f"WITH {ANSWER_SQL} SELECT answer_id, coalesce(array_to_string(cites, ','), '') AS cited FROM a LEFT JOIN c USING (answer_id)")
def parse_citations(spark, sf_dir):
    return _answers(spark, sf_dir).select("answer_id", F.array_join(T.citations(F.col("text")), ",").alias("cited"))


@query(f"WITH {ANSWER_SQL} SELECT answer_id, array_to_string(list_filter(cites, lambda x: NOT list_contains({_KNOWN_SQL}, x)), ',') AS unknown FROM c WHERE len(list_filter(cites, lambda x: NOT list_contains({_KNOWN_SQL}, x))) > 0")
def unknown_citations(spark, sf_dir):
    u = T.unknown_citations(F.col("text"), _known())
    return _answers(spark, sf_dir).filter(F.size(u) > 0).select("answer_id", F.array_join(u, ",").alias("unknown"))


@query(f"WITH {ANSWER_SQL} SELECT answer_id, reason FROM b WHERE reason IS NOT NULL")
def abstentions(spark, sf_dir):
    return _answers(spark, sf_dir).select("answer_id", T.abstention(F.col("text")).alias("reason")).filter("reason is not null")


@query(f"""WITH {ANSWER_SQL} SELECT answer_id, CASE WHEN reason IS NOT NULL THEN 'abstain' WHEN cites IS NULL THEN 'missing'
  WHEN len(list_filter(cites, lambda x: NOT list_contains({_KNOWN_SQL}, x))) > 0 THEN 'unknown' ELSE 'ok' END AS verdict FROM a LEFT JOIN b USING (answer_id) LEFT JOIN c USING (answer_id)""")
def verdicts(spark, sf_dir):
    return _answers(spark, sf_dir).select("answer_id", T.verdict(F.col("text"), _known()).alias("verdict"))


PARAGRAPHS = """p AS (SELECT doc_id AS unit_id, u AS text, i - 1 AS position FROM (SELECT doc_id, unnest(parts) AS u, generate_subscripts(parts, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))),
bounds AS (SELECT unit_id, position, coalesce(sum(length(text) + 2) OVER w, 0)::BIGINT AS s, length(text) AS n FROM p WINDOW w AS (PARTITION BY unit_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT doc_id AS unit_id, k * 97 AS "offset" FROM (SELECT doc_id, unnest(generate_series(0, greatest(length(text) - 1, 0) // 97)) AS k FROM documents))"""


@query(f"""WITH {PARAGRAPHS} SELECT o.unit_id, o."offset", CASE WHEN position IS NOT NULL THEN 'a' || lpad(position::VARCHAR, 4, '0') END AS anchor
FROM o LEFT JOIN bounds b ON o.unit_id = b.unit_id AND o."offset" >= s AND o."offset" < s + n""")
def anchor_lookup(spark, sf_dir):
    d = _docs(spark, sf_dir)
    p = d.select(F.col("doc_id").alias("unit_id"), F.posexplode(F.split("text", "\n")).alias("position", "text")).withColumn("anchor", F.format_string("a%04d", "position"))
    o = d.select(F.col("doc_id").alias("unit_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.length("text") - 1, F.lit(0)).cast("long"), F.lit(97).cast("long"))).alias("offset"))
    return evidence.anchors(o, p)


@query("""WITH spans AS (SELECT doc_id AS query_id, doc_id % 12 + 1 AS place, doc_id AS chunk_id, lang AS rev_id, list_filter([doc_id, doc_id + 1, doc_id + 3], lambda x: x % 5 <> 0) AS us, doc_id AS first FROM documents),
e AS (SELECT query_id, unnest([query_id, query_id + 1, query_id + 3]) AS unit_id, unnest([0, 1, 2]) AS pos FROM spans),
k AS (SELECT query_id, pos, e.unit_id, d.source, d.n_chars FROM e JOIN documents d ON d.doc_id = e.unit_id WHERE e.unit_id % 5 <> 0),
g AS (SELECT query_id, list(unit_id % 100 + 1 ORDER BY pos) AS pages, list(source ORDER BY pos) AS labels, list_sort(list_distinct(list(CASE WHEN n_chars < 1000 THEN 'short' ELSE 'long' END))) AS flags, min_by(unit_id, pos) AS u FROM k GROUP BY query_id)
SELECT s.query_id, 'E' || s.place AS evidence_id, s.chunk_id, 'book ' || s.rev_id AS title, CASE WHEN u IS NULL THEN 'unknown' ELSE 'page' END AS kind,
  array_to_string(pages, ',') AS pages, array_to_string(labels, ',') AS labels, coalesce(array_to_string(flags, ','), '') AS flags, u * 3 AS "offset", u AS unit_id FROM spans s LEFT JOIN g USING (query_id)""")
def build_manifest(spark, sf_dir):
    d = _docs(spark, sf_dir)
    span = lambda k: F.struct((F.col("doc_id") + k).alias("unit_id"), ((F.col("doc_id") + k) * 3).alias("source_start"))
    passages = d.select(
        F.col("doc_id").alias("query_id"), (F.col("doc_id") % 12 + 1).alias("place"), F.col("doc_id").alias("chunk_id"), F.col("lang").alias("rev_id"), F.array(span(0), span(1), span(3)).alias("spans")
    )
    units = d.filter("doc_id % 5 <> 0").select(
        F.col("doc_id").alias("unit_id"), F.lit("page").alias("kind"), (F.col("doc_id") % 100).alias("position"), F.col("source").alias("ref"), F.array(F.when(F.col("n_chars") < 1000, "short").otherwise("long")).alias("flags")
    )
    revisions = d.select(F.col("lang").alias("rev_id")).distinct().withColumn("title", F.concat(F.lit("book "), F.col("rev_id")))
    m = evidence.manifest(passages, units, revisions).drop("boxes", "anchor", "section")
    return m.withColumn("pages", F.array_join("pages", ",")).withColumn("labels", F.array_join("labels", ",")).withColumn("flags", F.array_join("flags", ","))


_HALF = lambda c, i: f"('0x' || {c}[{4 * i + 3}:{4 * i + 4}] || {c}[{4 * i + 1}:{4 * i + 2}])::INT / 65536.0::DOUBLE"


@query(f"""WITH d0 AS (SELECT doc_id, sha256(encode('doc') || unhex('00') || encode(text)) AS s FROM documents), d1 AS (SELECT doc_id, sha256(unhex(s)) AS a FROM d0),
v AS (SELECT doc_id, [{', '.join(_HALF('a', i) for i in range(16))}] AS v FROM d1)
SELECT doc_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round(v[16] / sqrt(list_dot_product(v, v)), 6) AS last FROM v""")
def fake_vectors(spark, sf_dir):
    v = _docs(spark, sf_dir).select("doc_id", embed.fake_vector(F.col("text"), dims=16).alias("v"))
    return v.select("doc_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[15], 6).alias("last"))


@query("""WITH r AS (SELECT doc_id, doc_id % 4 AS k, strlen(text) AS size, doc_id * 7 AS a FROM documents), s AS (SELECT *, CASE k WHEN 1 THEN a WHEN 2 THEN greatest(size - 50, 0) WHEN 3 THEN a END AS b, CASE k WHEN 1 THEN least(a + 99, size - 1) ELSE size - 1 END AS e FROM r)
SELECT doc_id, CASE WHEN k = 0 THEN 200 WHEN b < size THEN 206 ELSE 416 END AS status, CASE WHEN k > 0 AND b < size THEN b END AS start, CASE WHEN k > 0 AND b < size THEN e END AS "end" FROM s""")
def ranged_reads(spark, sf_dir):
    a = (F.col("doc_id") * 7).cast("string")
    k = F.col("doc_id") % 4
    header = F.when(k == 1, F.concat(F.lit("bytes="), a, F.lit("-"), (F.col("doc_id") * 7 + 99).cast("string"))).when(k == 2, "bytes=-50").when(k == 3, F.concat(F.lit("bytes="), a, F.lit("-")))
    r = _docs(spark, sf_dir).select("doc_id", files.byte_range(F.encode("text", "UTF-8"), header).alias("r"))
    return r.select("doc_id", "r.status", "r.start", "r.end")


@query("""SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'missing' WHEN vec_id % 5 = 1 THEN 'dimensions' WHEN vec_id % 5 = 2 THEN 'not_normalized' WHEN vec_id % 5 = 3 THEN 'zero' END AS problem FROM embeddings""")
def vector_checks(spark, sf_dir):
    k, v = F.col("vec_id") % 5, F.col("embedding")
    made = F.when(k == 1, F.slice(v, 1, 3)).when(k == 2, F.transform(v, lambda x: x * 2)).when(k == 3, F.transform(v, lambda x: x * 0)).when(k == 4, v)
    return table(spark, sf_dir, "embeddings").select("vec_id", embed.vector_problem(made, 64).alias("problem"))
