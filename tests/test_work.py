"""What the work of a query grows with: plans and rows handed on, with the same results as the plain way."""

import random

import numpy as np
from pyspark.sql import functions as F

from pagemill.operators import bm25, catalog, embed, hybrid, pruned, reports
from pagemill.plans import operations, retrieval, stores
from pagemill.sources import boxes


def plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_dense_topk_by_products(spark):
    """Copies, ties, halves at the seventh decimal, nulls and vectors of another kind, as if all pairs were scored one by one."""
    rng = random.Random(5)
    rows = [(i, [rng.choice((-1.0, 0.5, 0.0000005, 0.25)) for _ in range(4)]) for i in range(300)]
    rows += [(1000 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(40)] + [(None, [1.0, 1.0, 1.0, 1.0])]
    odd = [(2000, None), (2001, [1.0]), (2002, [float("nan"), 1.0, 1.0, 1.0]), (2003, [float("inf"), 0.0, 0.0, 1.0]), (2004, [1.0, None, 1.0, 1.0])]
    vectors = lambda r: spark.createDataFrame(r, "chunk_id long, vector array<double>")
    for stored, asked in ((rows, rows[:25]), (rows + odd, rows[:5] + odd), (odd, rows[:3]), (rows, [])):
        q = vectors(asked).toDF("query_id", "query")
        want = hybrid.top(hybrid._one_by_one(vectors(stored), q, 1 << 20), 7, ["query_id"])
        assert sorted(map(repr, want.collect())) == sorted(map(repr, hybrid.dense_topk(vectors(stored), q, 7).collect()))
    in_blocks = hybrid.dense_topk(vectors(rows), vectors(rows[:25]).toDF("query_id", "query"), 7, query_bytes=300)
    q = vectors(rows[:25]).toDF("query_id", "query")
    assert sorted(map(repr, in_blocks.collect())) == sorted(map(repr, hybrid.dense_topk(vectors(rows), q, 7).collect()))
    # No pair of a query and a vector is a row of the plan.
    assert "Join" not in plan(hybrid.dense_topk(vectors(rows), q, 7))
    assert hybrid.dense_topk(vectors(rows), q.filter(F.lit(False)), 7).count() == 0


def test_heavy_terms_are_few(spark):
    """Whatever share of the vocabulary tasks know, the k greatest weights are the same, and few terms are handed on."""
    rng = random.Random(7)
    texts = [(i, " ".join([f"w{int(rng.paretovariate(0.4)) % 5000}" for _ in range(rng.choice((0, 3, 200)))])) for i in range(120)] + [(900, None), (901, "w1 w1 w2")]
    own = spark.createDataFrame(texts, "chunk_id long, text string")
    size, frequencies = bm25.sizes_and_frequencies(own)
    best = lambda counts: sorted(map(tuple, bm25.top(bm25.weights(counts, frequencies, size).withColumn("w", F.round("w", 6)), 5, ["chunk_id"], F.col("w"), "term").collect()))
    every = bm25.term_counts(own, "chunk_id")
    want = best(every)
    for most in (0, 30, 1 << 18):
        assert best(bm25.heavy_terms(own, "chunk_id", frequencies, size, 5, most=most)) == want
    assert bm25.heavy_terms(own, "chunk_id", frequencies, size, 5).count() * 3 < every.count()
    none = own.filter("false")
    size, frequencies = bm25.sizes_and_frequencies(none)
    assert bm25.heavy_terms(none, "chunk_id", frequencies, size, 5).count() == 0


def test_fake_vector_digests_once(spark):
    """A text is digested once, and a digest of the chain too, however many dimensions there are."""
    made = spark.range(3).select(embed.fake_vector(F.concat(F.lit("t"), F.col("id").cast("string")), dims=40).alias("v"))
    assert plan(made).count("sha2(") <= 2
    assert all(len(r.v) == 40 and abs(sum(x * x for x in r.v) - 1) < 1e-9 for r in made.collect())


def test_box_expressions_stay_small(spark):
    """A matrix doesn't repeat its factors' expressions, so plans grow with the number of products only."""
    w, h = 200 + F.col("id") % 50, 300 + F.col("id") % 40
    turn = (F.col("id") % 4).cast("int") * 90
    crop = F.array(F.lit(10.0), F.lit(20.0), F.lit(100.0), F.lit(90.0))
    m = boxes.page_to_raster(w, h, turn, crop)
    box = F.array(F.lit(12.0), F.lit(24.0), F.lit(40.0), F.lit(20.0))
    made = spark.range(8).select(boxes.apply(boxes.inverse(m), boxes.apply(m, box, 9)).alias("b"))
    assert plan(made).count("CASE WHEN") < 100
    assert all([round(x, 3) for x in r.b] == [12.0, 24.0, 40.0, 20.0] for r in made.collect())


def test_search_counts_searches_once(spark, sf_dir):
    """The corpus' texts are not searched again by each branch of the plan."""
    made = retrieval.search_counts(spark, sf_dir)
    assert "MapInArrow" not in plan(made) and "embedding" not in plan(made)


def test_keyword_search_hands_on_the_best(spark):
    """No word of a text is a row of the plan; texts whose score is rounded to zero are hits, nulls and empty ones none."""
    texts = [(i, "the " + "x " * (4000 if i % 5 == 4 else 10) + ("Él\u00e8ve" if i % 4 == 0 else "")) for i in range(40)] + [(90, None), (91, "")]
    s = spark.createDataFrame(texts, "rev_id long, text string")
    q = spark.createDataFrame([(1, "eleve THE the"), (2, "the"), (3, "?"), (4, "unknown")], "query_id long, text string")
    made = reports.keyword_search(s, q, k=50)
    assert "Generate" not in plan(made)
    got = {(r.query_id, r.rev_id): r.score for r in made.collect()}
    assert {x for x in got if x[0] == 1} == {(1, i) for i in range(40)} and {x for x in got if x[0] > 1} == {(2, i) for i in range(40)}
    assert got[2, 4] == 0.0 and got[1, 4] < got[1, 9]


def test_words_are_placed_in_their_rows(spark, sf_dir):
    """Word boxes need no window over a document's words; points need the texts of chunks with a vector alone."""
    boxed = stores._word_boxes(spark, sf_dir)
    assert "Window" not in plan(boxed)
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text IS NOT NULL").orderBy("doc_id").first()
    got = sorted((r.r_start, r.r_end) for r in boxed.filter(F.col("unit_id") == text.doc_id).collect())
    assert [text.text[a:b] for a, b in got] == [w for w in text.text.split(" ") if w]
    assert plan(operations.index_points(spark, sf_dir)).count("LeftSemi") >= 1


def test_reconcile_joins_no_points(spark):
    """Points are counted by key; repeated and null ones count as in a full join."""
    e = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 1), (3, 1), (4, None), (5, 1)], "pub_id long, point_id long")
    g = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 1, False), (3, 1, True), (4, None, True), (5, 2, True)], "pub_id long, point_id long, active boolean")
    staged = spark.createDataFrame([(1, 1, 2), (2, 2, 1), (3, 3, 2), (4, 4, 1), (5, 5, 1), (6, 6, 0)], "pub_id long, rev_id long, expected_points int")
    made = catalog.reconcile(staged, e, g, spark.createDataFrame([(6,)], "rev_id long"))
    assert plan(made).count("Join FullOuter") == 0
    assert dict(map(tuple, made.collect())) == {1: "promote", 2: "delete", 3: "promote", 4: "leave", 5: "leave", 6: "leave"}


def test_block_max_search_moves_neither_vocabulary_nor_index(spark, sf_dir, monkeypatch):
    """Frequencies are counted of the queries' terms alone, and the blocks to begin with are looked up where the index lies."""
    counted, handed, real = [], [], pruned.top
    monkeypatch.setattr(bm25, "counted", lambda *a, **b: counted.append(a))
    monkeypatch.setattr(pruned, "top", lambda scores, *a: handed.append(scores._jdf.queryExecution().executedPlan().toString()) or real(scores, *a))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = stores.block_max_search(spark, sf_dir).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert not counted and not [p for p in handed if "SortMergeJoin" in p]
    assert sorted(map(tuple, got)) == sorted(map(tuple, retrieval.bm25_search(spark, sf_dir).collect()))


def test_inverted_blocks_are_scored_where_they_lie(spark, monkeypatch):
    """Bounds and scores of a batch of blocks, in tables of any size, as if each text was weighted by itself."""
    rng = random.Random(3)
    texts = [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.choice((0, 2, 60))))) for i in range(150)]
    texts += [(200, None), (201, ""), (202, "\u0130x STRASSE w1 w1"), *((300 + i, "w1 w2 w2") for i in range(40)), *((400 + i, "none known") for i in range(8))]
    own = spark.createDataFrame(texts, "chunk_id long, text string")
    queries = spark.createDataFrame([(1, "w1 w2 w3 w3"), (2, "\u0130X strasse"), (3, "unheard"), (4, " ".join(f"w{i}" for i in range(250))), (5, "")], "query_id long, text string")
    n, avgdl, df = bm25.asked_statistics(own, queries)
    size, frequencies = bm25.sizes_and_frequencies(own)
    every = {r["term"]: r["df"] for r in frequencies.collect()}
    assert (n, avgdl) == tuple(size.first()) and df == {t: every[t] for t in df} and "unheard" not in df and "none" not in df
    block = bm25._question_blocks(queries)[0]
    made = bm25._Block(block, [1, 2, 3, 4], n, avgdl, df, bm25.Bm25())
    scorer = pruned._Terms(made)
    stored = pruned.inverted(own, rows=4, parts=1, avgdl=avgdl)
    table = stored.orderBy("block").toArrow().combine_chunks()
    whole = table.to_batches()[0]
    words = {i: bm25.words(t) for i, t in texts}
    for batch in (whole, whole.slice(7, 30)):
        ids = batch.column("chunk_ids").to_pylist()
        for cells in (1, 3000, 1 << 22):
            monkeypatch.setattr(pruned, "CELLS", cells)
            rows = scorer.rows(batch)
            seen = [(a + i, b, u[i]) for a, bounds, u in rows.bounds(True) for i, b in enumerate(bounds)]
            assert [x[0] for x in seen] == list(range(batch.num_rows))
            for row, bounds, units in seen:
                want = np.zeros((len(ids[row]), 4))
                for at, i in enumerate(ids[row]):
                    terms, tf, length = made.counted(words[i])
                    if len(terms):
                        want[at] = (made.idf[terms] * made._saturated(tf, length)) @ made.weights[terms]
                assert np.allclose(rows.scores(row, np.arange(4)), want, atol=1e-12) and np.allclose(rows.scores(row, np.array([0, 3])), want[:, [0, 3]], atol=1e-12)
                assert (bounds + 1e-9 >= want.max(axis=0)).all()
                held = [sum(t in set(words[i]) for i in ids[row] for t in {r[2] for r in block if r[0] == q}) for q in (1, 2, 3, 4)]
                assert units.tolist() == held
    for some in (own.filter("false"), own.filter("chunk_id IN (200, 201)")):
        n, avgdl, df = bm25.asked_statistics(some, queries)
        hits, _ = pruned.search(pruned.inverted(some, avgdl=avgdl), df, n, avgdl, queries, 3)
        assert hits.count() == 0
