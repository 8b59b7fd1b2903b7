"""The pipeline's stages, each on its own input, against plain versions."""

import hashlib

import pytest
from test_operators import base, contamination, tiktoken_encoding

import corpus_pipeline as P
from pagemill.llm import quality
from pagemill.session import table

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, D, "documents")


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_are_named_and_ordered():
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "byte_level_bpe"]


def test_quality_stage_rejects_by_score(spark, docs):
    kept = P.quality_stage(spark, docs, D)
    assert kept.schema == docs.schema
    scored = quality.score(docs, quality.fit(docs, table(spark, D, "labels"))).collect()
    assert set(rows(kept)) == {r.doc_id for r in scored if r.score >= P.REJECT_BELOW}
    labels = {r.doc_id: r.quality for r in table(spark, D, "labels").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in rows(kept) for i in good) > 0.98 * len(good)


def test_near_duplicate_stage_keeps_one_of_each_group(spark, docs):
    long = " ".join(f"w{i * 7919 % 1000}" for i in range(800))
    near = long.replace("w0 ", "changed ", 1)
    more = [(900_001, long), (900_002, near), (900_003, long), (900_003, long), (900_004, "quite another text " + long[::-1])]
    planted = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in more], docs.schema)
    kept = P.near_duplicate_stage(spark, docs.unionByName(planted), D)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and [i for i in sorted(ids) if i > 900_000] == [900_001, 900_004]
    texts = {r.doc_id: r.text for r in docs.collect()}
    first: dict = {}
    for i in sorted(texts):
        first.setdefault(texts[i], i)
    assert set(ids) - {900_001, 900_004} <= set(first.values())


def test_decontamination_stage(spark, docs):
    items = [(str(r.item_id), r.text) for r in table(spark, D, "benchmark").collect()]
    own = docs.collect()
    want = {r.doc_id for r, (*_, hit) in zip(own, contamination([r.text for r in own], items), strict=True) if not hit}
    kept = P.decontamination_stage(spark, docs, D)
    assert kept.schema == docs.schema and set(rows(kept)) == want and len(want) < len(own)


def test_secret_stage(spark, docs):
    before, after = rows(docs), rows(P.secret_stage(spark, docs, D))
    assert before.keys() == after.keys()
    for i, r in before.items():
        if not base(r.text):
            assert after[i] == r
        else:
            assert not base(after[i].text) and after[i].n_chars == len(after[i].text)


def test_run_ends_in_ids(spark):
    out = P.run(spark, D)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded_chars"]
    got = rows(out)
    assert 0 < len(got) < table(spark, D, "documents").count()
    want = tiktoken_encoding()
    texts = rows(table(spark, D, "documents"))
    for i, r in got.items():
        if not base(texts[i].text):
            ids = want.encode_ordinary(texts[i].text)
            assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


ODD = [(None, None), (1, ""), (2, " "), (3, "same text"), (3, "same text"), (4, "word " * 30_000), (5, "x" * 50_000), (6, "password = hunter2hunter2 É中😀"), (None, "token: abcdefgh12345678")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing column names."""
    rows = [(i, t, None, None if n % 2 else "s", None, 7, "clash", "c") for n, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, __row string, n_tokens string")


def kept(df):
    return sorted((str(r.doc_id), r.text or "") for r in df.collect())


def test_stages_bear_odd_rows(spark, odd):
    every = sorted((str(i), t or "") for i, t in ODD)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, odd, D)
        assert out.schema == odd.schema and stage(spark, odd.limit(0), D).count() == 0, name
        got = kept(out)
        if name == "quality_classifier":  # no labelled rows, or whatever their labels make of them
            assert set(got) <= set(every) and got.count(("3", "same text")) in (0, 2)
        elif name == "simhash_near_dedup":
            assert got == sorted({x for x in every if x[1].strip()} | {("1", "")})
        elif name == "benchmark_decontamination":
            assert got == every
        else:
            assert [i for i, _ in got] == [i for i, _ in every] and not any("hunter2" in t or "abcdefgh1" in t for _, t in got)
            assert [r for r in out.collect() if r.text == "x" * 50_000] and out.filter("text is null").count() == 1


def test_encoding_stage(spark, odd):
    """Ids of what the stage before left, redacted texts among them, for every row."""
    before = P.secret_stage(spark, odd, D)
    want = tiktoken_encoding()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = []
    for r in before.collect():
        ids = want.encode_ordinary(r.text or "")
        expected.append((str(r.doc_id), len(ids), digest(" ".join(map(str, ids))), digest(r.text or ""), len(r.text or "")))
    assert sorted((str(r[0]), *r[1:]) for r in P.encoding_stage(spark, before, D).collect()) == sorted(expected)
    assert P.encoding_stage(spark, odd.limit(0), D).count() == 0
