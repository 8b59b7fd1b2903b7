"""Every operator on an empty table of documents: no rows, the same columns."""

import pytest

from pagemill.llm import bpe, decontaminate, langid, media, packing, periodic, quality, secrets, sharding, simhash, spelling, tokencount
from pagemill.session import table


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return {n: table(spark, sf_dir, n) for n in ("documents", "benchmark", "labels")}


OPERATORS = {
    "matched": lambda d, t: decontaminate.matched(d, t["benchmark"]),
    "report": lambda d, t: decontaminate.report(d, t["benchmark"]),
    "scan": lambda d, t: secrets.scan(d),
    "redact": lambda d, t: secrets.redact(d),
    "predict": lambda d, t: langid.predict(d, langid.fit(t["documents"])),
    "stored": lambda d, t: media.stored(d),
    "media": lambda d, t: media.digest(media.stored(d)),
    "assign": lambda d, t: sharding.assign(d),
    "score": lambda d, t: quality.score(d, quality.fit(t["documents"], t["labels"])),
    "count": lambda d, t: tokencount.count(d),
    "components": lambda d, t: simhash.components(d),
    "keep_first": lambda d, t: simhash.keep_first(d),
    "encode": lambda d, t: bpe.encode(d),
    "encode_digest": lambda d, t: bpe.encode_digest(d),
    "pack": lambda d, t: packing.digest(d),
    "runs": lambda d, t: periodic.runs(d),
    "periodic": lambda d, t: periodic.digest(d),
    "spelling": lambda d, t: spelling.report(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_an_empty_table_gives_no_rows(tables, name):
    d = tables["documents"]
    got = OPERATORS[name](d.limit(0), tables)
    assert got.collect() == [] and len(set(got.columns)) == len(got.columns)


def test_models_of_empty_tables_score_rows(tables):
    d, none = tables["documents"].limit(3), tables["documents"].limit(0)
    assert {r.lang_pred for r in langid.predict(d, langid.fit(none)).collect()} == {"und"}
    assert {r.score for r in quality.score(d, quality.fit(none, tables["labels"])).collect()} == {0.5}
