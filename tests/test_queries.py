"""Every query of the catalogue: against its SQL where there is one, else that it gives rows of a stable schema."""

import pytest
from oracle import duck, rows_of

from pagemill.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    assert rows_of(catalogue.QUERIES[name](spark, sf_dir)) == duck(sf_dir, catalogue.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(5).count() == 5
