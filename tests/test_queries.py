"""Every registered query against its SQL; those without SQL must run and keep their schema."""

import pytest

import compare
from promptlake.queries import FLAGSHIP, QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, name):
    compare.same_rows(spark, sf_dir, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES


def test_entry_imports_without_a_session():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
