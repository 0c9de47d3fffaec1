"""Every registered query: against its SQL where there is one, else for rows and a stable schema."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare

QUERIES, SQL = queries(), oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), SQL[name], sf) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    rows = QUERIES[name](spark, sf).collect()
    assert len(rows) >= {"txt_proper_nouns": 40}.get(name, 1)


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
