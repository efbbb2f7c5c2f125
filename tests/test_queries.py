"""Each registered query against its SQL on the smallest tables."""

import pytest
from duck import same_rows

import __spark_entry__
from leafmill.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    same_rows(QUERIES[name](spark, sf_dir), SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).columns


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 10 and all(r.context.startswith("--- Source 1 ---") for r in rows)


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
