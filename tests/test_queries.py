import pytest

import __spark_entry__
from tessella import queries, queries_images, queries_shapes
from tests.oracle import same


MODULES = (queries, queries_images, queries_shapes)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(name, spark, sf_dir):
    same(QUERIES[name], ORACLE_SQL[name], spark, sf_dir)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_run(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_names_are_registered_once():
    assert len(QUERIES) == sum(len(m.QUERIES) for m in MODULES)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
