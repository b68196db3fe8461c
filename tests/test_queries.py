"""Every query against its SQL, on the smallest tables."""

import pytest

from __spark_entry__ import entry
from workloads import QUERIES, SQL
from tools.check_oracle import compare, connect


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert compare(got, duck.execute(SQL[name]).df()) == "ok"


def test_entry(spark):
    assert entry(spark).count() > 0
