"""Every catalogued query against its DuckDB SQL on the smallest tables."""

import pytest

from oracle import connect, same
from tracklume.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(name, spark, db):
    same(catalogue.queries()[name], catalogue.oracle_sql()[name], spark, SF, db)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_without_sql(name, spark):
    assert catalogue.queries()[name](spark, SF).count() > 0
