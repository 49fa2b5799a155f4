import pytest

import __spark_entry__ as entry
import oracle

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.catalog.QUERIES, entry.catalog.ORACLE


@pytest.fixture(scope="module")
def duck():
    return oracle.duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_the_oracle(spark, duck, name):
    assert oracle.same(QUERIES[name](spark, SF), duck.sql(SQL[name])) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"ML2", "ML3", "ML6", "ML8"}))
def test_returns_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["pmid", "title", "year", "score"]
