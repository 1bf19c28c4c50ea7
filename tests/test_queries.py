import pytest

from corpusloom.queries import catalog
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_sql(spark, name):
    assert_same(spark, name, catalog.QUERIES[name], catalog.ORACLE[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_runs(spark, name):
    frame = catalog.QUERIES[name](spark, SF)
    rows = frame.collect()
    assert rows and len(set(rows)) == len(rows), "a query without SQL gives rows, none of them twice"
    assert all(any(v is not None for v in row) for row in rows)
