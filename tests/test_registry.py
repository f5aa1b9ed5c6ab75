"""Every registered query over the driver tables against its SQL."""

from collections import Counter

import duckdb
import pytest

from factloom import registry
from factloom.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, oracle, name):
    found = registry.queries()[name](spark, SF)
    sql = registry.oracle_sql()[name]  # each query of the registry has SQL
    result = oracle.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(found.columns)
    at = [names.index(c) for c in found.columns]
    expected = Counter(tuple(str(row[i]) for i in at) for row in result.fetchall())
    assert Counter(tuple(str(v) for v in row) for row in found.collect()) == expected
