"""Every query with SQL agrees with DuckDB on the smallest tables; the others run."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from parley import plans

SF = "/root/testdata/sf0.001"
TABLES = ("conversations", "documents", "benchmark", "labels", "embeddings", "events", "pages", "nation")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def rows(frame):
    plain = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else x.item() if hasattr(x, "item") else x
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=lambda r: tuple((x is None, str(x)) for x in r))


pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_agrees_with_sql(spark, duck, name):
    got, want = plans.QUERIES[name](spark, SF).toPandas(), duck.sql(plans.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_has_rows(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
