"""Every query of the library's own operators against its SQL in DuckDB, on whole tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as driver
from scrapelake.plans.checks import QUERIES
from scrapelake.plans.oracle import ORACLE

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else round(value, 6)
    return value


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(plain, key=repr)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLE.keys()
    assert QUERIES.items() <= driver.queries().items()
    assert ORACLE.items() <= driver.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, duck, name):
    result = QUERIES[name](spark, SF_DIR)
    got = _table(result.columns, result.collect())
    cursor = duck.execute(ORACLE[name])
    expected = _table([c[0] for c in cursor.description], cursor.fetchall())
    assert got[0] == expected[0]
    assert len(got[1]) == len(expected[1])
    assert len(got[1]) > 0
    assert got[1] == expected[1]


def test_entry(spark):
    assert driver.entry(spark).count() > 0
