"""Each registered query against its SQL, as the driver compares them."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql
from engagement.plans.registered import QUERIES

EXPECTED = oracle_sql()


def views(folder):
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection


@pytest.fixture(scope="module")
def duck(folder):
    return views(folder)


def ordered(rows):
    return sorted(rows, key=lambda row: [(value is None, str(value)) for value in row])


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows(name, spark, duck, folder):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = [tuple(row) for row in df.select(*columns).collect()]
    expected = duck.execute(EXPECTED[name])
    names = [column[0] for column in expected.description]
    assert sorted(names) == columns
    places = [names.index(column) for column in columns]
    assert ordered(got) == ordered(tuple(row[i] for i in places) for row in expected.fetchall())


@pytest.mark.parametrize("name", [name for name in QUERIES if name.startswith("job_5_update")])
def test_updates_on_more_rows(name, spark, folder):
    larger = folder.replace("0.001", "0.01")
    test_same_rows(name, spark, views(larger), larger)


def test_entry(spark):
    assert entry(spark).count() == 5
