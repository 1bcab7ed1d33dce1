"""Every query against its SQL on the smallest test tables, and the driver's entry point."""

from pathlib import Path

import pytest

import __spark_entry__ as driver
from check import normal, rows_of

FOLDER = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    import duckdb

    connection = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", list(driver.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    frame = driver.queries()[name](spark, str(FOLDER))
    result = db.execute(driver.oracle_sql()[name])
    assert rows_of(frame.columns, frame.collect()) == rows_of([d[0] for d in result.description], result.fetchall())


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert rows[0].response_position == "C" and rows[-1].response_position == "Center"
    assert normal(float("nan")) is None


def test_every_sql_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
