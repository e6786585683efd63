"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quirespark import queries

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def as_rows(frame, columns):
    return sorted(tuple(str(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, db, name):
    mine = queries.queries()[name](spark, D).toPandas()
    if name in queries.oracle_sql():
        other = db.execute(queries.oracle_sql()[name]).df()
        assert sorted(mine.columns) == sorted(other.columns)
        columns = sorted(mine.columns)
        assert as_rows(mine, columns) == as_rows(other, columns)


def test_entry_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
