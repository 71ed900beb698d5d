import math

import duckdb
import pytest

from workload.jobs import JOBS
from workload.sql import SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in ("events", "orders"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def as_text(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value + 0.0)
    return None if value is None else str(value)


def test_every_job_has_its_sql():
    assert set(JOBS) == set(SQL)


@pytest.mark.parametrize("name", sorted(JOBS))
def test_job(spark, db, name):
    ours, theirs = JOBS[name](spark, DATA), db.sql(SQL[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    a = sorted((tuple(as_text(r[c]) for c in columns) for r in ours.collect()), key=str)
    place = [theirs.columns.index(c) for c in columns]
    b = sorted((tuple(as_text(r[i]) for i in place) for r in theirs.fetchall()), key=str)
    assert a == b


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 24
    assert [r["periode"] for r in rows] == sorted(r["periode"] for r in rows)
