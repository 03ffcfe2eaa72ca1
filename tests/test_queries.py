"""Every query of the library against its SQL on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from attesta import registry
from attesta.plans import star

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return float(f"{float(value):.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = duck.execute(registry.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str) == want


def test_studio_query_returns_every_record_of_its_period(spark):
    own = star.records(spark, FOLDER).where("confidence >= 30 AND quality >= 40 AND start_date >= '1996-01-01' AND coalesce(end_date, '9999-12-31') <= '2000-12-31' AND array_contains(tags, 'even')")
    want = {r.record_id for r in own.select("record_id").collect()}
    assert {r.record_id for r in star.studio_query(spark, FOLDER).collect()} == want and len(want) == 60
