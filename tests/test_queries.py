import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from verdance.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "year"):
        return str(v)[:10]
    if hasattr(v, "item"):
        v = v.item()
    return round(v, 9) + 0.0 if isinstance(v, float) else v


def rows(records):
    return sorted((tuple(map(plain, r)) for r in records), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute(catalog.oracle_sql()[name]).df()
    assert columns == sorted(want.columns)
    assert rows(df.select(columns).collect()) == rows(want[columns].itertuples(index=False))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.oracle_sql())


def test_the_flagship_scans_only_what_it_needs(spark):
    plan = catalog.QUERIES[catalog.FLAGSHIP](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan
