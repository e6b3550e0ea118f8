"""Every registered query against its DuckDB twin, as the driver compares them."""

from __future__ import annotations

import math
import os

import duckdb
import pytest
from pyspark.sql import Row

from lorespan import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v) -> str:
    if isinstance(v, Row):
        v = v.asDict()
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return f"{v:.5f}"
    if isinstance(v, dict):
        return str({k: plain(x) for k, x in v.items()})
    if isinstance(v, list):
        return str([plain(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_twin(spark, duck, name):
    out = catalogue.queries()[name](spark, SF)
    rows = sorted(tuple(plain(r[c]) for c in sorted(out.columns)) for r in out.collect())
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        return
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(out.columns)
    order = [names.index(c) for c in sorted(names)]
    assert rows == sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns and out.count() == 6
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
