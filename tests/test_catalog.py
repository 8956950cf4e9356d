"""Each query of the catalog against its SQL on the test tables."""

import math
import os

import pytest

from millrace.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, (bytearray, bytes)):
        return bytes(v).hex()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0 if math.isinf(v) else float(f"{v:.12g}") + 0.0
    return v if v is None or isinstance(v, (int, bool)) else str(v)


def _rows(rows):
    return sorted((tuple(_plain(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    found = catalog.QUERIES[name](spark, SF)
    wanted = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in wanted.description]
    assert sorted(found.columns) == sorted(names)
    assert _rows(found.select(*names).collect()) == _rows(wanted.fetchall())
