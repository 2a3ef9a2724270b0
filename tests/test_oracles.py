"""Every registered query against its DuckDB statement, over whole tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from tabulon.plans.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    yield con
    con.close()


def plain(v):
    if v is None or v != v:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return f"{float(v) + 0.0:.6g}" if abs(v) < 1e15 else str(int(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(df.columns)
        want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())
        assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in rows) == want
