"""Every query that has an oracle text gives the oracle's rows."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from rowledger import queries as core

#: The larger tables hold rows that the smallest do not.
FOLDERS = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]
pytestmark = pytest.mark.skipif(not Path(FOLDERS[0]).exists(), reason="the tables are not here")


@pytest.fixture(scope="module", params=FOLDERS)
def oracle(request):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in sorted(Path(request.param).glob("*.parquet")):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c, request.param


def plain(v: object) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float | Decimal):
        return f"{float(v):.6f}"
    return str(v)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_same_rows(spark, oracle, name):
    tables, folder = oracle
    got = core.queries()[name](spark, folder)
    want = tables.sql(core.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a = sorted(tuple(plain(r[c]) for c in cols) for r in got.collect())
    at = [want.columns.index(c) for c in cols]
    b = sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert a == b


def test_entry(spark):
    import __spark_entry__

    assert {r["kind"] for r in __spark_entry__.entry(spark).collect()} == {"insert", "update", "delete"}
