"""Every registered query outside the llm subpackage against its SQL, on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from billmill.plans import catalogue, more  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return tuple(map(plain, value.values() if isinstance(value, dict) else value)) if isinstance(value, (dict, list, tuple)) else value


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_sql(spark, tables, name):
    want = tables.execute(catalogue.ORACLES[name])
    found = [c[0] for c in want.description]
    columns = sorted(found)
    rows = catalogue.QUERIES[name](spark, SF).select(columns).collect()
    expected = Counter(repr(plain([r[found.index(c)] for c in columns])) for r in want.fetchall())
    assert Counter(repr(plain(list(r))) for r in rows) == expected
    assert rows or name in ("export_rejected",)
