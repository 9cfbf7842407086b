"""Every query against its SQL, compared as sorted rows."""

import glob
import math
import os

import duckdb
import pytest

from quarry.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def _key(row):
    return [(x is None, str(type(x).__name__ if isinstance(x, str) else ""), x if x is not None else 0) for x in row]


def _close(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    rows = sorted([tuple(r[c] for c in cols) for r in df.collect()], key=_key)
    assert rows
    if name not in ORACLES:
        return
    res = duck.execute(ORACLES[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    want = sorted([tuple(r[names.index(c)] for c in cols) for r in res.fetchall()], key=_key)
    assert len(rows) == len(want)
    bad = [(a, b) for a, b in zip(rows, want, strict=True) if not all(_close(x, y) for x, y in zip(a, b, strict=True))]
    assert not bad, bad[:3]
