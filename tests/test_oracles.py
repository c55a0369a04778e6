"""Every catalogued query beside its SQL in DuckDB, over the smallest tables."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from memlake.plans import catalogue
from memlake.plans.domain import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalogue.oracles()))
def test_same_rows(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    found = con.execute(catalogue.oracles()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = Counter(tuple(plain(v) for v in r) for r in found.fetchall())
    got = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    assert got == want
