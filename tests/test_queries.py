"""Every core query against its SQL twin, at the smallest scale."""

import glob
import math
import os

import duckdb
import pytest

from ablata.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for path in glob.glob("/root/testdata/sf0.001/*.parquet"):
        found.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return found


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
