"""Every query beside its SQL, on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from lexmill.plans.registry import QUERIES, SQL
from tools.compare import norm

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name in SQL:
        cur = con.execute(SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        want = Counter(tuple(norm(r[i]) for i in at) for r in cur.fetchall())
        assert got == want
    else:
        assert sum(got.values()) > 0 or name.startswith("s20")


def test_entry_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["n_name", "r_name", "volume", "value", "potential", "either", "density", "score", "place"]
    assert df.count() > 0


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
