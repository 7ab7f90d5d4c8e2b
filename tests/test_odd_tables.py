"""Queries beside their SQL on small tables with rows that the given ones do not have."""

from collections import Counter

import duckdb
import pytest

from lexmill.plans.registry import QUERIES, SQL


def differences(spark, folder, name, tables):
    """(rows only of the query, rows only of its SQL) over ``tables``: name -> SELECT that makes it."""
    con = duckdb.connect()
    for t, select in tables.items():
        con.execute(f"COPY ({select}) TO '{folder}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, str(folder))
    cur = con.execute(f"SELECT {', '.join(df.columns)} FROM ({SQL[name]})")
    got, want = Counter(map(tuple, df.collect())), Counter(cur.fetchall())
    assert want
    return list((got - want).elements()), list((want - got).elements())


@pytest.mark.parametrize("last", ["2024-01-03 12:00:00.1", "2024-01-03 12:00:00", "2024-01-03 12:00:00.999999", "1970-01-01 00:00:00.1", "1969-12-31 23:59:59.5"])
def test_lags_are_counted_from_second_to_second(spark, tmp_path, last):
    # users 1 to 8 are an hour or 36 hours behind, give or take less than a second; 9 has no time, 10 no type
    behind = [3599.2, 3600.0, 3600.05, 3600.9, 36 * 3600 + 0.05, 36 * 3600 + 0.95, 36 * 3600, 36 * 3600 + 1.0]
    rows = [f"({u}, TIMESTAMP '{last}' - to_microseconds({round(s * 10**6)}), {u}, 'view')" for u, s in enumerate(behind, 1)]
    rows += [f"(0, TIMESTAMP '{last}', 0, 'click')", "(9, NULL, 9, 'error')", f"(10, TIMESTAMP '{last}', 10, NULL)", f"(11, TIMESTAMP '{last}', 10, 'error')"]
    events = f"SELECT event_id::BIGINT AS event_id, ts::TIMESTAMP AS ts, user_id::BIGINT AS user_id, event_type FROM (VALUES {', '.join(rows)}) v(event_id, ts, user_id, event_type)"
    assert differences(spark, tmp_path, "a59_latest_run_health", {"events": events}) == ([], [])


def test_first_active_line_goes_by_the_number_of_the_sql(spark, tmp_path):
    lines = [
        (1, 5, 5500, 1, "A"), (1, 6, 100, 1, "A"),  # the larger part key comes first: 6100 against 10500
        (2, 2_500_000, 7, 1, "A"), (2, 3, 8, 2, "A"), (2, 1, 1, 1, "N"),  # so does the larger line number
        (3, 1, None, 1, "A"), (3, 2, 9, 2, "A"), (3, None, 4, 1, "A"), (3, 1, 4, None, "A"),  # no number, no line
        (4, 1, 2, 1, None), (4, 1, 3, 1, "N"),  # an unknown flag beside a known one is not R
        (5, 1, 2, 1, None), (None, 1, 2, 1, "R"), (None, 1, 3, 1, "A"), (6, 1, 2, 1, "R"),
    ]
    rows = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in x) + ")" for x in lines)
    lineitem = f"SELECT l_orderkey::BIGINT AS l_orderkey, l_partkey::BIGINT AS l_partkey, l_suppkey::BIGINT AS l_suppkey, l_linenumber::INT AS l_linenumber, l_returnflag FROM (VALUES {rows}) v(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag)"
    assert differences(spark, tmp_path, "f81_nested_facets", {"lineitem": lineitem}) == ([], [])
