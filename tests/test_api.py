"""The callers' functions on small frames."""

import pytest
from pyspark.sql import functions as F

from lexmill import api


@pytest.fixture(scope="module")
def rows(spark):
    d = spark.createDataFrame([(f"c{i:02d}", "TJSP" if i % 2 else "TJMG", i % 5, float(i) / 20, "pre" if i % 3 else "issued", f"words about case {i}") for i in range(20)], "case string, court string, day long, score double, category string, text string")
    return d.persist()


def test_pages(rows):
    seen, after = [], None
    while True:
        page = api.cases(rows, courts=["TJSP"], after=after, size=3).collect()
        seen += [r.case for r in page]
        after = api.next_cursor(page, "day", "case", 3)
        if after is None:
            break
    want = sorted(((-(i % 5), f"c{i:02d}") for i in range(20) if i % 2))
    assert seen == [c for _, c in want]


def test_movements_and_ranking(rows):
    assert [r.case for r in api.movements(rows, query='"case 7"').collect()] == ["c07"]
    assert api.movements(rows, kind="PRE", kind_col="category").count() == 13
    assert api.ranked(rows, "case", "text", "7", 5).first().case == "c07"


def test_charts(rows):
    assert api.chart(rows, "facet", key="category", n=1).first().total == 13
    assert {r.label: r.total for r in api.chart(rows, "others", key="case", n=2).collect()}["others"] == 18
    with pytest.raises(ValueError, match="unknown chart"):
        api.chart(rows, "pie")


def test_leads_and_consumption(spark, rows):
    done = rows.where("case = 'c19'").select("case")
    got = api.leads(rows, done, level="pre", least=0.5, size=3).collect()
    assert [r.case for r in got] == ["c17", "c16", "c14"]
    asked = spark.createDataFrame([("c19",), ("c01",), ("c01",), ("zz",)], "case string")
    assert tuple(api.consume(rows, asked, done).first()) == (1, 1, 1)
    assert api.leads(rows, done, public=F.col("court") == "TJMG").count() == 10
