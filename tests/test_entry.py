import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from lexigram.plans import catalogue, stored  # noqa: F401  (stored adds queries to the catalogue)

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    rows = entry_point.entry(spark).collect()
    assert rows and all(r["t1"].startswith("th") and r["count"] >= 2 for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    want = con.sql(catalogue.ORACLE_SQL[name])
    got = catalogue.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, want.select(*[f'"{c}"' for c in columns]).fetchall()))


def test_names_agree():
    assert set(catalogue.ORACLE_SQL) == set(catalogue.QUERIES) <= set(entry_point.queries())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
