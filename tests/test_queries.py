import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from accordia.plans.reports import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels conversations benchmark"


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0 if math.isfinite(v) else str(v)
    return str(v) if isinstance(v, datetime.date) else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_gives_the_same(spark, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    cur = con.execute(ORACLE[name])
    columns = sorted(c[0] for c in cur.description)
    at = [[c[0] for c in cur.description].index(c) for c in columns]
    want = sorted(str([plain(r[i]) for i in at]) for r in cur.fetchall())
    df = QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == columns
    assert sorted(str([plain(r[c]) for c in columns]) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.isdir(SMALL)
