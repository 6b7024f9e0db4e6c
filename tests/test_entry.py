"""Registered queries against their SQL at the smallest scale."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

TRACKING = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", TRACKING)
def test_query_matches_sql(spark, sf_dir, con, name):
    df = entry.queries()[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    want = rows([d[0] for d in cur.description], cur.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in cur.description) and got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 16


def test_stateful_queries(spark, sf_dir):
    slots = entry.queries()["player_slots"](spark, sf_dir)
    assert slots.groupBy("match_id", "frame_num", "player_id").count().where("count > 1").isEmpty() and slots.count() > 3000
    assert entry.queries()["analysis_document"](spark, sf_dir).where("document like '%player_1%'").count() == 4
