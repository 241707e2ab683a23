"""Queries over layers and files, against their SQL on the smallest tables."""

import os

import duckdb
import pytest

FOLDER = "/root/testdata/sf0.001"


def rows_of(rows):
    return sorted(tuple(f"{v:.6g}" if isinstance(v, float) else repr(v) for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_layer_queries_against_sql(spark):
    import gradewalk.plans.layers as layers
    from gradewalk.plans.registry import ORACLES, QUERIES

    con = duckdb.connect()
    for t in os.listdir(FOLDER):
        con.execute(f"create view {t.split('.')[0]} as select * from '{FOLDER}/{t}'")
    names = [n for n in QUERIES if n in vars(layers) and n in ORACLES and not n.startswith("hub_")]
    assert len(names) > 40
    for name in names:
        got = QUERIES[name](spark, FOLDER)
        columns = sorted(got.columns)
        wanted = con.sql(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall()
        assert rows_of(tuple(r) for r in got.select(*columns).collect()) == rows_of(wanted), name
