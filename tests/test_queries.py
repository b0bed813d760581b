"""Every query with SQL, on the smallest tables."""

import os

import pandas as pd
import pytest

from hopweave.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SLOW = {"pr_residual", "pr_iterations", "pr_data_driven", "bfs_chain"}  # as others, with more rounds


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("null" if pd.isna(v) else repr(round(float(v), 9)) if not isinstance(v, str) else v for v in r) for r in df.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry_without_training_data_operators():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_whole_queries(spark):
    edges = sorted(map(tuple, QUERIES["edge_list_scan"](spark, SF).collect()))
    got = QUERIES["edges_by_position"](spark, SF).orderBy("eid").collect()
    assert [(r["eid"], r["src"], r["dst"]) for r in got] == [(k, *e) for k, e in enumerate(edges)]
    level = {d for s, d in edges if s == 0} - {0}
    assert sorted(map(tuple, QUERIES["level_expand"](spark, SF).collect())) == [e for e in edges if e[0] in level]
    ranks = QUERIES["pr_topology"](spark, SF).toPandas()["p"]
    got = QUERIES["pr_sum_converged"](spark, SF).first()
    assert got["nodes"] == len(ranks) and abs(got["rank_sum"] - ranks.sum()) < 1e-3
