"""Every query with a SQL twin against DuckDB at the smallest scale."""

import math
import os

import duckdb
import pandas as pd
import pytest

from tidemark.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{DATA}/{f}')")
    return con


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "item"):
        x = x.item()
    return round(float(x), 5) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(([plain(v) for v in r] for r in df.astype(object).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_twin(spark, duck, name):
    mine, theirs = catalogue.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


LARGE = DATA.replace("sf0.001", "sf0.1")  # the smallest scale has no account with enough chunks
NETWORKS = ["e3_undirected_edges", "e3_sparse_edges", "e3_directed_edges", "e3_contemporaneous_edges"]


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES) - set(NETWORKS)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, LARGE if name == "variance_record" else DATA).count() > 0


@pytest.mark.parametrize("name", NETWORKS)
def test_networks_of_ratings(spark, name):
    got = catalogue.QUERIES[name](spark, LARGE).toPandas()
    assert len(got) and (got.groupby("account_hash").size() == 40 * 39).all() and got.weight.notna().all() and not (got.src == got.dep).any()
    if name != "e3_directed_edges":
        m = got.set_index(["account_hash", "src", "dep"]).weight
        back = got.set_index(["account_hash", "dep", "src"]).weight.rename_axis(["account_hash", "src", "dep"])
        assert ((m - back).abs() < 1e-6).all() and (m.abs() <= 1 + 1e-9).all()
