"""Registered queries against their SQL in DuckDB, on small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: The graph of customers is dense on the smallest tables, so its SQL would not end; the next larger tables have a sparse one.
SPARSE = {"edge_betweenness", "connected_components", "modularity", "label_propagation", "graph_edges", "graph_vertices", "graph_degree", "frequent_itemsets_by_item"}
NAMES = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    def over(folder):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        return con

    return {d: over(d) for d in (DATA, LARGER)}


def plain(rows):
    return sorted(tuple(f"{v + 0.0:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    data = LARGER if name in SPARSE else DATA
    df = entry.queries()[name](spark, data)
    columns = sorted(df.columns)
    found = duck[data].execute(entry.oracle_sql()[name])
    there = [c[0] for c in found.description]
    assert sorted(there) == columns
    want = [tuple(r[there.index(c)] for c in columns) for r in found.fetchall()]
    assert plain(df.select(*columns).collect()) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["a", "b", "sim"]
