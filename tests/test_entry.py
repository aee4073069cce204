"""Every query has rows on the smallest tables, and equals its SQL."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from rimward import centrality
from rimward.storage import tables_dir

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
BASE = [q for q in entry.queries() if not q.startswith("op") and q != "pipeline"]


def same(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(value, 6) + 0.0 if isinstance(value, float) else value


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["flow_from_edgelist", "clustering"])
def test_a_query_whose_measure_fails_has_no_result(spark, monkeypatch, name):
    def fails(graph):
        raise ArithmeticError("no triangles")

    monkeypatch.setattr(centrality, "clustering", fails)
    with pytest.raises(ArithmeticError, match="no triangles"):
        entry.queries()[name](spark, DATA)


def test_the_flow_from_an_edge_list_writes_no_row_to_an_edge(spark):
    before = set(os.listdir(tables_dir(spark)))
    assert entry.queries()["flow_from_edgelist"](spark, DATA).count() == 20
    made = {name.rsplit("-", 1)[0] for name in set(os.listdir(tables_dir(spark))) - before}
    assert "edge-blocks" in made and not made & {"edges", "both-ways", "oriented"}


@pytest.mark.parametrize("name", BASE)
def test_query_equals_its_sql(spark, name):
    frame = entry.queries()[name](spark, DATA)
    names = sorted(frame.columns)
    got = sorted(([same(v) for v in r] for r in frame.select(*names).collect()), key=str)
    assert got
    sql = entry.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for file in os.listdir(DATA):
            path = f"{DATA}/{file}"
            con.execute(f"CREATE VIEW {file.split('.')[0]} AS FROM read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
        want = sorted(([same(v) for v in r] for r in con.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()), key=str)
        assert got == want
