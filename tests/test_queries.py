"""Every registered query of the message engine against its SQL in DuckDB, and those without SQL against plain Python."""

import math
from pathlib import Path

import duckdb
import pytest

from chatloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([value(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(want.columns, want.fetchall())


def test_approximate_search_recall(spark):
    exact = {(r.query_id, r.vector_id) for r in registry.QUERIES["knn_cosine_topk"](spark, SF).collect()}
    near = {(r.query_id, r.vector_id) for r in registry.QUERIES["knn_lsh"](spark, SF).collect()}
    assert len(exact & near) / len(exact) >= 0.9
