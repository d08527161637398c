"""Hard negatives against all pairs in plain Python, and the tree's bounds."""

import random
from pathlib import Path

import duckdb
import numpy as np
import pytest

from chatloom.llm import hard_negatives as op
from chatloom.llm import registry

SCHEMA = "vec_id bigint, label string, vector array<double>, class string, leaf int, code string, score int"


def plain(rows, every):
    """All pairs, without blocks, bounds or classes."""
    kept = {}
    for vec_id, label, vector in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not np.isfinite(x) or abs(np.floor(256 * x)) > op.LARGEST for x in vector):
            continue
        kept[vec_id, label, tuple(int(np.floor(256 * x)) for x in vector)] = 1
    dim = max((len(v) for _, _, v in kept), default=0)
    kept = [(i, label, v + (0,) * (dim - len(v))) for i, label, v in kept]
    out = []
    for a, label, v in kept:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, u, strict=True)), i, other) for i, other, u in kept if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][: op.POSITIVES]:
            fits = [x for x in scored if x[2] != label and op.LEAST * -s <= 100 * -x[0] <= op.MOST * -s][: op.NEGATIVES]
            out += [(a, p, r, x[1], -s, -x[0]) for r, x in enumerate(fits, 1)]
    return sorted(out)


def found(spark, rows, every):
    wide = [(*r, "x", 1, "y", 2) for r in rows]
    return sorted(map(tuple, op.hard_negatives(spark.createDataFrame(wide, SCHEMA).repartition(5), every).collect()))


def clustered(n, seed, centres=7, spread=0.05, dim=8):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    which = rng.integers(0, centres, n)
    return [(i, f"l{(w + (i % 7 == 0)) % 5}", [float(x) for x in middle[w] + spread * rng.normal(size=dim)]) for i, w in enumerate(which)]


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_against_all_pairs(spark, monkeypatch, spread):
    """Small leaves and blocks, so that nodes of several levels, several blocks of rows and of queries take part."""
    for name, value in (("LEAF_ROWS", 24), ("FAN_OUT", 4), ("BLOCK_ROWS", 10), ("BLOCK_QUERIES", 3)):
        monkeypatch.setattr(op, name, value)
    rows = clustered(400, 1, spread=spread)
    want = plain(rows, 10)
    assert found(spark, rows, 10) == want and len(want) > 100


def test_awkward_rows(spark):
    rng = random.Random(3)
    rows = clustered(120, 2)
    same = rows[0][2]
    rows += [(1000 + i, "l1" if i % 3 else "l2", same) for i in range(90)]  # one vector many times, by two labels: ties
    rows += [(1000, "l2", same)] * 5 + [(7, "l9", same), (7, None, same)]  # repeated rows, one id twice
    rows += [(None, "l1", same), (3000, "l1", None), (3050, "l1", [1.0, None] + [0.0] * 6), (3100, "l1", [float("nan")] * 8), (3150, "l1", [float("inf")] * 8), (3200, "l1", [1e30] * 8)]
    rows += [(4000, "l1", []), (4050, "l2", [1.0, 2.0]), (4100, "lonely", [9.0] * 8), (4150, "l1", [60000.0] * 8), (4151, "l2", [50000.0] * 8), (4152, "l1", [59000.0] * 8)]
    rng.shuffle(rows)
    assert found(spark, rows, 10) == plain(rows, 10)


def test_empty(spark):
    assert found(spark, [], 10) == [] and found(spark, [(10, "a", None)], 10) == [] and found(spark, [(10, "a", [1.0])], 10) == []


def test_bounds_eliminate_and_lose_nothing():
    """On clustered rows most leaves are passed over; none that holds a row of the window is."""
    rows = clustered(4000, 5, centres=40)
    x = np.floor(256 * np.array([r[2] for r in rows]))
    nodes, leaves = op.fitted(x[::3], 40000)
    leaf = np.zeros(len(x), int)
    for n in nodes:
        m = len(n.points)
        n.near, n.far, n.short, n.long = np.full((m, m), np.inf), np.full((m, m), -np.inf), np.full(m, np.inf), np.full(m, -np.inf)
    for k, at, away, child in op._descent(nodes, x):
        n = nodes[k]
        for j in np.unique(child):
            own = away[child == j]
            n.near[:, j], n.far[:, j] = own.min(0), own.max(0)
            norms = np.linalg.norm(x[at][child == j], axis=1)
            n.short[j], n.long[j] = norms.min(), norms.max()
        to = np.array(n.children)[child]
        leaf[at[to < 0]] = ~to[to < 0]
    q = x[:200]
    scores = q @ x.T
    own = (q * q).sum(1)[:, None]
    lows, highs = 0.9 * own, 0.97 * own
    seen = {(t, i) for t, at in op.surviving(nodes, q, lows, highs) for i in at}
    need = {(leaf[j], i) for i, j in zip(*np.nonzero((scores >= lows) & (scores <= highs)), strict=True)}
    assert need and need <= seen
    assert len(seen) < 0.5 * leaves * len(q)


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = registry.QUERIES["op13_hard_negatives"](spark, sf)
    want = con.sql(registry.ORACLE_SQL["op13_hard_negatives"])
    assert df.columns == want.columns
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())
