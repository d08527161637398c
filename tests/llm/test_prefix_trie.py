"""The prefix trie against a plain one built turn by turn."""

import hashlib
import random
import re
import zlib
from pathlib import Path

import duckdb
import pytest

from chatloom.llm import prefix_trie as op
from chatloom.llm import registry

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, node int, weight string, place int, k1 string"


def plain(rows):
    """A dict of dicts, totals by recursion from the deepest node up."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in own.items():
        turns.sort(key=lambda t: (t[:2], hashlib.sha256(f"{len(t[2])}:{t[2]}{t[3]}".encode()).hexdigest()))
        own[conv] = [t[2:] for t in turns]
    members = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        rest = abs(conv) % 20 * (1 if conv >= 0 else -1)
        seq = own.get(conv - rest, [])[:h] + turns[h:]
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append((conv, d == len(seq)))
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        below = [totals[c] for c in children.get(node, [])]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        totals[node] = sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(members[node]) - 1) * words
    out = []
    for node, own_members in members.items():
        ends = ",".join(str(c) for c, end in sorted(own_members) if end)
        parent = min(c for c, _ in members[node[:-1]]) if node else None
        out.append((min(c for c, _ in own_members), len(node), parent, len(own_members), len(children.get(node, [])), *totals[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def found(spark, rows):
    wide = [(*r, "x", 1, "y", 2, "z") for r in rows]
    return sorted(map(tuple, op.prefix_trie(spark.createDataFrame(wide, SCHEMA).repartition(5)).collect()), key=lambda r: r[:2])


def conversations(n, seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(-30, n):
        if rng.random() < 0.2:
            continue
        for turn in range(rng.choice([1, 2, 4, 9])):
            rows.append((conv, turn, rng.choice(["user", "assistant"]), rng.choice(["", "yes", "no  more", "a\tb\nc"])))
    return rows


def test_long_and_equal_conversations_in_rounds(spark, monkeypatch):
    """Tiny limits, so that rounds over large components, blocks of a long conversation and several texts of ids take part."""
    monkeypatch.setattr(op, "LOCAL", 5)
    monkeypatch.setattr(op, "BLOCK", 7)
    monkeypatch.setattr(op, "IDS", 16)
    rows = conversations(150, 1)
    rows += [(1000 + i, t, "user", f"turn {t}") for i in range(40) for t in range(6)]  # equal but for what they take over
    rows += [(2001, t, "user", "go on" if t % 2 else f"step {t}") for t in range(60)]
    rows += [(2003, t, "user", "go on" if t % 2 else f"step {t}") for t in range(45)]
    assert found(spark, rows) == plain(rows)


def test_awkward_rows(spark):
    rows = conversations(60, 2)
    rows += [(None, 1, "user", "of nobody"), (7, None, None, None), (7, None, "", "x"), (9, 1, None, "y"), (9, 1, "user", "same"), (9, 1, "user", "same"), (9, 1, "user", "same")]
    rows += [(41, 0, "a", "b:c"), (61, 0, "a:b", "c"), (5000, 0, "user", "word " * 50000), (5001, 0, "user", "word " * 50000), (5021, 0, "user", "")]
    assert found(spark, rows) == plain(rows)


def test_no_conversations(spark):
    assert found(spark, []) == [] and found(spark, [(None, 1, "user", "x")]) == []


@pytest.mark.parametrize("seed", range(5))
def test_decomposition(seed):
    """Totals of random forests, chains and stars against sums from the leaves up."""
    rng = random.Random(seed)
    n = 300
    parent = [-1 if v == 0 or rng.random() < 0.02 else v - 1 if seed == 1 else max(0, v // 20 * 20 - 20) if seed == 2 else rng.randrange(v) for v in range(n)]
    own = [[rng.randrange(9) for _ in range(n)] for _ in range(2)]
    want = [list(x) for x in own]
    for v in range(n - 1, -1, -1):
        if parent[v] >= 0:
            for w in want:
                w[parent[v]] += w[v]
    assert op._decomposed(parent, own) == want


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = registry.QUERIES["op12_prefix_trie"](spark, sf)
    want = con.sql(registry.ORACLE_SQL["op12_prefix_trie"])
    assert df.columns == want.columns
    key = lambda r: r[:2]
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want.fetchall(), key=key)
