"""Each stage on what its predecessor kept, against SQL or plain Python."""

import math
import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from chatloom.llm import sql
from chatloom.scratch import written

SF = "/root/testdata/sf0.001"


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def contaminated(rows, items):
    """Documents with a stretch as long as an item whose weighted shingle similarity to it is at least 0.8."""
    sets = [(shingles(words(t)), len(words(t))) for t in items]
    having = Counter(s for own, _ in sets for s in own)
    weight = lambda s: math.log(1 + (len(items) + 1) / (having[s] + 1))
    out = set()
    for d, text in rows:
        w = words(text)
        whole = shingles(w)
        for own, n in sets:
            if own & whole:
                for i in range(max(1, len(w) - n + 1)):
                    here = shingles(w[i : i + n])
                    both = sum(map(weight, own & here))
                    every = sum(map(weight, own)) + len(here - own) * math.log(1 + len(items) + 1)
                    if both and both >= 0.8 * every - 1e-9:
                        out.add(d)
    return out


def expected(name, before):
    documents = before.toArrow()
    con = duckdb.connect()
    con.register("documents", documents)
    ids = [r[0] for r in con.sql("SELECT doc_id FROM documents").fetchall()]
    if name == "quality_rules":
        return [r[0] for r in con.sql(f"SELECT doc_id FROM ({sql.op1_quality_rules}) WHERE kept").fetchall()]
    if name == "ngram_jaccard_join":
        return [r[0] for r in con.sql(f"SELECT doc_id FROM ({sql.op2_ngram_jaccard_join}) WHERE doc_id = component_id").fetchall()]
    if name == "benchmark_decontamination":
        items = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
        return sorted(set(ids) - contaminated(con.sql("SELECT doc_id, text FROM documents").fetchall(), items))
    if name == "mix_sources":
        return [r[0] for r in con.sql(f"SELECT doc_id, unnest(range(starts)) FROM ({sql.op5_mix_sources})").fetchall()]
    return ids


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF), "test-pipeline")
        assert out.columns == (columns if name != "sharding" else [*columns, "shard", "slot"])
        assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(expected(name, docs)), name
        docs = out


@pytest.mark.parametrize("rows", [0, 3])
def test_small_tables(spark, rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(rows)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "test-pipeline")
    assert docs.count() <= 3 * rows


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    sizes = [sum(r.shard == s for r in rows) for s in range(16)]
    assert rows and max(sizes) - min(sizes) <= 1
