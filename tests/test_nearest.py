"""The block-wise exact search against all pairs in plain Spark, and the digits of contexts."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chatloom.operators import nearest as nearest_module
from chatloom.operators import rag, search
from chatloom.sources import tables


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_small_blocks_find_what_all_pairs_do(spark, monkeypatch, metric):
    """Copies, zero and broken vectors, filters of every kind, in blocks and steps of a few rows."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(nearest_module, "LEAST_ROWS", 37)
    vectors = [[float(np.float32(x)) for x in rng.normal(size=9)] for _ in range(400)]
    for i in range(0, 400, 4):
        vectors[i] = vectors[i % 16]
    vectors[5], vectors[6], vectors[7], vectors[9] = [0.0] * 9, None, [1.0, None] + [0.0] * 7, [float("nan")] * 9
    rows = [(f"v{i:03d}", f"o{i % 2}", v, ["a", "b", None][i % 3], None if i % 11 == 0 else i) for i, v in enumerate(vectors)]
    chunks = spark.createDataFrame(rows, "vector_id string, owner_id string, embedding array<float>, kind string, at bigint").repartition(5)
    asked = [(i, f"o{i % 3}", vectors[i * 3], i % 7, "a" if i % 4 == 1 else None, [["b", "c"], None, ["a", "b"], []][i % 4], 50 if i % 5 == 0 else None, 300 if i % 6 == 0 else None) for i in range(60)]
    asks = spark.createDataFrame(asked, "query_id bigint, owner_id string, query_vector array<float>, first_k int, kind string, kinds array<string>, at_least bigint, at_most bigint")
    near = nearest_module.nearest(chunks.withColumn("kinds", F.col("kind")), asks, metric, ("kind",), ("kinds",), True, most=7, pairs=50)
    assert near.count() > 300
    sign = -1.0 if metric == "ip" else 1.0
    order = Window.partitionBy("query_id").orderBy(sign * F.col("distance"), "vector_id")
    ranked = lambda df: df.withColumn("place", F.row_number().over(order)).join(asks.select("query_id", "first_k"), "query_id").where("place <= first_k")
    c, q = chunks.where(nearest_module.usable("embedding")).alias("c"), asks.where(nearest_module.usable("query_vector")).alias("q")
    met = F.expr("c.owner_id = q.owner_id AND (q.kind IS NULL OR c.kind = q.kind) AND (q.kinds IS NULL OR array_contains(q.kinds, c.kind)) AND (q.at_least IS NULL OR c.at >= q.at_least) AND (q.at_most IS NULL OR c.at <= q.at_most)")
    pairs = c.join(q, met).select("query_id", "vector_id", F.round(search.distance(F.col("embedding"), F.col("query_vector"), metric), 9).alias("distance"))
    got, want = ({(r.query_id, r.place): (r.vector_id, round(r.distance, 8)) for r in ranked(df).collect()} for df in (near, pairs))
    assert got == want and len(want) > 50


def test_buckets_find_what_a_join_on_buckets_does(spark, monkeypatch):
    """The best of the pairs that share a bucket, also where few do; none of them a row of a join."""
    monkeypatch.setattr(nearest_module, "LEAST_ROWS", 41)
    rng = np.random.default_rng(8)
    vectors = [[float(np.float32(x)) for x in rng.normal(size=8)] for _ in range(300)]
    chunks = spark.createDataFrame([(f"v{i:03d}", f"o{i % 2}", "x", False, v) for i, v in enumerate(vectors)], "vector_id string, owner_id string, source string, is_deleted boolean, embedding array<float>")
    queries = spark.createDataFrame([(i, f"o{i % 2}", vectors[i]) for i in range(0, 300, 9)], "query_id bigint, owner_id string, query_vector array<float>")
    got = search.knn_lsh(chunks, queries, k=4, dim=8, tables=3, bits=6)
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()
    c = search.lsh_buckets(chunks.select("vector_id", "owner_id", "embedding"), "embedding", 8, 3, 6, 7).alias("c")
    q = search.lsh_buckets(queries, "query_vector", 8, 3, 6, 7).alias("q")
    met = c.join(q, F.expr("c.owner_id = q.owner_id AND arrays_overlap(c.buckets, q.buckets)")).select("query_id", "vector_id", F.round(search.distance(F.col("embedding"), F.col("query_vector"), "cosine"), 9).alias("distance"))
    want = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vector_id"))).where("rank <= 4")
    found = {(r.query_id, r["rank"]): r.vector_id for r in got.collect()}
    assert found == {(r.query_id, r["rank"]): r.vector_id for r in want.collect()} and 60 < len(found) < 136


def test_pairs_are_never_sorted(spark):
    """No sort or window lies on the join of chunks with queries: what is ranked comes out of the blocks."""
    sf = "/root/testdata/sf0.001"
    queries = tables.query_vectors(spark, sf).select("query_id", "owner_id", "query_vector", "top_k")
    plan = search.knn(tables.chunks(spark, sf), queries)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "zip_with" not in plan
    assert "NestedLoop" not in plan


def test_context_digits_are_those_of_sql(spark):
    numbers = [i / 1_000_000 for i in range(50, 1_000_000, 100)] + [None]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    assert [r[0] for r in df.select(rag.four_digits("x")).collect()] == [None if x is None else f"{x:.4f}" for x in numbers]
