"""Stored embeddings are found by id and digest; old texts don't go to the join."""

from pyspark.sql import functions as F

from chatloom.operators import sync


def test_reuse_by_digest(spark):
    old = spark.createDataFrame([("v1", "same", [1.0]), ("v2", "before", [2.0]), ("v3", None, [3.0])], "vector_id string, text string, embedding array<float>")
    new = spark.createDataFrame([("v1", "same"), ("v2", "after"), ("v3", None), ("v4", "same")], "vector_id string, text string")
    found = sync.reuse_embeddings(new, old)
    assert found.columns == ["vector_id", "text", "embedding"]
    assert {r.vector_id: r.embedding for r in found.collect()} == {"v1": [1.0], "v2": None, "v3": None, "v4": None}
    join = next(x for x in sync.reuse_embeddings(new, old).select("vector_id", F.col("embedding").isNotNull())._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x)
    assert "o_key" in join and "text" not in join
