"""The inverted-file index against exact search: recall, and how little is looked at."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatloom.operators import search
from chatloom.operators import vector_index as vi
from chatloom.scratch import new_folder
from chatloom.sources import tables


def share(spark, index, queries):
    """Of all rows within the scope of the queries, the share compared by codes and the share compared by vectors."""
    rows = index.rows(spark).where(search.not_deleted()).alias("c")
    pairs = rows.join(queries.alias("q"), search.scope(queries) & search.in_time(queries)).count()
    looked = rows.join(queries.join(vi.probes(index, queries), "query_id").alias("q"), (F.col("c.cell") == F.col("q.cell")) & search.scope(queries) & search.in_time(queries)).count()
    return looked / pairs, vi.candidates(index, queries).count() / pairs


def found(hits):
    return {(r.query_id, r.vector_id) for r in hits.collect()}


@pytest.mark.parametrize("scoped", [False, True])
def test_recall_on_all_queries(spark, scoped):
    """Vectors without clusters, so most cells have to be looked at; less than a tenth of the pairs is compared by vectors."""
    sf = "/root/testdata/sf0.1"
    chunks = tables.chunks(spark, sf)
    queries = tables.query_vectors(spark, sf).select("query_id", "owner_id", "query_vector", "top_k", *(["source", "time_from", "time_to"] if scoped else []))
    assert queries.count() == 100
    index = vi.build(chunks, new_folder(spark, "index"))
    exact, near = found(search.knn(chunks, queries)), found(vi.search(index, queries))
    assert len(exact & near) / len(exact) >= 0.9
    assert index.rows(spark).count() == chunks.count()
    if not scoped:
        assert share(spark, index, queries)[1] < 0.1


def clustered(spark, n=3000, centres=60, dim=18):
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(centres, dim))
    x = middle[rng.integers(0, centres, n)] + 0.1 * rng.normal(size=(n, dim))
    rows = [(f"v{i}", "o1" if i % 3 else "o2", "telegram", i % 50 == 0, f"text {i}", [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [("null", "o1", "telegram", False, "t", None), ("part", "o1", "telegram", False, "t", [1.0, None] * 9), ("zero", "o1", "telegram", False, "t", [0.0] * dim), ("nan", "o1", "telegram", False, "t", [float("nan")] * dim)]
    return spark.createDataFrame(rows, "vector_id string, owner_id string, source string, is_deleted boolean, text string, embedding array<float>").repartition(4)


def test_clusters_leave_little_to_look_at(spark):
    chunks = clustered(spark)
    usable = vi.indexable(chunks)
    asked = usable.where(F.substring("vector_id", 2, 9).cast("int") % 20 == 0).select(F.substring("vector_id", 2, 9).cast("bigint").alias("query_id"), "owner_id", F.col("embedding").alias("query_vector"), F.lit(5).alias("top_k"))
    none = spark.createDataFrame([(-1, "o1", None, 5)], "query_id bigint, owner_id string, query_vector array<float>, top_k int")
    index = vi.build(chunks, new_folder(spark, "index"))
    again = vi.load(spark, index.path)
    assert np.array_equal(again.centroids, index.centroids) and np.array_equal(again.codebooks, index.codebooks)
    near = found(vi.search(again, asked.union(none)))
    exact = found(search.knn(usable, asked))
    assert len(exact & near) / len(exact) >= 0.9 and not {i for q, i in near if q == -1 or i in ("null", "part", "zero", "nan")}
    looked, compared = share(spark, index, asked)
    assert looked < 0.15 and compared < 0.1
    assert index.rows(spark).count() == 3000


def test_few_or_no_vectors(spark):
    chunks = clustered(spark)
    assert vi.build(chunks.where("vector_id = 'null'"), new_folder(spark, "index")) is None
    one = chunks.where("vector_id = 'v1'")
    index = vi.build(one, new_folder(spark, "index"))
    queries = one.select(F.lit(1).cast("bigint").alias("query_id"), "owner_id", F.col("embedding").alias("query_vector"), F.lit(3).alias("top_k"))
    assert [tuple(r) for r in vi.search(index, queries).collect()] == [(1, "v1", 1.0, 1)]


def test_other_searches_pass_over_broken_vectors(spark):
    chunks = clustered(spark).where("vector_id IN ('v1', 'v4', 'null', 'part')")
    queries = spark.createDataFrame([(1, "o1", [1.0] * 18, 2), (2, "o1", None, 2)], "query_id bigint, owner_id string, query_vector array<float>, top_k int")
    assert {r.vector_id for r in search.knn_by_matrix(chunks, queries, k=5).collect()} == {"v1", "v4"}
    assert {r.query_id for r in search.knn_lsh(chunks, queries, dim=18).collect()} <= {1}


def test_each_meeting_of_blocks_keeps_only_what_can_come_first(spark):
    """Candidates are those of all pairs in looked-at cells, however few pairs are looked at at once, and no pair beyond them is given to the ranking."""
    chunks = clustered(spark)
    asked = vi.indexable(chunks).where(F.substring("vector_id", 2, 9).cast("int") % 20 == 0).select("vector_id", "owner_id", F.col("embedding").alias("query_vector"), F.lit(2).alias("top_k")).withColumn("query_id", F.substring("vector_id", 2, 9).cast("bigint")).drop("vector_id")
    index = vi.build(chunks, new_folder(spark, "index"))
    rows = {r.vector_id: r for r in index.rows(spark).where(search.not_deleted()).collect()}
    cells, vectors = {}, {r.query_id: r for r in asked.collect()}
    for r in vi.probes(index, asked).collect():
        cells.setdefault(r.query_id, set()).add(r.cell)

    def estimate(q, row):
        own = np.concatenate([index.codebooks[p][c] for p, c in enumerate(row.code)])[:18] + index.centroids[row.cell]
        x = np.array(q.query_vector, float)
        return round(float(own @ x / np.linalg.norm(own) / np.linalg.norm(x)), 12)

    wanted = {}
    for i, q in vectors.items():
        near = sorted(((-estimate(q, r), v) for v, r in rows.items() if r.owner_id == q.owner_id and r.cell in cells[i]))
        wanted[i] = [-e for e, _ in near[: 2 * vi.RERANK]]
    for options in ({}, {"pairs": 500, "most": 7}):
        got = {}
        for r in vi.candidates(index, asked, **options).collect():
            got.setdefault(r.query_id, []).append(round(r.estimate, 12))
        assert set(got) == set(wanted) and all(np.allclose(sorted(got[i], reverse=True), wanted[i], rtol=0, atol=1e-9) for i in wanted)
