"""Stored tables: only touched buckets are read and written, batches are all or nothing."""

import random

import pytest
from pyspark.sql import functions as F

from chatloom.operators.stored import Store, latest_by
from chatloom.scratch import new_folder

TABLES = {"t": ("id string, seq bigint, a string, b string", ("id",)), "u": ("id string, n bigint", ("id",))}
LOGS = {"log": ("id string, what string", ("id",))}


@pytest.fixture
def store(spark):
    return Store(spark, new_folder(spark, "store"), TABLES, LOGS, buckets=32)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, seq bigint, a string, b string")


def test_upserts_and_deletes_against_a_dict(spark, store):
    rng = random.Random(1)
    want: dict = {}
    for batch in range(5):
        rows = [(f"k{rng.randrange(60)}", batch * 10 + rng.randrange(10) - (7 if rng.random() < 0.2 else 0), rng.choice([None, f"a{batch}"]), f"b{batch}") for _ in range(25)]
        rows = list({r[0]: r for r in rows}.values())
        store.upsert("t", frame(spark, rows), batch, latest_by(["id"], "seq", keep_old_values=True))
        store.append("log", frame(spark, rows).select("id", F.lit(f"batch {batch}").alias("what")), batch)
        for i, seq, a, b in rows:
            old = want.get(i)
            if old is None or seq >= old[0]:
                want[i] = (seq, a if a is not None or old is None else old[1], b)
        store.commit(batch)
    gone = [f"k{i}" for i in range(0, 80, 3)]
    asked, deleted = store.delete("t", spark.createDataFrame([(g,) for g in gone], "id string"), 5)
    store.commit(5)
    assert (asked, deleted) == (len(gone), sum(g in want for g in gone))
    want = {k: v for k, v in want.items() if k not in gone}
    assert {r.id: tuple(r)[1:] for r in store.read("t").collect()} == want
    assert store.read_log("log").count() == sum(r["count"] for r in store.read_log("log").groupBy("what").count().collect()) > 60
    store.vacuum()
    assert {r.id: tuple(r)[1:] for r in store.read("t").collect()} == want


def test_an_upsert_reads_and_writes_the_buckets_of_its_keys(spark, store):
    store.upsert("t", spark.range(2000).select(F.concat(F.lit("k"), "id").alias("id"), F.lit(1).alias("seq"), F.lit("a").alias("a"), F.lit("b").alias("b")), 0)
    store.commit(0)
    rows = frame(spark, [(f"k{i}", 2, "new", "new") for i in range(0, 2000, 100)][:6])  # well under 1 % of the keys
    buckets = store.upsert("t", rows, 1)
    store.commit(1)
    assert len(buckets) <= 6
    seen = store.read("t")
    new = {f.rpartition("/")[0].rpartition("/")[2] for f in seen.inputFiles() if "batch=1/" in f}
    assert new == {f"bucket={b}" for b in buckets}
    assert all(f"bucket={b}/" in f for f in store.read("t", buckets, before=1).inputFiles() for b in [int(f.rpartition("/bucket=")[2].split("/")[0])] if b in buckets)
    assert {f.rpartition("/bucket=")[2].split("/")[0] for f in store.read("t", buckets, before=1).inputFiles()} == {str(b) for b in buckets}
    assert seen.count() == 2000 and seen.where("seq = 2").count() == 6


def test_a_batch_is_all_or_nothing(spark, store):
    store.upsert("t", frame(spark, [("x", 1, "a", "b")]), 0)
    store.upsert("u", spark.createDataFrame([("x", 1)], "id string, n bigint"), 0)
    store.commit(0)
    add = lambda old, new: old.unionByName(new).groupBy("id").agg(F.sum("n").alias("n"))
    one = spark.createDataFrame([("x", 1), ("y", 1)], "id string, n bigint")
    store.upsert("u", one, 1, add)  # and then the writer dies
    again = Store(spark, store.root, TABLES, LOGS, buckets=32)
    assert [tuple(r) for r in again.read("u").collect()] == [("x", 1)] and not again.is_committed(1)
    again.upsert("u", one, 1, add)
    again.upsert("t", frame(spark, [("x", 2, "c", None)]), 1)
    again.commit(1)
    assert sorted(map(tuple, again.read("u").collect())) == [("x", 2), ("y", 1)]
    assert [tuple(r) for r in again.read("t").collect()] == [("x", 2, "c", None)]
    assert sorted(map(tuple, again.read("u", before=1).collect())) == [("x", 1)]
    with pytest.raises(ValueError, match="once"):
        again.upsert("u", one, 2, add)
        again.upsert("u", one, 2, add)


def test_a_bucket_without_rows(spark, store):
    store.upsert("u", spark.createDataFrame([("x", 1)], "id string, n bigint"), 0)
    store.commit(0)
    assert store.delete("u", spark.createDataFrame([("x",), ("nobody",)], "id string"), 1) == (2, 1)
    store.commit(1)
    assert store.read("u").collect() == [] and store.read("t").collect() == [] and store.read_log("log").collect() == []


def test_cached_texts_are_not_dealt_out(spark, monkeypatch):
    """A run writes digests and vectors, no texts, and embeds each missing text once; what it returns is as before."""
    from chatloom.operators import embed, embed_cache
    from chatloom.scratch import new_folder
    from chatloom.scratch import written as write

    wrote = {}

    def noted(df, label):
        wrote.setdefault(label, []).append(write(df, label))
        return wrote[label][-1]

    monkeypatch.setattr(embed_cache, "written", noted)
    store = Store(spark, new_folder(spark, "cache"), embed_cache.TABLE, buckets=4)
    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, " "), (4, None), (5, "c")], "id bigint, text string")
    load = lambda: embed.hashing_embedder(8)
    for batch, some, did in ((0, rows.where("id < 5"), (1, 0)), (2, rows, (1, 1)), (4, rows, (0, 2))):
        out, got = embed_cache.run(store, some, load, 8, batch, most=9)
        assert (got["misses"], got["hits"]) == did
        want = embed.embed(some, load, 8)
        assert sorted(map(repr, out.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    assert all("text" not in df.columns for made in wrote.values() for df in made)
