import zlib
from pathlib import Path

import duckdb

from chatloom.llm import mixing, queries, sharding, sql


def test_shards_hold_every_row_once_and_evenly(awkward, nothing):
    rows = sharding.shard_documents(awkward, bucket_bytes=2000).collect()
    assert sorted(map(str, (tuple(r)[:-2] for r in rows))) == sorted(map(str, map(tuple, awkward.collect())))
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(i, [])) for i in range(sharding.SHARDS)]
    assert max(sizes) - min(sizes) <= 1
    assert sharding.shard_documents(nothing).count() == 0


def test_order_is_shuffled_and_depends_on_the_seed(spark):
    df = spark.createDataFrame([(i, "text") for i in range(2000)], "doc_id bigint, text string")
    order = lambda seed: [r.doc_id for r in sorted(sharding.shard_documents(df, shards=1, bucket_bytes=1000, seed=seed).collect(), key=lambda r: r.slot)]
    a, b = order(1), order(2)
    assert sorted(a) == sorted(b) == list(range(2000)) and a != b
    moved = sum(abs(x - i) for i, x in enumerate(a)) / 2000
    assert 500 < moved < 850  # a random order moves a row by a third of the length


def test_reruns_agree_however_the_input_is_split(awkward):
    place = lambda df: sorted((str(tuple(r)[:-2]), r.shard, r.slot) for r in sharding.shard_documents(df, bucket_bytes=20000).collect())
    assert place(awkward) == place(awkward.repartition(3).sortWithinPartitions("text"))


def test_written_shards(spark, awkward, tmp_path):
    sharding.write_shards(awkward, str(tmp_path / "out"), shards=4)
    assert sorted(p.name for p in Path(tmp_path / "out").glob("shard=*")) == [f"shard={i}" for i in range(4)]
    assert spark.read.parquet(str(tmp_path / "out")).count() == awkward.count()


def test_query_columns(spark):
    rows = queries.op3_sharding(spark, "/root/testdata/sf0.001").collect()
    want = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in want)
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)} and len({(r.shard, r.slot) for r in rows}) == len(rows)
    t = "é" * 10
    df = spark.createDataFrame([(1, t)], "doc_id bigint, text string")
    from pyspark.sql import functions as F

    assert df.select(F.crc32("text").alias("c"), sharding.stored_size(F.col("text")).alias("s")).first().asDict() == {"c": zlib.crc32(t.encode()), "s": 21}


def expected_targets(sizes):
    total, weights = sum(s for _, s in sizes), {}
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weights = {n: (5, 2, 1)[i % 3] for i, (n, _) in enumerate(order)}
    caps, fixed = {n: 3 * s for n, s in sizes}, {}
    while True:
        left, w = total - sum(fixed.values()), sum(weights[n] for n in weights if n not in fixed)
        over = [n for n in weights if n not in fixed and left * weights[n] / w > caps[n]] if w else []
        if not over:
            return {n: fixed.get(n, left * weights[n] / w if w else 0) for n in weights}
        fixed |= {n: caps[n] for n in over}


def test_mix_laws(awkward, nothing):
    rows = mixing.mixed(awkward).collect()
    assert len(rows) == awkward.count() and mixing.mixed(nothing).count() == 0
    sizes, taken = {}, {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    want = expected_targets(list(sizes.items()))
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    for s, t in taken.items():
        assert abs(t - want[s]) < 1
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mixed(awkward.repartition(3)).collect()))


def test_a_tiny_source_beside_a_huge_one_meets_its_target(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('word ', 3000) AS text", "'a' AS source")
    tiny = spark.range(5).selectExpr("id + 5000 AS doc_id", "repeat('word ', id + 3) AS text", "'b' AS source")
    rows = mixing.mixed(docs.union(tiny)).where("source = 'b'").collect()
    assert sum(r.size for r in rows) == 25 and {r.target for r in rows} == {75.0}
    assert all(r.taken == 3 * r.size and r.starts == 3 for r in rows)


def test_the_schedule_spreads_every_source(spark):
    targets = spark.createDataFrame([(1, 1000), (2, 600_000), (3, 399_000)], "source_no int, words bigint")
    slots = {}
    for r in mixing.slot_takes(targets, 1 << 14).orderBy("slot").collect():
        slots.setdefault(r.source_no, []).append(r.slot)
        assert r.block == len(slots[r.source_no]) - 1
    assert sorted(x for s in slots.values() for x in s) == list(range(1 << 14))
    for s in slots.values():  # no stretch of the mix goes without a source for long
        gaps = [b - a for a, b in zip(s, s[1:])]
        assert max(gaps) <= 3 * (1 << 14) / len(s) + 1


def test_mix_against_sql(spark, awkward):
    documents = awkward.toArrow()  # noqa: F841
    want = duckdb.sql(sql.op5_mix_sources).fetchall()
    got = mixing.mixed(awkward).select("doc_id", "size", "source_size", "target", "taken", "source", "starts", "first_slot").collect()
    shorten = lambda rows: sorted(str((*r[:3], round(r[3], 6), *r[4:])) for r in rows)
    assert shorten(map(tuple, got)) == shorten(want)


def test_mixed_documents_repeat_as_the_mix_says(awkward):
    out = mixing.mixed_documents(awkward)
    assert out.columns == awkward.columns
    want = {r.doc_id: r.starts for r in mixing.mixed(awkward).where("doc_id BETWEEN 100 AND 400").collect()}
    got = {r.doc_id: r["count"] for r in out.where("doc_id BETWEEN 100 AND 400").groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_many_tiny_sources_meet_their_targets(spark):
    """300,000 sources of one document each: slots grow with them, none is left out."""
    from pyspark.sql import functions as F

    n = F.col("id")
    df = spark.range(300_000).select(n.alias("doc_id"), F.concat(F.lit("s"), n).alias("source"), F.array_join(F.array_repeat(F.lit("w"), (n % 5 + 1).cast("int")), " ").alias("text"))
    found = mixing.mixed(df).select(F.floor(F.col("target") + 1e-6).alias("want"), "taken")
    assert found.where("want >= 1 AND taken = 0").isEmpty() and found.where("abs(taken - want) > 1").isEmpty() and found.count() == 300_000
    assert mixing.slots_for(3) == mixing.SLOTS and mixing.slots_for(300_000) == 1 << 22


def test_rows_alike_spread_over_buckets(spark):
    """A third of the rows repeat one row whole: they fill many buckets, and every row still comes out once."""
    from pyspark.sql import functions as F

    n = F.col("id")
    df = spark.range(30_000).select(F.when(n % 3 == 0, -1).otherwise(n).alias("doc_id"), F.when(n % 3 == 0, "the same line of text").otherwise(F.concat(F.lit("text "), n)).alias("text"))
    rows = df.select(F.struct("doc_id", "text").alias("row"), sharding.row_bytes(df).alias("bytes"))
    per = sharding.scattered(rows, 64, bucket_bytes=20_000).groupBy("bucket").count().collect()
    assert len(per) == 64 and max(r["count"] for r in per) < 3 * 30_000 / 64
    place = lambda some: sorted((r.doc_id, r.shard, r.slot) for r in sharding.shard_documents(some, bucket_bytes=20_000).collect())
    got = place(df)
    assert got == place(df.repartition(7)) and len({x[1:] for x in got}) == 30_000


def test_maps_and_variants_are_columns_like_others(spark):
    from pyspark.sql import functions as F

    df = spark.range(500).select("id", F.lit("t").alias("text"), F.create_map(F.lit("k"), F.col("id")).alias("m"), F.parse_json(F.lit('{"a": 1}')).alias("v"))
    out = sharding.shard_documents(df, bucket_bytes=500)
    rows = out.collect()
    assert sorted(r.id for r in rows) == list(range(500)) and all(r.m == {"k": r.id} for r in rows)
    scattered = sharding.scattered(df.select(F.struct("id", "text", "m").alias("row"), F.lit(10).alias("bytes")), 8)
    assert scattered.select("bucket").distinct().count() == 8
