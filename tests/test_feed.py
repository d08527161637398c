"""The feed source: segments, offsets, restarts."""

from pyspark.sql import functions as F

from chatloom.scratch import new_folder
from chatloom.sources import feed
from chatloom.streaming import jobs

SCHEMA = "key string, n bigint, ts timestamp, text string"


def rows(spark, low, high):
    text = F.when(F.col("id") % 5 != 0, F.concat(F.lit('line "one"\nline é '), "id"))
    return spark.range(low, high).select(F.concat(F.lit("k"), F.col("id") % 7).alias("key"), F.col("id").alias("n"), F.timestamp_seconds("id").alias("ts"), text.alias("text"))


def test_segments_and_offsets(spark):
    path = new_folder(spark, "feed")
    feed.append_to_feed(rows(spark, 0, 100), path, 3, "n", ["key"])
    feed.append_to_feed(rows(spark, 100, 250), path, 3, "n", ["key"])
    found = feed.segments(path)
    assert all(a[1] == b[0] for own in found.values() for a, b in zip(own, own[1:], strict=False)) and sum(own[-1][1] for own in found.values()) == 250
    reader = feed.FeedReader(rows(spark, 0, 1).schema, path)
    end = reader.latestOffset()
    some = {s: n // 3 for s, n in end.items()}
    first, second = reader.partitions({}, some), reader.partitions(some, end)
    got = [sorted(n for p in parts for b in reader.read(p) for n in b.column("n").to_pylist()) for parts in (first, second)]
    assert len(got[0]) == sum(some.values()) and sorted(got[0] + got[1]) == list(range(250))
    assert reader.partitions(end, end) == [] and feed.segments(f"{path}/nowhere") == {}


def test_a_stream_that_stops_and_starts_again(spark):
    """What comes while the stream is down, and a batch that died, come once each, in order within a key."""
    path, out, checkpoint = (new_folder(spark, x) for x in ("feed", "out", "checkpoint"))
    kept = jobs.append_once(out)
    failed = []

    def dying(batch, batch_id):
        kept(batch, batch_id)
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            raise RuntimeError("died after its write")

    for low, high in ((0, 60), (60, 200), (200, 230)):
        feed.append_to_feed(rows(spark, low, high), path, 3, "n", ["key"])
        stream = lambda: feed.stream_feed(spark, path, rows(spark, 0, 1).schema)
        try:
            jobs.run_to_end(stream(), dying, checkpoint)
        except Exception:
            assert failed == [1]
    jobs.run_to_end(stream(), dying, checkpoint)
    found = spark.read.parquet(out)
    assert failed and found.count() == 230
    assert found.drop("batch").exceptAll(rows(spark, 0, 230)).isEmpty() and rows(spark, 0, 230).exceptAll(found.drop("batch")).isEmpty()


def test_long_shards_are_cut_into_segments(spark):
    """So that a batch is read by more tasks than the feed has shards; numbers go on and the order stays."""
    path = new_folder(spark, "feed")
    feed.append_to_feed(rows(spark, 0, 100), path, 2, "n", ["key"], most=10)
    feed.append_to_feed(rows(spark, 100, 150), path, 2, "n", ["key"], most=10)
    found = feed.segments(path)
    assert all(own[0][0] == 0 and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False)) and all(b - a <= 10 for a, b, _ in own) for own in found.values())
    reader = feed.FeedReader(rows(spark, 0, 1).schema, path)
    parts = reader.partitions({}, reader.latestOffset())
    assert len(parts) >= 15 > len(found)
    got = [n for p in parts for b in reader.read(p) for n in b.column("n").to_pylist()]
    assert sorted(got) == list(range(150))
