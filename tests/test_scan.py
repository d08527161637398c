"""Running totals over parts against plain loops."""

import random
import threading

from pyspark.sql import functions as F

from chatloom import scratch
from chatloom.operators.scan import numbered, running


def test_one_key_holds_most_rows(spark):
    rng = random.Random(1)
    rows = [(None if i % 97 == 0 else "hot" if i % 3 else f"k{i % 11}", i, rng.randrange(-9, 9)) for i in range(4000)]
    df = spark.createDataFrame(rows, "key string, at int, x bigint").repartition(7)
    found = running(df, ["key"], ["at"], {"n": (F.lit(1).cast("bigint"), F.sum), "total": (F.col("x"), F.sum), "mix": (F.col("x"), F.bit_xor), "top": (F.col("x"), F.max)})
    got = {(r.key, r.at): (r.n, r.total, r.mix, r.top) for r in found.collect()}
    seen: dict = {}
    for key, at, x in sorted(rows, key=lambda r: r[1]):
        n, total, mix, top = seen.get(key, (0, 0, 0, -99))
        seen[key] = n + 1, total + x, mix ^ x, max(top, x)
        assert got.pop((key, at)) == seen[key]
    assert not got


def test_several_parts_take_part(spark):
    df = spark.range(20000).select(F.lit("one").alias("key"), F.col("id").alias("at"))
    found = numbered(df.repartition(9), ["key"], ["at"], "n")
    assert found.where("n <> at + 1").isEmpty() and found.count() == 20000


def test_no_rows(spark):
    assert numbered(spark.range(0).select(F.lit("a").alias("key"), "id"), ["key"], ["id"], "n").collect() == []


def test_threads_record_their_own_tables(spark):
    other, go, there = [], threading.Event(), threading.Event()

    def work():
        with scratch.recorded() as made:
            go.wait()
            scratch.written(spark.range(3), "theirs")
            other.extend(made)
            there.set()

    t = threading.Thread(target=work)
    t.start()
    with scratch.recorded() as mine:
        go.set()
        there.wait()
        kept = scratch.written(spark.range(5), "mine")
        with scratch.recorded() as inner:
            scratch.written(spark.range(2), "inner")
    t.join()
    assert len(mine) == 2 and len(inner) == 1 and len(other) == 1 and not set(other) & set(mine)
    scratch.release_paths(spark, mine, keep=kept)
    assert kept.count() == 5 and spark.read.parquet(other[0]).count() == 3
