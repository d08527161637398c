"""State kept by batches against the whole log at once, and writers that die at any of their steps."""

import random

import pytest
from pyspark.sql import functions as F

from chatloom.operators import embed, sync
from chatloom.scratch import new_folder
from chatloom.sources import tables
from chatloom.streaming import sinks

SCHEMA = "account_id string, chat_id string, message_id string, kind string, edit_ts timestamp, update_id string, arrival bigint, reconstructible boolean"
TABLES = ("messages", "deletion_tombstones", "checkpoints")


def updates(spark, n=400):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        m = rng.randrange(25)
        ts, uid = rng.choice([None, rng.randrange(30)]), rng.choice([None, f"{rng.randrange(40):03d}"])
        rows.append((f"a{m % 3}", f"c{m % 5}", f"m{m}", rng.choices(["new", "edit", "delete"], [3, 9, 1])[0], ts, uid, i, rng.random() < 0.8))
    df = spark.createDataFrame(rows, SCHEMA.replace("edit_ts timestamp", "t bigint"))
    return df.withColumn("edit_ts", F.timestamp_seconds("t")).drop("t")


def contents(store, *names):
    return [sorted(map(repr, store.read(n).collect())) for n in names]


class Died(Exception):
    pass


def feed(store, batches, die_at=None):
    """Give batches to the sink as a stream would, one of them again after the writer died at a step."""
    def after(table):
        if die_at and table == die_at[1] and not fallen and at == die_at[0]:
            fallen.append(table)
            raise Died

    fallen = []
    at = 0
    for at, some in enumerate(batches):
        try:
            sinks.message_sink(store, after)(some, at)
        except Died:
            store = sinks.open_store(store.spark, store.root, store.buckets)
            sinks.message_sink(store)(some, at)
    sinks.message_sink(store)(batches[-1], len(batches) - 1)  # delivered again after its commit
    return store


def test_batches_against_the_whole_log(spark):
    u = updates(spark)
    parts = [u.where((F.col("arrival") >= lo) & (F.col("arrival") < hi)) for lo, hi in ((0, 90), (90, 91), (91, 240), (240, 400))]
    store = feed(sinks.open_store(spark, new_folder(spark, "store"), 8), parts, die_at=(2, "messages"))
    whole = sync.classify_updates(u)
    got = {(r.arrival, r.status, r.version) for r in store.read_log("sync_results").collect()}
    assert got == {(r.arrival, r.status, r.version) for r in whole.collect()}
    assert {"stale", "duplicate", "deleted", "failed", "skipped", "blocked", "upsert"} <= {s for _, s, _ in got}
    state = {r.message_id: tuple(r)[1:] for r in sync.message_state(whole).drop("account_id", "chat_id").collect()}
    kept = store.read("messages").where("current_version IS NOT NULL OR is_deleted").select("message_id", "current_version", "is_edited", "is_deleted", "last_update_id", "n_updates")
    assert {r.message_id: tuple(r)[1:] for r in kept.collect()} == state
    assert store.read("messages").count() == u.select("message_id").distinct().count()  # one row a message, whatever it has seen
    plan = sync.classify_updates(u, store.read("messages"), store.read_log("completed_edits"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("table", ["message_chunks"])
def test_ingest_survives_its_writer(spark, table):
    """The chunk table is the same wherever a writer died, and after everything was delivered once more."""
    sf = "/root/testdata/sf0.001"
    events = tables.events(spark, sf).where("message_id RLIKE '^[0-9]_'")
    accounts, chats = tables.accounts(spark, sf), tables.chats(spark, sf)
    load = lambda: embed.hashing_embedder(8)
    changed = events.where("message_id LIKE '%_1'").withColumns({"text": F.concat("text", F.lit("!")), "is_edited": F.lit(True), "edited_at": F.lit("2025-01-01T00:00:00Z")})
    batches = [events.withColumn("edited_at", F.lit(None).cast("string")), changed.select(*events.columns, "edited_at")]

    def run(die):
        store = sinks.open_store(spark, new_folder(spark, "store"), 8)
        for at, some in enumerate([*batches, batches[0]]):
            def after(name, at=at):
                if die and at == 1 and name == table:
                    raise Died

            try:
                sinks.ingest_sink(store, accounts, chats, load, 8, after=after)(some, at)
            except Died:
                store = sinks.open_store(spark, store.root, 8)
                sinks.ingest_sink(store, accounts, chats, load, 8)(some, at)
        return contents(store, "message_chunks", "checkpoints"), store

    (chunks, marks), store = run(True)
    assert (chunks, marks) == tuple(run(False)[0]) if table == "message_chunks" else chunks
    edited = store.read("message_chunks").where("message_version = 2")
    assert edited.where("text LIKE '%!'").count() == edited.count() > 0
    assert store.read("message_chunks").groupBy("vector_id").count().where("count > 1").isEmpty()


def test_waves_come_in_files_of_several_tasks(spark, tmp_path):
    """A wave is not the work of one task; all its rows are there when it has come, and none of the next wave's."""
    from chatloom.plans.q_change import _waves

    u, seen = updates(spark).repartition(4), []
    for _ in _waves(u, f"file://{tmp_path}/in", 3):
        seen.append((spark.read.parquet(f"file://{tmp_path}/in").count(), len(list((tmp_path / "in").glob("*.parquet")))))
    assert len(seen) == 3 and seen[-1][0] == 400 and seen[0][0] < seen[1][0] < 400 and seen[0][1] > 1
    assert spark.read.parquet(f"file://{tmp_path}/in").exceptAll(u).isEmpty()
