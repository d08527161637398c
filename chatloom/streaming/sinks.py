"""Sinks that keep the operational tables in step with a stream, each batch all or nothing.

A batch writes the buckets that its keys touch and becomes visible by one manifest (``operators.stored``). A batch that died
half-way is delivered again by the stream's checkpoint and begins from the state before it; one that was committed is passed over.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.operators import embed, normalize, policy, sync
from chatloom.operators.stored import Store
from chatloom.schemas import OPERATIONAL
from chatloom.scratch import release, written

MESSAGE = list(sync.MESSAGE)

#: What the sinks log, besides the operational tables.
LOGS = {
    "sync_results": ("account_id string, chat_id string, message_id string, arrival bigint, kind string, update_id string, status string, version bigint", sync.MESSAGE),
    "decisions": ("stable_id string, owner_id string, account_id string, chat_id string, message_id string, content_type string, action string, reason string", ("stable_id",)),
    "completed_edits": ("idempotency_key string, account_id string, chat_id string, message_id string, completed_at timestamp", ("idempotency_key",)),
    "processed": ("stable_id string", ("stable_id",)),
}

Step = Callable[[str], None]


def open_store(spark: SparkSession, root: str, buckets: int = 64) -> Store:
    return Store(spark, root, OPERATIONAL, LOGS, buckets)


def _later(old: DataFrame, new: DataFrame) -> DataFrame:
    """High-water marks: a null, or a mark that arrived before, moves nothing back."""
    both = old.unionByName(new)
    return both.groupBy("account_id").agg(F.max_by("last_message_id", F.when(F.col("last_message_id").isNotNull(), F.col("last_arrival"))).alias("last_message_id"), F.max("last_ts").alias("last_ts"), F.max("last_arrival").alias("last_arrival"))


def _first_tombstones(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new.join(old.select(*MESSAGE), MESSAGE, "left_anti"))


def message_sink(store: Store, after: Step = lambda table: None) -> Callable[[DataFrame, int], None]:
    """Edit and delete state from a stream of updates (the columns of ``sync.classify_updates``): a batch's windows over its touched messages.

    What is kept of a message is one row of fixed width, whatever it has seen; the keys of completed edits are the operation log, which is
    looked up by key in the buckets of the batch's keys. Nothing runs row by row. Updates of a later batch count as later arrivals.
    Tables: messages, deletion_tombstones, checkpoints; logs: sync_results, completed_edits. ``after`` is told each table written.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        if store.is_committed(batch_id):
            return
        updates = written(batch.withColumn("idempotency_key", policy.idempotency_key(F.col("kind"), *map(F.col, MESSAGE), F.col("update_id"), F.col("edit_ts"))), "updates")
        mine = store.touched("messages", updates)
        if not mine:
            store.commit(batch_id)
            return
        state = store.read("messages", mine, before=batch_id)
        done = store.read_log("completed_edits", store.touched("completed_edits", updates.where("kind = 'edit'")), before=batch_id)
        near = state.join(updates.select(*MESSAGE).distinct(), MESSAGE, "left_semi")
        known = done.join(updates.select("idempotency_key").distinct(), "idempotency_key", "left_semi")
        classified = written(sync.classify_updates(updates, near, known), "classified")
        store.append("sync_results", classified.withColumns({"arrival": F.col("arrival").cast("bigint"), "version": F.col("version").cast("bigint")}), batch_id)
        after("sync_results")
        took = classified.where("status IN ('apply', 'upsert')")
        store.append("completed_edits", took.select(F.col("key").alias("idempotency_key"), *MESSAGE, F.col("edit_ts").cast("timestamp").alias("completed_at")), batch_id)
        after("completed_edits")
        store.rewrite("messages", sync.state_after(classified, state), mine, batch_id)
        after("messages")
        gone = classified.where("kind = 'delete'").groupBy(*MESSAGE).agg(F.min("edit_ts").cast("timestamp").alias("deleted_at"))
        store.upsert("deletion_tombstones", gone, batch_id, _first_tombstones)
        after("deletion_tombstones")
        marks = sync.checkpoints(classified).join(classified.groupBy("account_id").agg(F.max("arrival").cast("bigint").alias("last_arrival")), "account_id")
        store.upsert("checkpoints", marks.withColumn("last_ts", F.col("last_ts").cast("timestamp")), batch_id, _later)
        after("checkpoints")
        store.commit(batch_id)
        release(updates, classified)

    return write


def _base(message: F.Column) -> F.Column:
    """The message that a piece of content belongs to."""
    return F.regexp_replace(message, ":attachment$", "")


def content_of(decided: DataFrame) -> DataFrame:
    """Accepted rows of decided events in the shape of ``sync.replacement_chunks``, with the message and the time that each speaks of.

    ``message_id`` is the content's own id, ``base_id`` its message; an attachment without text is known by its file's name.
    """
    when = F.coalesce("edited_at", "ts") if "edited_at" in decided.columns else F.col("ts")
    own = F.col("source_message_id")
    return decided.select(
        "owner_id", F.col("source_account_id").alias("account_id"), F.col("conversation_id").alias("chat_id"), own.alias("message_id"), _base(own).alias("base_id"), "content_type",
        F.coalesce("text", F.col("attachment.filename")).alias("text"), F.lit(None).cast("map<string,string>").alias("extra"), "action", when.alias("as_of"),
    )


OWN = ["account_id", "chat_id", "source_message_id"]


def _next_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """For content that was there before: one version more if any of its chunks changed, the same if none did."""
    side = lambda df, o: df.select(*OWN, "vector_id", "text", F.lit(o).alias("o"), F.lit(1 - o).alias("n"))
    same = side(old, 1).union(side(new, 0)).groupBy(*OWN, "vector_id", "text").agg(F.max("o").alias("o"), F.max("n").alias("n"))
    changed = same.groupBy(*OWN).agg(F.bool_or(F.col("o") != F.col("n")).alias("changed"))
    return old.groupBy(*OWN).agg(F.max("message_version").alias("v")).join(changed, OWN).select(*OWN, (F.col("v") + F.col("changed").cast("bigint")).alias("next"))


def ingest_sink(store: Store, accounts: DataFrame, chats: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], dim: int, default_owner: str = "default", after: Step = lambda table: None) -> Callable[[DataFrame, int], None]:
    """From events to stored chunks: owner, normal form, decision, chunks, embeddings, checkpoint.

    What a piece of content had before is replaced by the latest event of it, by ``edited_at`` or else its time; older events that come late
    change nothing. A deletion removes all chunks of its message, attachments too, and leaves a tombstone, after which nothing of the message
    comes back. A chunk whose id and text are as before keeps its embedding; equal texts are embedded once. Messages that were taken in
    before are known from the log of processed ids. So an event that is delivered again changes nothing.
    Tables: message_chunks, deletion_tombstones, checkpoints, of which a batch reads and writes the buckets of its messages; logs: decisions,
    processed. ``after`` is told each table written.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        if store.is_committed(batch_id):
            return
        objects = written(normalize.normalize(policy.with_owner(batch.drop("owner_id"), accounts, default_owner)), "objects")
        if objects.isEmpty():
            store.commit(batch_id)
            release(objects)
            return
        seen = store.read_log("processed", store.touched("processed", objects), before=batch_id)
        decided = written(policy.decide(objects, accounts, chats, seen), "decided")
        log = decided.select("stable_id", "owner_id", F.col("source_account_id").alias("account_id"), F.col("conversation_id").alias("chat_id"), F.col("source_message_id").alias("message_id"), "content_type", "action", "reason")
        store.append("decisions", log, batch_id)
        after("decisions")
        content = written(content_of(decided.where("action <> 'ignore'")), "content")
        messages = content.select("account_id", "chat_id", F.col("base_id").alias("message_id")).distinct()
        tombs = store.read("deletion_tombstones", store.touched("deletion_tombstones", messages), before=batch_id)
        gone = content.where("action = 'process_delete'").groupBy("account_id", "chat_id", F.col("base_id").alias("message_id")).agg(F.min("as_of").alias("deleted_at"))
        gone = written(gone, "gone")
        buckets = store.touched("message_chunks", messages)
        before = store.read("message_chunks", buckets, before=batch_id)

        dead = gone.select(*MESSAGE).union(tombs.select(*MESSAGE)).toDF("account_id", "chat_id", "base_id").distinct()
        latest = content.where("action <> 'process_delete'").join(dead, ["account_id", "chat_id", "base_id"], "left_anti")
        latest = latest.groupBy("owner_id", "account_id", "chat_id", "message_id", "base_id").agg(F.max_by(F.struct("content_type", "text", "extra", "as_of"), F.struct("as_of", "text")).alias("c"))
        newest = before.groupBy(*OWN).agg(F.max("as_of").alias("had")).withColumnRenamed("source_message_id", "message_id")
        latest = latest.select("owner_id", "account_id", "chat_id", "message_id", "base_id", "c.*").join(newest, ["account_id", "chat_id", "message_id"], "left")
        latest = written(latest.where("had IS NULL OR as_of >= had").drop("had"), "latest")
        made = sync.replacement_chunks(latest.drop("base_id", "owner_id", "as_of")).join(latest.select("owner_id", *MESSAGE, "base_id", "as_of"), MESSAGE)
        made = made.withColumnRenamed("message_id", "source_message_id").withColumnRenamed("base_id", "message_id")
        replaced = before.join(latest.select("account_id", "chat_id", F.col("message_id").alias("source_message_id")), OWN, "left_semi")
        reused = written(sync.reuse_embeddings(made, replaced), "chunks")
        ready = reused.where("embedding IS NOT NULL").unionByName(embed.embed(reused.where("embedding IS NULL").drop("embedding"), load, dim))
        new = ready.join(_next_versions(replaced, reused), OWN, "left").withColumns({"message_version": F.coalesce("next", F.lit(1).cast("bigint")), "is_active": F.lit(True)}).select(*before.columns)
        rest = before.join(gone, MESSAGE, "left_anti").join(latest.select("account_id", "chat_id", F.col("message_id").alias("source_message_id")), OWN, "left_anti")
        if buckets:
            store.rewrite("message_chunks", rest.select(*before.columns).unionByName(new), buckets, batch_id)
        after("message_chunks")
        store.upsert("deletion_tombstones", gone, batch_id, _first_tombstones)
        after("deletion_tombstones")
        store.append("processed", decided.where("action = 'process'").select("stable_id").distinct(), batch_id)
        after("processed")
        marks = content.groupBy("account_id").agg(F.max_by("base_id", F.struct("as_of", "message_id")).alias("last_message_id"), F.max("as_of").alias("last_ts"))
        store.upsert("checkpoints", marks.withColumn("last_arrival", F.unix_micros("last_ts")), batch_id, _later)
        after("checkpoints")
        store.commit(batch_id)
        release(objects, decided, content, gone, latest, reused)

    return write
