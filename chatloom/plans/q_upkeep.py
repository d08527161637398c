"""Stored collections, files and streams of events, flat exports, and the rarer rules of edits and scope."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from chatloom.operators import collection, embed, policy, search, state, sync
from chatloom.plans.q_change import _CLASSIFIED
from chatloom.plans.q_retrieval import _over_hits, _thin
from chatloom.plans.q_text import _CASES, _OBJECTS, _objects, jobs_dir
from chatloom.plans.sql_tables import with_tables
from chatloom.sources import tables
from chatloom.sources.events import read_events, stream_events
from chatloom.streaming import jobs

MODEL = "model-a"


def _folder(spark):
    return f"{jobs_dir(spark)}/{uuid.uuid4().hex}"


def insert_if_absent(spark, sf_dir):
    """Rows that come twice and rows that are there already are added once or not at all."""
    c = tables.chunks(spark, sf_dir).select("vector_id", "content_type", "doc_id")
    new = c.where("doc_id % 2 = 0")
    return collection.insert_if_absent(c.where("doc_id % 3 = 0"), new.union(new.where("doc_id % 4 = 0")), ["vector_id"])


def exported_lists(spark, sf_dir):
    c = tables.chunks(spark, sf_dir).select("vector_id", F.when(F.col("doc_id") % 9 != 0, F.array("content_type", "conversation_id")).alias("tags"))
    return state.exported_lists(c, "tags")


def knowledge_metadata(spark, sf_dir):
    n = F.col("doc_id")
    held = F.create_map(F.lit("conversation_title"), F.col("conversation_id"), F.when(n % 2 == 0, "conversation_type").otherwise("attachment_id"), F.concat(F.lit("x"), n))
    return collection.knowledge_metadata(tables.chunks(spark, sf_dir).select("vector_id", held.alias("metadata")), "pdf", 3).drop("metadata")


def caption_edits(spark, sf_dir):
    m, n = tables.messages(spark, sf_dir), F.col("conv_id") + F.col("turn")
    new_file = F.when(n % 3 == 0, F.lit("other")).otherwise(F.lit("file"))
    new_sum = F.when(n % 5 == 0, F.lit(None).cast("string")).otherwise(F.when(n % 4 == 0, F.lit("b")).otherwise(F.lit("a")))
    return m.select("message_id", sync.caption_only(F.lit("file"), F.lit("a"), new_file, new_sum).alias("caption_only"))


def edits_without_content(spark, sf_dir):
    """Edits that don't bring their content can't bring an unknown message into being."""
    u = tables.updates(spark, sf_dir).withColumn("reconstructible", F.lit(False))
    return sync.classify_updates(u).groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"))


def enriched_vectors(spark, sf_dir):
    v = tables.table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 3 == 0, F.transform("embedding", lambda x: x * 2)).otherwise(F.col("embedding")).alias("embedding"))
    return embed.enriched(v, MODEL).drop("embedding")


def type_preferences(spark, sf_dir):
    decided = policy.decide(_objects(spark, sf_dir), tables.accounts(spark, sf_dir), tables.chats(spark, sf_dir), type_preferences={"voice": False, "pdf": False, "text": True})
    return decided.groupBy("action", "reason").agg(F.count(F.lit(1)).alias("n"))


def full_scope_knn(spark, sf_dir):
    """All filters of a request at once, each used by some of the queries."""
    n = F.expr("query_id DIV 20")
    q = tables.query_vectors(spark, sf_dir).select("query_id", "owner_id", "query_vector", "top_k")
    chats = [F.lit(f"chat_{i}") for i in range(6)]
    q = q.withColumns({
        "account_id": F.when(n % 5 == 0, F.concat(F.lit("acc_"), F.substring("owner_id", 7, 9))), "conversation_ids": F.when(n % 2 == 0, F.array(*chats)), "conversation_id": F.when(n % 2 == 1, F.concat(F.lit("chat_"), F.substring("owner_id", 7, 9))),
        "content_types": F.when(n % 3 == 1, F.array(F.lit("pdf"), F.lit("text"), F.lit("link"))), "content_type": F.when(n % 6 == 2, F.lit("image")), "message_id": F.when(n % 7 == 3, F.concat(F.lit("m"), n)), "sender_id": F.when(n % 11 == 5, F.lit("web")),
    })
    return _thin(search.knn(tables.chunks(spark, sf_dir), q))


def stored_collections(spark, sf_dir):
    """Chunks written as a collection store, one collection dropped, the rest read again, whole and by owner."""
    path = _folder(spark)
    collection.write_collection(tables.chunks(spark, sf_dir), path)
    collection.drop_collection(spark, path, "col_1")
    whole = collection.read_collection(spark, path).select(F.lit("whole").alias("part"), "collection", "vector_id")
    owned = collection.read_collection(spark, path, owner_id="owner_2").select(F.lit("owner_2"), "collection", "vector_id")
    return whole.union(owned)


def migration_written(spark, sf_dir):
    """A migration that writes, verified by what the store then holds."""
    path = _folder(spark)
    c = tables.chunks(spark, sf_dir)
    collection.write_collection(c.where("doc_id % 3 = 0"), path)
    return collection.migrate(c.where("doc_id % 2 = 0"), c.where("doc_id % 3 = 0").select("collection", "vector_id"), path, dry_run=False)


def event_files(spark, sf_dir):
    """Update events from JSON files, and the same from a folder that a stream watches."""
    base = _folder(spark)
    e = tables.events(spark, sf_dir)
    e.write.json(f"{base}/json")
    e.write.parquet(f"{base}/in")
    read = read_events(spark, f"{base}/json", multi_line=False).select(F.lit("files").alias("way"), "message_type", "is_edited")
    jobs.run_to_end(stream_events(spark, f"{base}/in", schema=e.schema, form="parquet"), jobs.append_once(f"{base}/out"), f"{base}/checkpoint")
    streamed = spark.read.parquet(f"{base}/out").select(F.lit("stream"), "message_type", "is_edited")
    return read.union(streamed).groupBy("way", "message_type", "is_edited").agg(F.count(F.lit(1)).alias("n"))


def stream_restart(spark, sf_dir):
    """A stream that stops and starts again from its checkpoint, once with new updates and once with none: each update once."""
    base = _folder(spark)
    u = tables.updates(spark, sf_dir)
    first = F.pmod(F.xxhash64("message_id"), F.lit(2)) == 0
    for some in (u.where(first), u.where(~first), None):
        if some is not None:
            some.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(u.schema).option("maxFilesPerTrigger", 4).parquet(f"{base}/in")
        jobs.run_to_end(stream, jobs.update_log_sink(f"{base}/log"), f"{base}/checkpoint")
    return jobs.state_from_log(spark, f"{base}/log").groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"))


def account_progress(spark, sf_dir):
    found = jobs.progress(sync.classify_updates(tables.updates(spark, sf_dir)))
    return found.select("account_id", "n_applied", F.date_format("last_ts", "yyyy-MM-dd HH:mm:ss").alias("last_ts"))


QUERIES = {q.__name__: q for q in (
    insert_if_absent, exported_lists, knowledge_metadata, caption_edits, edits_without_content, enriched_vectors, type_preferences, full_scope_knn, stored_collections, migration_written, event_files,
    stream_restart, account_progress)}

_WITHOUT_CONTENT = _CLASSIFIED.replace("bool_or(kind IN ('new', 'edit'))", "bool_or(kind = 'new')").replace("kind = 'edit' AND NOT tomb AS live", "kind = 'edit' AND NOT tomb AND known AS live")
_WITHOUT_CONTENT = _WITHOUT_CONTENT.replace("ELSE CASE WHEN NOT live THEN 'deleted' WHEN duplicate", "ELSE CASE WHEN tomb THEN 'deleted' WHEN NOT known THEN 'failed' WHEN duplicate")
_SWITCHED = [*_CASES[:2], ("o.content_type IN ('voice', 'pdf')", "ignore", "content type is switched off"), _CASES[2], _CASES[4]]
_SWITCH = lambda i, last: "CASE " + " ".join(f"WHEN {x[0]} THEN '{x[i]}'" for x in _SWITCHED) + f" ELSE '{last}' END"
_N = "(q.query_id // 20)"
_FULL = f"""({_N} % 5 <> 0 OR c.account_id = 'acc_' || substr(q.owner_id, 7)) AND ({_N} % 2 <> 0 OR c.conversation_id IN ('chat_0', 'chat_1', 'chat_2', 'chat_3', 'chat_4', 'chat_5'))
  AND ({_N} % 2 <> 1 OR c.conversation_id = 'chat_' || substr(q.owner_id, 7)) AND ({_N} % 3 <> 1 OR c.content_type IN ('pdf', 'text', 'link')) AND ({_N} % 6 <> 2 OR c.content_type = 'image')
  AND ({_N} % 7 <> 3 OR c.source_message_id = 'm' || {_N}) AND ({_N} % 11 <> 5 OR c.sender_id = 'web')"""

ORACLE_SQL = {
    "insert_if_absent": with_tables("chunks") + "SELECT vector_id, content_type, doc_id FROM chunks WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0",
    "exported_lists": with_tables("chunks") + """SELECT vector_id, CASE WHEN doc_id % 9 = 0 THEN '[]' ELSE '["' || content_type || '","' || conversation_id || '"]' END AS tags FROM chunks""",
    "knowledge_metadata": with_tables("chunks") + "SELECT vector_id, conversation_id AS conversation_title, CASE WHEN doc_id % 2 = 0 THEN 'x' || doc_id END AS conversation_type, CASE WHEN doc_id % 2 <> 0 THEN 'x' || doc_id END AS attachment_id, 'pdf' AS content_part, 3 AS chunk_index FROM chunks",
    "caption_edits": with_tables("messages") + "SELECT message_id, (conv_id + turn) % 3 <> 0 AND (conv_id + turn) % 4 <> 0 AND (conv_id + turn) % 5 <> 0 AS caption_only FROM messages",
    "edits_without_content": with_tables("updates", more=_WITHOUT_CONTENT) + "SELECT kind, status, count(*) AS n FROM classified GROUP BY 1, 2",
    "enriched_vectors": f"SELECT vec_id, '{MODEL}' AS embedding_model, 64 AS embedding_dim, vec_id % 3 <> 0 AND abs(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) - 1) < 1e-4 AS is_normalised FROM embeddings",
    "type_preferences": with_tables("raw_events", "chats", more=_OBJECTS) + f"""SELECT {_SWITCH(1, 'process')} AS action, {_SWITCH(2, 'new message')} AS reason, count(*) AS n
      FROM objects o LEFT JOIN chats c ON o.owner_id = c.owner_id AND o.account_id = c.account_id AND o.chat_id = c.chat_id GROUP BY 1, 2""",
    "full_scope_knn": _over_hits("SELECT query_id, vector_id, rank, similarity, low_confidence FROM hits", scope=_FULL),
    "stored_collections": with_tables("chunks") + "SELECT 'whole' AS part, collection, vector_id FROM chunks WHERE collection <> 'col_1' UNION ALL SELECT 'owner_2', collection, vector_id FROM chunks WHERE owner_id = 'owner_2' AND collection <> 'col_1'",
    "migration_written": with_tables("chunks") + """SELECT collection, count(*) FILTER (doc_id % 2 = 0) AS old_count, count(*) FILTER (doc_id % 2 = 0 AND doc_id % 3 <> 0) AS inserted, count(*) FILTER (doc_id % 6 = 0) AS skipped, count(*) AS new_count,
      CASE WHEN count(*) FILTER (doc_id % 2 = 0 AND doc_id % 3 <> 0) > 0 THEN 'migrated' ELSE 'already_done' END AS status FROM chunks WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 GROUP BY collection HAVING old_count > 0""",
    "event_files": with_tables("raw_events") + "SELECT way, message_type, is_edited, count(*) AS n FROM raw_events, (SELECT unnest(['files', 'stream']) AS way) GROUP BY 1, 2, 3",
    "stream_restart": with_tables("updates", more=_CLASSIFIED) + "SELECT kind, status, count(*) AS n FROM classified GROUP BY 1, 2",
    "account_progress": with_tables("updates", more=_CLASSIFIED) + "SELECT account_id, count(*) FILTER (status IN ('created', 'apply', 'upsert', 'ok')) AS n_applied, strftime(max(edit_ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM classified GROUP BY account_id",
}
