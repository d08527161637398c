"""Edits, deletions, reconciliation, checkpoints and the streaming form of message state."""

from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from chatloom.operators import embed, policy, state, sync
from chatloom.plans.q_text import _decisions
from chatloom.plans.sql_tables import with_tables
from chatloom.scratch import new_folder, release, written
from chatloom.scratch import scratch_dir as jobs_dir
from chatloom.sources import feed, tables
from chatloom.streaming import jobs, sinks
from chatloom.streaming.edits import classified_stream

_TS = "yyyy-MM-dd HH:mm:ss"
_NOW = "2024-03-01 00:00:00"


def edit_classify(spark, sf_dir):
    return sync.classify_updates(tables.updates(spark, sf_dir)).select("message_id", "arrival", "kind", "update_id", "status", F.col("version").cast("long").alias("version"))


def status_counts(spark, sf_dir):
    return sync.dispatch(tables.updates(spark, sf_dir)).groupBy("handler", "status").agg(F.count(F.lit(1)).alias("n"))


def delete_status(spark, sf_dir):
    return sync.classify_updates(tables.updates(spark, sf_dir)).where("kind = 'delete'").select("message_id", "arrival", "status")


def message_state(spark, sf_dir):
    found = sync.message_state(sync.classify_updates(tables.updates(spark, sf_dir)))
    return found.select("message_id", F.col("current_version").cast("long").alias("current_version"), "is_edited", "is_deleted", "last_update_id", "n_updates")


def tombstones(spark, sf_dir):
    return sync.tombstones(tables.updates(spark, sf_dir).where("kind = 'delete'")).select("message_id", F.date_format("deleted_at", _TS).alias("deleted_at"))


def replay_protection(spark, sf_dir):
    u = tables.updates(spark, sf_dir)
    return sync.replay_protected(u.where("kind <> 'delete'"), sync.tombstones(u.where("kind = 'delete'"))).select("message_id", "arrival", "kind")


def _edits(spark, sf_dir):
    m = tables.messages(spark, sf_dir)
    n = (F.col("conv_id") + F.col("turn")) % 7
    kind = F.element_at(F.array(*(F.lit(k) for k in ("text", "pdf", "docx", "pptx", "image", "voice", "document"))), (n + 1).cast("int"))
    parts = (F.col("turn") % 4).cast("string")
    extra = F.map_from_arrays(F.array(*(F.lit(x) for x in ("page_count", "section_count", "slide_count", "segment_count", "page_0_text", "ocr_text"))), F.array(parts, parts, parts, parts, F.lit("first page"), F.lit("read text")))
    return m.select("account_id", "chat_id", "message_id", kind.alias("content_type"), F.when(F.col("turn") % 5 != 0, F.col("text")).alias("text"), extra.alias("extra"))


def replacement_chunks(spark, sf_dir):
    return sync.replacement_chunks(_edits(spark, sf_dir)).select("vector_id", "content_part", "chunk_index", F.md5("text").alias("text_md5"), "page_number", "slide_number")


def _old_and_new(spark, sf_dir):
    new = sync.replacement_chunks(_edits(spark, sf_dir))
    extra = new.where("chunk_index = 0").withColumn("vector_id", F.concat("vector_id", F.lit(":old")))
    return new.where("chunk_index % 2 = 0").unionByName(extra), new


def vector_set_diff(spark, sf_dir):
    return sync.diff_counts(sync.vector_set_diff(*_old_and_new(spark, sf_dir))).select("message_id", "n_reused", "n_new", "n_stale")


def apply_edits(spark, sf_dir):
    old, new = _old_and_new(spark, sf_dir)
    table = old.select(*sync.MESSAGE, "vector_id", "text", F.lit(1).alias("message_version"), F.lit(True).alias("is_active"))
    edited = new.where(F.col("content_part") != "docx").withColumn("version", F.lit(2))
    return sync.apply_edits(table, edited)[0].select("vector_id", "message_version", "is_active")


def embedding_reuse(spark, sf_dir):
    c = tables.chunks(spark, sf_dir)
    new = c.select("vector_id", F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return sync.reuse_embeddings(new, c).select("vector_id", F.col("embedding").isNotNull().alias("reused"))


def _world(spark, sf_dir):
    """Messages, chunks, operations and tombstones with the inconsistencies that reconciliation looks for."""
    m, n = tables.messages(spark, sf_dir), F.col("conv_id") * 3 + F.col("turn")
    messages = m.select(*sync.MESSAGE, (n % 5 != 0).alias("is_edited"), (n % 6 == 0).alias("is_deleted"), F.element_at(F.array(*(F.lit(x) for x in ("completed", "processing", "failed", "cleanup_pending"))), (n % 4 + 1).cast("int")).alias("processing_status"))
    chunks = m.where(n % 3 != 1).select(*sync.MESSAGE, F.concat("message_id", F.lit(":0")).alias("vector_id"), (n % 7 != 0).alias("is_active"))
    operations = m.select(policy.idempotency_key(F.lit("edit"), *map(F.col, sync.MESSAGE), F.lit(None), F.col("ts")).alias("idempotency_key"), F.when(n % 8 == 0, "processing").otherwise("completed").alias("status"), F.col("ts").alias("started_at"))
    tombs = m.where(n % 12 == 0).select(*sync.MESSAGE)
    return messages, chunks, operations, tombs


def reconcile_findings(spark, sf_dir):
    return sync.reconcile(*_world(spark, sf_dir), F.lit(_NOW).cast("timestamp"))


def reconcile_report(spark, sf_dir):
    return reconcile_findings(spark, sf_dir).groupBy("rule", "repair").agg(F.count(F.lit(1)).alias("n"))


def checkpoints(spark, sf_dir):
    marks = sync.checkpoints(tables.updates(spark, sf_dir))
    return marks.select("account_id", "last_message_id", F.date_format("last_ts", _TS).alias("last_ts"))


def account_owner(spark, sf_dir):
    u, a = tables.updates(spark, sf_dir), tables.accounts(spark, sf_dir).where("account_id <> 'acc_3'")
    return policy.with_owner(u, a).groupBy("account_id", "owner_id").agg(F.count(F.lit(1)).alias("n"))


def stream_edit_state(spark, sf_dir):
    """``edit_classify`` over an update log that a stream brought in, a few files a batch."""
    base = f"{jobs_dir(spark)}/{uuid.uuid4().hex}"
    u = tables.updates(spark, sf_dir)
    u.repartition(6, "message_id").write.parquet(f"{base}/in")
    stream = spark.readStream.schema(u.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    jobs.run_to_end(stream, jobs.update_log_sink(f"{base}/log"), f"{base}/checkpoint")
    return jobs.state_from_log(spark, f"{base}/log").select("message_id", "arrival", "kind", "update_id", "status", F.col("version").cast("long").alias("version"))


def stream_stateful_edits(spark, sf_dir):
    """``edit_classify`` by keyed state, over updates that come in order of arrival; a file, which holds all of a message's updates of its time, a batch."""
    base = f"{jobs_dir(spark)}/{uuid.uuid4().hex}"
    u = tables.updates(spark, sf_dir)
    cuts = [0, *u.approxQuantile("arrival", [0.3, 0.6], 0.01), None]
    for low, high in zip(cuts, cuts[1:], strict=False):
        some = u.where(F.col("arrival") >= low) if high is None else u.where((F.col("arrival") >= low) & (F.col("arrival") < high))
        some.repartition(4, "message_id").write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(u.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    jobs.run_to_end(classified_stream(stream), jobs.append_once(f"{base}/out"), f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").select("message_id", "arrival", "kind", "update_id", "status", "version")


def stream_message_table(spark, sf_dir):
    """``message_state`` as a stored table, kept by a stream of updates in order of arrival; the writer dies once inside a batch and starts again."""
    base = new_folder(spark, "message-table")
    u = tables.updates(spark, sf_dir)
    run = lambda after: jobs.run_to_end(spark.readStream.schema(u.schema).parquet(f"{base}/in"), sinks.message_sink(sinks.open_store(spark, f"{base}/store", 16), after), f"{base}/checkpoint")
    _dying(run, _waves(u, f"{base}/in", 3), "messages", 2)
    store = sinks.open_store(spark, f"{base}/store", 16)
    return store.read("messages").where("current_version IS NOT NULL OR is_deleted").select("message_id", "current_version", "is_edited", "is_deleted", "last_update_id", "n_updates")


def stream_update_results(spark, sf_dir):
    """``edit_classify`` as the log of the same job, over other batches."""
    base = new_folder(spark, "update-results")
    u = tables.updates(spark, sf_dir)
    store = sinks.open_store(spark, f"{base}/store", 16)
    for _ in _waves(u, f"{base}/in", 3):
        jobs.run_to_end(spark.readStream.schema(u.schema).parquet(f"{base}/in"), sinks.message_sink(store), f"{base}/checkpoint")
    return store.read_log("sync_results").select("message_id", "arrival", "kind", "update_id", "status", "version")


class Died(Exception):
    """The writer's end inside a batch."""


def _dying(run, waves, table, nth):
    """Run a job after each wave; its writer dies after it wrote ``table`` for the ``nth`` time, and is started again."""
    left = [nth]

    def die(written_table):
        left[0] -= written_table == table
        if not left[0]:
            raise Died(table)

    for _ in waves:
        try:
            run(die)
        except StreamingQueryException:
            run(lambda table: None)
            left[0] = -1


def _waves(rows, path, n):
    """Rows by arrival in ``n`` waves: what is yielded is that one more has come, in as many files as the tasks that write it."""
    rows = written(rows, "updates")
    cuts = [None, *rows.approxQuantile("arrival", [i / n for i in range(1, n)], 0.01), None]
    for low, high in zip(cuts, cuts[1:], strict=False):
        some = rows if low is None else rows.where(F.col("arrival") >= low)
        (some if high is None else some.where(F.col("arrival") < high)).write.mode("append").parquet(path)
        yield
    release(rows)


def _event_waves(spark, sf_dir):
    """Events of new messages, then edits of some and deletions of others, then all of the first again."""
    e, n = tables.events(spark, sf_dir), F.substring_index("message_id", "_", 1).cast("int") * 3 + F.substring_index("message_id", "_", -1).cast("int")
    first = e.withColumn("edited_at", F.lit(None).cast("string"))
    later = F.date_format(F.try_to_timestamp("timestamp") + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    change = e.withColumns({"is_deleted": n % 9 == 2, "is_edited": n % 9 != 2, "text": F.concat("text", F.lit(" (edited)")), "edited_at": later}).where((n % 4 == 1) | (n % 9 == 2))
    return [first, change, first]


def ingest_chunks(spark, sf_dir):
    """Chunks that continuous ingest stored of three waves of events; the writer dies inside the second batch and starts again."""
    base = new_folder(spark, "ingest")
    waves = _event_waves(spark, sf_dir)
    accounts, chats = written(tables.accounts(spark, sf_dir), "accounts"), written(tables.chats(spark, sf_dir), "chats")
    stream = lambda: spark.readStream.schema(waves[0].schema).parquet(f"{base}/in")

    def come():
        for wave in waves:
            wave.write.mode("append").parquet(f"{base}/in")
            yield

    model = lambda: embed.hashing_embedder(64)
    run = lambda after: jobs.run_to_end(stream(), sinks.ingest_sink(sinks.open_store(spark, f"{base}/store", 16), accounts, chats, model, 64, after=after), f"{base}/checkpoint")
    _dying(run, come(), "message_chunks", 2)
    release(accounts, chats)
    found = sinks.open_store(spark, f"{base}/store", 16).read("message_chunks")
    return found.select("vector_id", "owner_id", "content_part", F.md5("text").alias("text_md5"), "message_version", F.size(F.filter("embedding", lambda x: x > 0)).alias("used"), F.array_position("embedding", F.array_max("embedding")).alias("top"))


def stream_feed_updates(spark, sf_dir):
    """Updates through the feed source: a third of the records, a stream that takes them and stops, the next third, and so on from its offsets."""
    base = new_folder(spark, "feed")
    u = written(tables.updates(spark, sf_dir).withColumn("edit_ts", F.col("edit_ts").cast("timestamp")), "updates")
    low, high = u.approxQuantile("arrival", [1 / 3, 2 / 3], 0.01)
    at = F.col("arrival")
    for part in (at < low, (at >= low) & (at < high), at >= high):
        feed.append_to_feed(u.where(part), f"{base}/feed", 16, "arrival", ["message_id"])
        jobs.run_to_end(feed.stream_feed(spark, f"{base}/feed", u.schema), jobs.append_once(f"{base}/out"), f"{base}/checkpoint")
    release(u)
    found = spark.read.parquet(f"{base}/out")
    return found.select("message_id", "arrival", "kind", "update_id", F.date_format("edit_ts", _TS).alias("edit_ts"))


def operation_log(spark, sf_dir):
    m, n = tables.messages(spark, sf_dir), F.col("conv_id") + F.col("turn")
    key = F.col("message_id").alias("idempotency_key")
    log = m.select(key, F.lit("processing").alias("status"), F.lit(1).alias("attempt_count"), F.lit(None).cast("string").alias("completed_at"), F.lit(None).cast("string").alias("error"))
    results = m.where(n % 3 != 0).select(key, (n % 3 == 1).alias("ok"), F.date_format("ts", _TS).alias("at"), F.when(n % 3 == 2, "write failed").alias("error"))
    return state.operations_after(log, results)


def chunk_activity(spark, sf_dir):
    c = tables.chunks(spark, sf_dir).select("vector_id", (F.col("doc_id") % 5 != 0).alias("is_active"), "doc_id")
    table, changed = state.deactivated(c, c.where("doc_id % 3 = 0"))
    return table.select(F.when(F.col("is_active"), "active").otherwise("inactive").alias("state")).union(changed.select(F.lit("changed"))).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def owned_chats(spark, sf_dir):
    n = F.substring("chat_id", 6, 20).cast("long")
    chats = tables.chats(spark, sf_dir)
    asks = chats.select(F.when(n % 4 == 3, "owner_9").otherwise(F.col("owner_id")).alias("owner_id"), "chat_id", F.when(n % 2 == 0, F.col("account_id")).alias("account_id"))
    return state.owned_chats(chats, asks).select("owner_id", "chat_id", "title")


def effective_scope(spark, sf_dir):
    n = F.substring("chat_id", 6, 20).cast("long")
    asks = tables.chats(spark, sf_dir).select("chat_id", F.when(n % 3 == 0, "owner_9").when(n % 3 == 1, F.col("owner_id")).alias("owner_id"), F.col("owner_id").alias("auth"))
    return state.effective_scope(asks, F.col("auth")).select("chat_id", "owner_id", "overridden")


def stream_once(spark, sf_dir):
    """Redelivered updates of a stream, counted once."""
    base = f"{jobs_dir(spark)}/{uuid.uuid4().hex}"
    u = tables.updates(spark, sf_dir).withColumns({"key": F.concat_ws(":", "kind", "message_id", "update_id"), "edit_ts": F.col("edit_ts").cast("timestamp")})
    u.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(u.schema).parquet(f"{base}/in")
    jobs.run_to_end(jobs.once(stream, "key", "edit_ts", "400 days"), jobs.append_once(f"{base}/out"), f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {q.__name__: q for q in (
    edit_classify, status_counts, delete_status, message_state, tombstones, replay_protection, replacement_chunks, vector_set_diff, apply_edits, embedding_reuse, reconcile_findings,
    reconcile_report, checkpoints, account_owner, stream_edit_state, stream_once, stream_stateful_edits, stream_message_table, stream_update_results, stream_feed_updates, ingest_chunks, operation_log, chunk_activity, owned_chats, effective_scope)}

_CLASSIFIED = """s1 AS (SELECT *, kind || ':' || message_id || ':' || update_id AS key, coalesce(bool_or(kind = 'delete') OVER earlier, false) AS tomb, coalesce(bool_or(kind IN ('new', 'edit')) OVER earlier, false) AS known
  FROM updates WINDOW earlier AS (PARTITION BY message_id ORDER BY arrival, update_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s2 AS (SELECT *, kind = 'edit' AND NOT tomb AS live FROM s1),
s3 AS (SELECT *, max(CASE WHEN live THEN strftime(edit_ts, '%Y-%m-%d %H:%M:%S.%f') || update_id END) OVER (PARTITION BY message_id ORDER BY arrival, update_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM s2),
s4 AS (SELECT *, live AND coalesce(strftime(edit_ts, '%Y-%m-%d %H:%M:%S.%f') || update_id < latest, false) AS late FROM s3),
s5 AS (SELECT *, live AND row_number() OVER k > 1 AND NOT first(late) OVER k AS duplicate FROM s4 WINDOW k AS (PARTITION BY message_id, key, live ORDER BY arrival, update_id)),
s6 AS (SELECT *, CASE kind WHEN 'delete' THEN CASE WHEN tomb THEN 'skipped' WHEN NOT known THEN 'not_found' ELSE 'ok' END WHEN 'new' THEN CASE WHEN tomb THEN 'blocked' WHEN known THEN 'ignore' ELSE 'created' END
  ELSE CASE WHEN NOT live THEN 'deleted' WHEN duplicate THEN 'duplicate' WHEN late THEN 'stale' WHEN NOT known THEN 'upsert' ELSE 'apply' END END AS status FROM s5),
classified AS (SELECT *, CASE WHEN status IN ('apply', 'upsert', 'created') THEN CAST(sum(CASE WHEN status = 'apply' THEN 1 ELSE 0 END) OVER (PARTITION BY message_id ORDER BY arrival, update_id) + 1 AS BIGINT) END AS version FROM s6)"""
_C = with_tables("updates", more=_CLASSIFIED)
_CLASSIFY = _C + "SELECT message_id, arrival, kind, update_id, status, version FROM classified"
_EDITS = """edits AS (SELECT account_id, chat_id, message_id, turn, ['text', 'pdf', 'docx', 'pptx', 'image', 'voice', 'document'][(conv_id + turn) % 7 + 1] AS kind, coalesce(trim(CASE WHEN turn % 5 <> 0 THEN text END), '') AS caption,
  coalesce(CASE WHEN turn % 5 <> 0 THEN text END, '') AS body FROM messages),
repl AS (SELECT *, CASE WHEN kind IN ('pdf', 'docx', 'pptx', 'voice') THEN turn % 4 ELSE 1 END AS n FROM edits),
repl1 AS (SELECT *, unnest(range(0, CAST(n AS BIGINT))) AS chunk_index FROM repl),
repl2 AS (SELECT *, 'telegram:' || account_id || ':' || chat_id || ':' || message_id || ':' || kind || ':' || chunk_index AS vector_id, CASE kind WHEN 'text' THEN body WHEN 'image' THEN trim(concat_ws(' ', nullif(caption, ''), 'read text')) WHEN 'document' THEN caption
  ELSE trim(concat_ws(' ', nullif(caption, ''), CASE WHEN kind = 'pdf' AND chunk_index = 0 THEN 'first page' ELSE CASE kind WHEN 'pdf' THEN 'PDF page ' WHEN 'docx' THEN 'DOCX section ' WHEN 'pptx' THEN 'PPTX slide ' ELSE 'Voice segment ' END || (chunk_index + 1) || ' content' END)) END AS content FROM repl1)"""
_WORLD = """w AS (SELECT *, conv_id * 3 + turn AS n, account_id || ':' || chat_id || ':' || message_id AS subject FROM messages),
m AS (SELECT *, n % 5 <> 0 AS is_edited, n % 6 = 0 AS is_deleted, ['completed', 'processing', 'failed', 'cleanup_pending'][n % 4 + 1] AS processing_status, n % 3 <> 1 AS has_chunk, n % 7 <> 0 AS active FROM w),
findings AS (
  SELECT 1 AS rule, 'telegram:edit:' || subject || ':' || strftime(ts, '%Y-%m-%dT%H:%M:%S') AS subject, 'mark_failed' AS repair FROM m WHERE n % 8 = 0 AND ts < TIMESTAMP '2024-03-01 00:00:00' - INTERVAL 15 MINUTE
  UNION ALL SELECT 2, subject, 'deactivate_and_delete_vectors' FROM m WHERE is_deleted AND has_chunk AND active
  UNION ALL SELECT 3, subject, 'delete_inactive_chunks' FROM m WHERE is_edited AND NOT is_deleted AND processing_status = 'cleanup_pending' AND has_chunk AND NOT active
  UNION ALL SELECT 4, subject, 'reconciliation_no_active_chunks' FROM m WHERE is_edited AND NOT is_deleted AND processing_status IN ('processing', 'failed') AND NOT (has_chunk AND active)
  UNION ALL SELECT 5, subject, 'delete_vectors' FROM m WHERE n % 12 = 0 AND has_chunk)"""

_STATE_SQL = _C + """SELECT message_id, max(version) AS current_version, bool_or(kind = 'edit' AND version IS NOT NULL) AS is_edited, bool_or(kind = 'delete') AS is_deleted, max_by(update_id, CASE WHEN version IS NOT NULL THEN arrival END) AS last_update_id, count(*) AS n_updates
      FROM classified GROUP BY message_id HAVING max(version) IS NOT NULL OR bool_or(kind = 'delete')"""
#: Of each piece of content that was let in: the text that it ends up with, whether it was there before its edit, and what its embedding shows.
_STORED = _decisions("false") + r""",
pieces AS (SELECT p.*, c.indexing_enabled AND CAST(p.timestamp[1:19] AS TIMESTAMP) >= c.enabled_at AS let_in, CAST(split_part(message_id, '_', 1) AS BIGINT) * 3 + CAST(split_part(message_id, '_', 2) AS BIGINT) AS k FROM parts p JOIN chats c USING (owner_id, account_id, chat_id)),
fate AS (SELECT *, k % 9 = 2 AND NOT is_deleted AS later_gone, (k % 4 = 1) AND k % 9 <> 2 AS edited FROM pieces WHERE let_in AND NOT is_deleted),
kept AS (SELECT *, coalesce(body, att_name) AS name, CASE WHEN edited AND NOT att THEN body || ' (edited)' ELSE coalesce(body, att_name) END AS said FROM fate WHERE NOT later_gone),
bodies AS (SELECT *, trim(said) AS cap, CASE WHEN content_type IN ('voice', 'video') THEN upper(content_type[1]) || content_type[2:] || ' segment 1 content' WHEN content_type = 'pdf' THEN 'PDF page 1 content' WHEN content_type = 'docx' THEN 'DOCX section 1 content' END AS stand_in FROM kept),
stored AS (SELECT owner_id, content_type, edited AND NOT att AS edited, true AS was, 'telegram:' || account_id || ':' || chat_id || ':' || sid || ':' || CASE WHEN content_type = 'link' THEN 'text' ELSE content_type END || ':0' AS vector_id,
  CASE WHEN content_type IN ('text', 'link') THEN said WHEN stand_in IS NOT NULL THEN trim(concat_ws(' ', nullif(cap, ''), stand_in)) ELSE cap END AS content FROM bodies),
words AS (SELECT vector_id, CAST('0x' || md5(w)[1:8] AS BIGINT) % 64 AS d, count(*) AS n FROM (SELECT vector_id, unnest(regexp_extract_all(lower(content), '[^\x20\x09-\x0D]+')) AS w FROM stored) GROUP BY 1, 2),
sums AS (SELECT vector_id, count(*) AS used, arg_min(d, 64 * -n + d) + 1 AS top FROM words GROUP BY 1)"""

ORACLE_SQL = {
    "edit_classify": _CLASSIFY,
    "stream_edit_state": _CLASSIFY,
    "status_counts": _C + "SELECT CASE kind WHEN 'delete' THEN 'delete_sync' WHEN 'edit' THEN 'edit_sync' ELSE 'ingest' END AS handler, status, count(*) AS n FROM classified GROUP BY 1, 2",
    "delete_status": _C + "SELECT message_id, arrival, status FROM classified WHERE kind = 'delete'",
    "message_state": _STATE_SQL,
    "tombstones": with_tables("updates") + "SELECT message_id, strftime(min(edit_ts), '%Y-%m-%d %H:%M:%S') AS deleted_at FROM updates WHERE kind = 'delete' GROUP BY message_id",
    "replay_protection": with_tables("updates") + "SELECT message_id, arrival, kind FROM updates WHERE kind <> 'delete' AND message_id NOT IN (SELECT message_id FROM updates WHERE kind = 'delete')",
    "replacement_chunks": with_tables("messages", more=_EDITS) + "SELECT vector_id, kind AS content_part, CAST(chunk_index AS INT) AS chunk_index, md5(content) AS text_md5, CAST(CASE WHEN kind = 'pdf' THEN chunk_index + 1 END AS INT) AS page_number, CAST(CASE WHEN kind = 'pptx' THEN chunk_index + 1 END AS INT) AS slide_number FROM repl2",
    "vector_set_diff": with_tables("messages", more=_EDITS) + "SELECT message_id, count(*) FILTER (chunk_index % 2 = 0) AS n_reused, count(*) FILTER (chunk_index % 2 = 1) AS n_new, count(*) FILTER (chunk_index = 0) AS n_stale FROM repl2 GROUP BY account_id, chat_id, message_id",
    "apply_edits": with_tables("messages", more=_EDITS) + """SELECT vector_id, 2 AS message_version, true AS is_active FROM repl2 WHERE kind <> 'docx' UNION ALL SELECT vector_id, 1, true FROM repl2 WHERE kind = 'docx' AND chunk_index % 2 = 0
      UNION ALL SELECT vector_id || ':old', 1, true FROM repl2 WHERE kind = 'docx' AND chunk_index = 0""",
    "embedding_reuse": with_tables("chunks") + "SELECT vector_id, doc_id % 4 <> 0 AS reused FROM chunks",
    "reconcile_findings": with_tables("messages", more=_WORLD) + "SELECT * FROM findings",
    "reconcile_report": with_tables("messages", more=_WORLD) + "SELECT rule, repair, count(*) AS n FROM findings GROUP BY 1, 2",
    "checkpoints": with_tables("updates") + "SELECT account_id, arg_max(message_id, printf('%012d', arrival) || update_id) AS last_message_id, strftime(max(edit_ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM updates GROUP BY account_id",
    "account_owner": with_tables("updates", "accounts") + "SELECT u.account_id, coalesce(a.owner_id, 'default') AS owner_id, count(*) AS n FROM updates u LEFT JOIN accounts a ON u.account_id = a.account_id AND a.account_id <> 'acc_3' GROUP BY 1, 2",
    "stream_stateful_edits": _CLASSIFY,
    "stream_update_results": _CLASSIFY,
    "stream_message_table": _STATE_SQL,
    "stream_feed_updates": with_tables("updates") + "SELECT message_id, arrival, kind, update_id, strftime(edit_ts, '%Y-%m-%d %H:%M:%S') AS edit_ts FROM updates",
    "ingest_chunks": with_tables("raw_events", "chats", more=_STORED) + """SELECT vector_id, owner_id, CASE WHEN content_type = 'link' THEN 'text' ELSE content_type END AS content_part, md5(content) AS text_md5, CAST(CASE WHEN was AND edited THEN 2 ELSE 1 END AS BIGINT) AS message_version, coalesce(used, 0) AS used, coalesce(top, 1) AS top
      FROM stored LEFT JOIN sums USING (vector_id)""",
    "operation_log": with_tables("messages") + """SELECT message_id AS idempotency_key, CASE n % 3 WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' ELSE 'processing' END AS status, CAST(CASE WHEN n % 3 = 2 THEN 2 ELSE 1 END AS INT) AS attempt_count,
      CASE WHEN n % 3 = 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS completed_at, CASE WHEN n % 3 = 2 THEN 'write failed' END AS error FROM (SELECT *, conv_id + turn AS n FROM messages)""",
    "chunk_activity": with_tables("chunks") + """SELECT CASE WHEN doc_id % 5 <> 0 AND doc_id % 3 <> 0 THEN 'active' ELSE 'inactive' END AS state, count(*) AS n FROM chunks GROUP BY 1
      UNION ALL SELECT 'changed', count(*) FROM chunks WHERE doc_id % 3 = 0 AND doc_id % 5 <> 0""",
    "owned_chats": with_tables("chats") + "SELECT owner_id, chat_id, title FROM chats WHERE NOT is_deleted AND CAST(substr(chat_id, 6) AS BIGINT) % 4 <> 3",
    "effective_scope": with_tables("chats") + "SELECT chat_id, owner_id, CAST(substr(chat_id, 6) AS BIGINT) % 3 = 0 AS overridden FROM chats",
    "stream_once": with_tables("updates") + "SELECT kind, count(DISTINCT kind || message_id || update_id) AS n FROM updates GROUP BY kind",
}
