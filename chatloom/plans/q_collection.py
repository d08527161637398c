"""Collections, embeddings, metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatloom.operators import collection, embed, embed_cache, stored
from chatloom.plans.sql_tables import with_tables
from chatloom.scratch import new_folder
from chatloom.sources import tables

DIM = 64


def _stored(chunks):
    """The part of the chunks that counts as stored already."""
    return chunks.where(F.col("doc_id") % 3 == 0)


def _incoming(chunks):
    return chunks.where(F.col("doc_id") % 2 == 0)


def insert_ignore(spark, sf_dir):
    c = tables.chunks(spark, sf_dir).select("collection", "vector_id", "doc_id")
    return collection.insert_ignore(_stored(c), _incoming(c))[0]


def storage_summary(spark, sf_dir):
    c = tables.chunks(spark, sf_dir).select("collection", "vector_id", "doc_id")
    return collection.storage_summary(_stored(c), _incoming(c))


def upsert_latest(spark, sf_dir):
    c = tables.chunks(spark, sf_dir)
    columns = ["vector_id", "token_count", "filename", "seq"]
    old = _stored(c).withColumn("seq", F.lit(1)).select(*columns)
    new = _incoming(c).withColumns({"seq": (F.col("doc_id") % 4).cast("int"), "token_count": F.col("token_count") + 1, "filename": F.when(F.col("doc_id") % 4 == 0, "renamed.pdf")}).select(*columns)
    return collection.upsert_latest(old, new, ["vector_id"], "seq", keep_old_values=True)


def update_missing(spark, sf_dir):
    c = tables.chunks(spark, sf_dir).select("vector_id", "token_count", "doc_id")
    return collection.update_existing(_stored(c), _incoming(c))[1]


def delete_by_ids(spark, sf_dir):
    c = tables.chunks(spark, sf_dir).select("vector_id", "doc_id")
    return collection.delete_by_ids(_stored(c), _incoming(c))[1]


def delete_by_message(spark, sf_dir):
    c = tables.chunks(spark, sf_dir)
    return collection.delete_by_message(c, c.where("is_deleted")).select("vector_id", "source_message_id")


def get_by_ids(spark, sf_dir):
    c = tables.chunks(spark, sf_dir).select("vector_id", "content_type", "doc_id")
    return collection.get_by_ids(_stored(c), _incoming(c))


def _registry(spark, sf_dir):
    return tables.chunks(spark, sf_dir).where("collection <> 'col_2'").select(
        "collection", F.lit("model-a").alias("embedding_model"), F.lit("1").alias("schema_version"), F.lit("cosine").alias("distance_metric")).distinct()


def list_collections(spark, sf_dir):
    return collection.list_collections(tables.chunks(spark, sf_dir), _registry(spark, sf_dir))


def collection_guard(spark, sf_dir):
    wanted = tables.chunks(spark, sf_dir).select("collection").distinct().select(
        "collection", F.when(F.col("collection") == "col_1", "model-b").otherwise("model-a").alias("embedding_model"), F.lit("1").alias("schema_version"), F.lit("l2").alias("distance_metric"))
    return collection.check_guard(_registry(spark, sf_dir), wanted)


def migration_report(spark, sf_dir):
    c = tables.chunks(spark, sf_dir).select("collection", "vector_id", "doc_id")
    return collection.migration_report(_incoming(c), _stored(c))


def migration_totals(spark, sf_dir):
    return collection.migration_totals(migration_report(spark, sf_dir))


def flatten_metadata(spark, sf_dir):
    return collection.flat_metadata(tables.chunks(spark, sf_dir))


def _with_extra(spark, sf_dir):
    """Chunks with an open map of pages, and of keys that clash with fields."""
    d = F.col("doc_id")
    extra = F.to_json(F.struct(F.when(d % 3 == 0, d % 7).alias("page_number"), F.when(d % 5 == 0, "another name").alias("sender_name"), F.when(d % 7 == 0, d / 4).alias("chunk_index"), F.when(d % 11 == 0, True).alias("is_edited")))
    return tables.chunks(spark, sf_dir).withColumn("extra", F.when(d % 13 != 1, F.from_json(extra, "map<string,variant>")))


def vector_metadata(spark, sf_dir):
    """Every field of every chunk's metadata, as text and kind."""
    found = collection.vector_metadata(_with_extra(spark, sf_dir)).select("vector_id", F.explode("metadata").alias("field", "v"))
    kind = F.regexp_replace(F.schema_of_variant("v"), r"DECIMAL.*|DOUBLE", "NUMBER")
    return found.select("vector_id", "field", F.when(kind == "NUMBER", F.col("v").cast("double").cast("string")).otherwise(F.col("v").cast("string")).alias("value"), kind.alias("kind"))


def typed_metadata(spark, sf_dir):
    found = collection.vector_metadata(_with_extra(spark, sf_dir))
    return found.select("vector_id", *(collection.typed(F.col("metadata"), f).alias(f) for f in ("sender_name", "token_count", "is_edited", "contains_audio", "source_chat")))


def mandatory_metadata(spark, sf_dir):
    c = tables.chunks(spark, sf_dir).withColumn("owner_id", F.when(F.col("doc_id") % 10 == 3, " ").otherwise(F.col("owner_id")))
    good, bad = collection.mandatory_split(c)
    return good.select(F.lit("valid").alias("part")).union(bad.select(F.lit("quarantine"))).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def _cache(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents").where("doc_id % 5 = 0")
    return d.select(embed.cache_key(F.col("text")).alias("key"), F.col("doc_id").alias("inserted_at"))


def embed_cache_split(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    return embed.split_by_cache(d, _cache(spark, sf_dir)).select("doc_id", "key", "hit")


def cache_stats(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    return embed.cache_stats(embed.split_by_cache(d, _cache(spark, sf_dir)), _cache(spark, sf_dir))


def cache_evict(spark, sf_dir):
    return embed.evict(_cache(spark, sf_dir), 100)


def vector_quality(spark, sf_dir):
    v = tables.table(spark, sf_dir, "embeddings")
    n = F.col("vec_id") % 7
    broken = F.when(n == 1, F.expr("CAST(array() AS ARRAY<FLOAT>)")).when(n == 2, F.transform("embedding", lambda x: x * 0)).when(n == 3, F.slice("embedding", 1, 10)).when(n == 4, F.transform("embedding", lambda x: (x * 2).cast("float"))).otherwise(F.col("embedding"))
    v = v.select("vec_id", broken.alias("v"))
    return v.groupBy(F.coalesce(embed.vector_problem(F.col("v"), DIM), F.lit("ok")).alias("problem"), F.coalesce(embed.is_normalised(F.col("v")), F.lit(False)).alias("unit")).agg(F.count(F.lit(1)).alias("n"))


def embed_corpus(spark, sf_dir):
    """All documents embedded by the stand-in model, equal texts once; what is returned can be recomputed by the tests."""
    d = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = embed.embed(d, lambda: embed.hashing_embedder(DIM), DIM)
    used = F.size(F.filter("embedding", lambda x: x > 0))
    top = F.when(used > 0, F.array_position("embedding", F.array_max("embedding")))
    return out.select("doc_id", F.size("embedding").alias("dim"), F.round(embed.squared_norm(F.col("embedding")), 4).alias("squared_norm"), used.alias("used"), top.alias("top"))


def embed_cache_runs(spark, sf_dir):
    """Three runs over a stored cache, with room for half of the texts: a third of the documents, all of them, and the last half."""
    d = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    store = stored.Store(spark, new_folder(spark, "cache"), embed_cache.TABLE, buckets=8)
    n, seen = d.count(), []
    for i, some in enumerate((d.where("doc_id % 3 = 0"), d, d.where("doc_id % 2 = 1"))):
        _, did = embed_cache.run(store, some, lambda: embed.hashing_embedder(DIM), DIM, 2 * i, most=n // 2)
        seen.append((i, did["hits"], did["misses"], did["evicted"], did["size"]))
    return spark.createDataFrame(seen, "run int, hits bigint, misses bigint, evicted bigint, size bigint")


def stored_chats(spark, sf_dir):
    """The chat table in store: written, then some of its keys upserted (nulls leave old values), some added, some deleted, each by the buckets of its keys."""
    store = stored.Store(spark, new_folder(spark, "store"), buckets=16)
    c, n = tables.chats(spark, sf_dir), F.regexp_extract("chat_id", r"\d+", 0).cast("long")
    none = lambda kind: F.lit(None).cast(kind)
    rows = c.select("owner_id", "account_id", "chat_id", "title", none("string").alias("chat_type"), "indexing_enabled", "enabled_at", none("string").alias("last_processed_message_id"), "is_deleted", F.col("enabled_at").alias("created_at"), F.col("enabled_at").alias("updated_at"))
    merge = stored.latest_by(["account_id", "chat_id"], "updated_at", keep_old_values=True)
    later = F.expr("enabled_at + INTERVAL 1 DAY")
    changed = rows.where(n % 10 == 3).withColumns({"title": F.when(n % 20 == 3, F.concat("title", F.lit("!"))), "is_deleted": ~F.col("is_deleted"), "updated_at": F.when(n % 30 == 13, F.expr("enabled_at - INTERVAL 1 DAY")).otherwise(later)})
    added = rows.where(n % 10 == 7).withColumns({"chat_id": F.concat("chat_id", F.lit("_new")), "updated_at": later})
    for batch, some in enumerate((rows, changed.union(added))):
        store.upsert("chats", some, batch, merge)
        store.commit(batch)
    store.delete("chats", rows.where(n % 13 == 5).union(added.where(n % 20 == 7)), 2)
    store.commit(2)
    store.vacuum()
    return store.read("chats").select("account_id", "chat_id", "title", "is_deleted", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


QUERIES = {q.__name__: q for q in (
    insert_ignore, storage_summary, upsert_latest, update_missing, delete_by_ids, delete_by_message, get_by_ids, list_collections, collection_guard, migration_report,
    migration_totals, flatten_metadata, vector_metadata, typed_metadata, mandatory_metadata, embed_cache_split, cache_stats, cache_evict, vector_quality, embed_corpus, embed_cache_runs, stored_chats)}

_REPORT = """report AS (SELECT collection, count(*) FILTER (old) AS old_count, count(*) FILTER (old AND NOT there) AS inserted, count(*) FILTER (old AND there) AS skipped, count(*) AS new_count,
  CASE WHEN count(*) FILTER (old AND NOT there) > 0 THEN 'migrated' ELSE 'already_done' END AS status FROM (SELECT collection, doc_id % 2 = 0 AS old, doc_id % 3 = 0 AS there FROM chunks) WHERE old OR there GROUP BY collection HAVING old_count > 0)"""
_CACHED = "cached AS (SELECT sha256(text) AS key, doc_id AS inserted_at FROM documents WHERE doc_id % 5 = 0)"

_FIELDS = {
    "owner_id": "owner_id", "source": "source", "source_account_id": "''", "conversation_id": "conversation_id", "conversation_title": "coalesce(conversation_title, '')", "conversation_type": "''", "sender_id": "sender_id",
    "source_message_id": "source_message_id", "content_type": "content_type", "timestamp": "strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00')", "filename": "coalesce(filename, '')", "mime_type": "''", "attachment_id": "''",
    "reply_to_message_id": "''", "is_deleted": "is_deleted", "source_chat": "coalesce(conversation_title, conversation_id)", "start_timestamp": "''", "end_timestamp": "''", "message_count": "message_count",
    "token_count": "token_count", "attachment_count": "0", "contains_images": "contains_images", "contains_audio": "false", "contains_video": "false", "contains_documents": "false", "embedding_model": "''", "schema_version": "''",
}
_KINDS = {"chunk_index": "BIGINT", "message_count": "BIGINT", "token_count": "BIGINT", "attachment_count": "BIGINT", "is_edited": "BOOLEAN", "is_deleted": "BOOLEAN"} | {f"contains_{x}": "BOOLEAN" for x in ("images", "audio", "video", "documents")}
_HAS_EXTRA = "doc_id % 13 <> 1"
_METADATA = "c AS (SELECT * FROM chunks)\n" + "\nUNION ALL ".join(["SELECT vector_id, 'owner_id' AS field, owner_id AS value, 'STRING' AS kind FROM chunks"] + [f"SELECT vector_id, '{f}', CAST({x} AS VARCHAR), '{_KINDS.get(f, 'STRING')}' FROM chunks" for f, x in _FIELDS.items() if f != "owner_id"] + [
    f"SELECT vector_id, 'page_number', CAST(doc_id % 7 AS VARCHAR), 'BIGINT' FROM chunks WHERE doc_id % 3 = 0 AND {_HAS_EXTRA}",
    f"SELECT vector_id, 'sender_name', CASE WHEN doc_id % 5 = 0 AND {_HAS_EXTRA} THEN 'another name' ELSE sender_name END, 'STRING' FROM chunks",
    f"SELECT vector_id, 'chunk_index', CASE WHEN doc_id % 7 = 0 AND {_HAS_EXTRA} THEN CAST(doc_id / 4 AS VARCHAR) ELSE CAST(chunk_index AS VARCHAR) END, CASE WHEN doc_id % 7 = 0 AND {_HAS_EXTRA} THEN 'NUMBER' ELSE 'BIGINT' END FROM chunks",
    f"SELECT vector_id, 'is_edited', CAST(doc_id % 11 = 0 AND {_HAS_EXTRA} AS VARCHAR), 'BOOLEAN' FROM chunks",
])

ORACLE_SQL = {
    "embed_cache_runs": """WITH t AS (SELECT sha256(text) AS key, bool_or(doc_id % 3 = 0) AS third, bool_or(doc_id % 2 = 1) AS odd FROM documents WHERE trim(coalesce(text, '')) <> '' GROUP BY 1),
room AS (SELECT count(*) // 2 AS most FROM documents),
run0 AS (SELECT key, 0 AS inserted FROM t WHERE third ORDER BY key LIMIT (SELECT most FROM room)),
made1 AS (SELECT key, 1 AS inserted FROM t WHERE key NOT IN (SELECT key FROM run0)),
run1 AS (SELECT * FROM (SELECT * FROM run0 UNION ALL SELECT * FROM made1) ORDER BY inserted DESC, key LIMIT (SELECT most FROM room)),
made2 AS (SELECT key, 2 AS inserted FROM t WHERE odd AND key NOT IN (SELECT key FROM run1)),
run2 AS (SELECT * FROM (SELECT * FROM run1 UNION ALL SELECT * FROM made2) ORDER BY inserted DESC, key LIMIT (SELECT most FROM room)),
n AS (SELECT (SELECT count(*) FROM t) AS t, (SELECT count(*) FROM t WHERE third) AS third, (SELECT count(*) FROM t WHERE odd) AS odd, (SELECT count(*) FROM run0) AS r0, (SELECT count(*) FROM made1) AS m1, (SELECT count(*) FROM run1) AS r1,
  (SELECT count(*) FROM made2) AS m2, (SELECT count(*) FROM run2) AS r2)
SELECT CAST(0 AS INT) AS run, 0 AS hits, third AS misses, third - r0 AS evicted, r0 AS size FROM n UNION ALL SELECT 1, t - m1, m1, r0 + m1 - r1, r1 FROM n UNION ALL SELECT 2, odd - m2, m2, r1 + m2 - r2, r2 FROM n""",
    "vector_metadata": with_tables("chunks", more=_METADATA.partition("\n")[0]) + _METADATA.partition("\n")[2],
    "typed_metadata": with_tables("chunks") + f"SELECT vector_id, CASE WHEN doc_id % 5 = 0 AND {_HAS_EXTRA} THEN 'another name' ELSE sender_name END AS sender_name, token_count, doc_id % 11 = 0 AND {_HAS_EXTRA} AS is_edited, false AS contains_audio, coalesce(conversation_title, conversation_id) AS source_chat FROM chunks",
    "stored_chats": with_tables("chats", more="""c AS (SELECT *, CAST(substr(chat_id, 6) AS BIGINT) AS n, n % 10 = 3 AND n % 30 <> 13 AS changed FROM chats),
both_kinds AS (SELECT account_id, chat_id, CASE WHEN changed AND n % 20 = 3 THEN title || '!' ELSE title END AS title, is_deleted <> changed AS is_deleted, enabled_at + CASE WHEN changed THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS upd FROM c WHERE n % 13 <> 5
  UNION ALL SELECT account_id, chat_id || '_new', title, is_deleted, enabled_at + INTERVAL 1 DAY FROM c WHERE n % 10 = 7 AND n % 20 <> 7)""") + "SELECT account_id, chat_id, title, is_deleted, strftime(upd, '%Y-%m-%d %H:%M:%S') AS updated_at FROM both_kinds",
    "insert_ignore": with_tables("chunks") + "SELECT collection, vector_id, doc_id FROM chunks WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0",
    "storage_summary": with_tables("chunks") + """SELECT collection, count(*) FILTER (doc_id % 2 = 0) AS received, count(*) FILTER (doc_id % 2 = 0 AND doc_id % 3 <> 0) AS inserted, count(*) FILTER (doc_id % 6 = 0) AS skipped,
      count(*) AS final_count FROM chunks WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 GROUP BY collection""",
    "upsert_latest": with_tables("chunks") + """SELECT vector_id, CASE WHEN newer THEN token_count + 1 ELSE token_count END AS token_count, CASE WHEN newer AND doc_id % 4 = 0 THEN 'renamed.pdf' WHEN doc_id % 3 = 0 THEN filename END AS filename,
      CAST(CASE WHEN newer THEN doc_id % 4 ELSE 1 END AS INT) AS seq FROM (SELECT *, doc_id % 2 = 0 AND (doc_id % 3 <> 0 OR doc_id % 4 >= 1) AS newer FROM chunks WHERE doc_id % 2 = 0 OR doc_id % 3 = 0)""",
    "update_missing": with_tables("chunks") + "SELECT vector_id FROM chunks WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0",
    "delete_by_ids": with_tables("chunks") + "SELECT count(*) FILTER (doc_id % 2 = 0) AS requested, count(*) FILTER (doc_id % 6 = 0) AS deleted FROM chunks",
    "delete_by_message": with_tables("chunks") + "SELECT vector_id, source_message_id FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM chunks d WHERE d.is_deleted AND d.owner_id = c.owner_id AND d.source = c.source AND d.account_id = c.account_id AND d.conversation_id = c.conversation_id AND d.source_message_id = c.source_message_id)",
    "get_by_ids": with_tables("chunks") + "SELECT vector_id, content_type, doc_id FROM chunks WHERE doc_id % 6 = 0",
    "list_collections": with_tables("chunks") + "SELECT collection, count(*) AS document_count, CASE WHEN collection = 'col_2' THEN 'unknown' ELSE 'model-a' END AS embedding_model, CASE WHEN collection = 'col_2' THEN 'unknown' ELSE '1' END AS schema_version FROM chunks GROUP BY collection",
    "collection_guard": with_tables("chunks") + "SELECT DISTINCT collection, CASE collection WHEN 'col_2' THEN 'created' WHEN 'col_1' THEN 'error: embedding model' ELSE 'warning: distance metric' END AS status FROM chunks",
    "migration_report": with_tables("chunks", more=_REPORT) + "SELECT * FROM report",
    "migration_totals": with_tables("chunks", more=_REPORT) + "SELECT CAST(sum(old_count) AS BIGINT) AS total_old, CAST(sum(inserted) AS BIGINT) AS total_inserted, CAST(sum(skipped) AS BIGINT) AS total_skipped, CAST(0 AS BIGINT) AS failed, 'PASS' AS verdict FROM report",
    "flatten_metadata": with_tables("chunks") + """SELECT vector_id, owner_id, source, coalesce(nullif(trim(conversation_title), ''), conversation_id) AS source_chat, sender_name, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS timestamp,
      coalesce(filename, '') AS filename, chunk_index, is_deleted FROM chunks""",
    "mandatory_metadata": with_tables("chunks") + "SELECT CASE WHEN doc_id % 10 = 3 THEN 'quarantine' ELSE 'valid' END AS part, count(*) AS n FROM chunks GROUP BY 1",
    "embed_cache_split": f"WITH {_CACHED} SELECT doc_id, sha256(text) AS key, sha256(text) IN (SELECT key FROM cached) AS hit FROM documents",
    "cache_stats": f"WITH {_CACHED}, s AS (SELECT sha256(text) IN (SELECT key FROM cached) AS hit FROM documents) SELECT (SELECT count(*) FROM cached) AS size, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(count(*) FILTER (hit) / count(*), 6) AS hit_rate FROM s",
    "cache_evict": f"WITH {_CACHED} SELECT * FROM cached ORDER BY inserted_at DESC, key LIMIT 100",
    "vector_quality": "SELECT CASE vec_id % 7 WHEN 1 THEN 'empty' WHEN 2 THEN 'zero' WHEN 3 THEN 'wrong dimension' ELSE 'ok' END AS problem, vec_id % 7 NOT IN (1, 2, 3, 4) AS unit, count(*) AS n FROM embeddings GROUP BY 1, 2",
    "embed_corpus": rf"""WITH counted AS (SELECT doc_id, CAST('0x' || md5(w)[1:8] AS BIGINT) % {DIM} AS d, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')) AS w FROM documents) GROUP BY 1, 2),
      per AS (SELECT doc_id, CAST(count(*) AS INT) AS used, arg_min(d, {DIM} * -n + d) + 1 AS top FROM counted GROUP BY doc_id)
      SELECT doc_id, {DIM} AS dim, CAST(CASE WHEN used > 0 THEN 1 ELSE 0 END AS DOUBLE) AS squared_norm, coalesce(used, 0) AS used, top FROM documents LEFT JOIN per USING (doc_id)""",
}
