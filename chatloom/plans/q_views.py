"""Directory views and data-quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatloom.functions import phone
from chatloom.operators import increments, search, views
from chatloom.operators.stored import Store
from chatloom.plans.sql_tables import with_tables
from chatloom.scratch import new_folder
from chatloom.sources import tables


def people_directory(spark, sf_dir):
    return views.people(tables.chunks(spark, sf_dir))


def first_last_seen(spark, sf_dir):
    return views.first_last_seen(tables.messages(spark, sf_dir))


def timeline_daily(spark, sf_dir):
    return views.timeline(tables.messages(spark, sf_dir))


def media_tabs(spark, sf_dir):
    return views.media_tabs(tables.chunks(spark, sf_dir))


def document_explorer(spark, sf_dir):
    return views.documents(tables.chunks(spark, sf_dir), "pdf", "an")


def conversation_detail(spark, sf_dir):
    m = views.conversation(tables.messages(spark, sf_dir), "chat_3")
    return m.select("message_id", "sender_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


def conversation_list(spark, sf_dir):
    return views.conversations(tables.chats(spark, sf_dir), "1")


def dashboard_totals(spark, sf_dir):
    return views.totals(tables.chunks(spark, sf_dir))


def facets(spark, sf_dir):
    queries = tables.query_vectors(spark, sf_dir).select("query_id", "owner_id", "query_vector", F.lit(40).alias("top_k"))
    return views.facets(search.knn(tables.chunks(spark, sf_dir), queries), "conversation_id")


def recent_searches(spark, sf_dir):
    log = tables.table(spark, sf_dir, "events").select("user_id", F.concat_ws(" ", "event_type", F.floor(F.col("value")).cast("string")).alias("query"), "ts")
    return views.recent_searches(log).select("user_id", "query", "place")


def corpus_profile(spark, sf_dir):
    return views.corpus_profile(tables.messages(spark, sf_dir), tables.chunks(spark, sf_dir))


def _parts(spark, rows, key, number):
    """The parts after three increments, the second of which is delivered twice."""
    store = Store(spark, new_folder(spark, "view-parts"), increments.TABLE, buckets=8)
    for batch, third in ((0, 0), (1, 1), (1, 1), (2, 2)):
        increments.add(store, rows.where(F.pmod(number, F.lit(3)) == third), key, batch)
    return store.read("view_parts")


def incremental_people(spark, sf_dir):
    return increments.people(_parts(spark, tables.chunks(spark, sf_dir), "vector_id", F.col("doc_id")))


def incremental_media_tabs(spark, sf_dir):
    return increments.media_tabs(_parts(spark, tables.chunks(spark, sf_dir), "vector_id", F.col("doc_id")))


def incremental_collections(spark, sf_dir):
    return increments.collections(_parts(spark, tables.chunks(spark, sf_dir), "vector_id", F.col("doc_id")))


def incremental_timeline(spark, sf_dir):
    return increments.timeline(_parts(spark, tables.messages(spark, sf_dir), "message_id", F.col("turn")))


def incremental_seen(spark, sf_dir):
    return increments.first_last_seen(_parts(spark, tables.messages(spark, sf_dir), "message_id", F.col("turn")))


def _accounts(spark, sf_dir):
    """Customers with phone numbers, good and bad, made from their keys."""
    k = F.col("c_custkey")
    number = (
        F.when(k % 11 == 1, F.lit("  ")).when(k % 11 == 2, F.lit(" -- ")).when(k % 11 == 3, F.concat(F.lit("91 98765"), F.lpad(k.cast("string"), 6, "0"))).when(k % 11 == 4, F.lit("+")).when(k % 11 == 5, F.concat(F.lit("+91x"), k.cast("string")))
        .when(k % 11 == 6, F.concat(F.lit("+12"), k % 100)).when(k % 11 == 7, F.concat(F.lit("+1234567890123"), F.lpad(k.cast("string"), 6, "0"))).when(k % 11 == 8, F.concat(F.lit("+1 (415) 555-"), F.lpad((k % 10000).cast("string"), 4, "0")))
        .when(k % 11 == 9, F.concat(F.lit("+44 12"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("7"))).when(k % 11 == 10, F.lit("+91 ******1234")).otherwise(F.concat(F.lit("+91 98-76 "), F.lpad(k.cast("string"), 6, "0")))
    )
    return tables.table(spark, sf_dir, "customer").select("c_custkey", number.alias("phone"))


def phone_quality(spark, sf_dir):
    return phone.quality_report(_accounts(spark, sf_dir))


def phone_masked(spark, sf_dir):
    return _accounts(spark, sf_dir).select("c_custkey", phone.normalized(F.col("phone")).alias("number"), phone.masked(phone.normalized(F.col("phone"))).alias("shown"))


def phone_audit(spark, sf_dir):
    return phone.protection_audit(_accounts(spark, sf_dir))


QUERIES = {q.__name__: q for q in (
    people_directory, first_last_seen, timeline_daily, media_tabs, document_explorer, conversation_detail, conversation_list, dashboard_totals, facets, recent_searches,
    corpus_profile, phone_quality, phone_masked, phone_audit, incremental_people, incremental_media_tabs, incremental_collections, incremental_timeline, incremental_seen)}

_ACCOUNTS = """accounts AS (SELECT c_custkey, CASE c_custkey % 11 WHEN 1 THEN '  ' WHEN 2 THEN ' -- ' WHEN 3 THEN '91 98765' || printf('%06d', c_custkey) WHEN 4 THEN '+' WHEN 5 THEN '+91x' || c_custkey WHEN 6 THEN '+12' || c_custkey % 100
  WHEN 7 THEN '+1234567890123' || printf('%06d', c_custkey) WHEN 8 THEN '+1 (415) 555-' || printf('%04d', c_custkey % 10000) WHEN 9 THEN '+44 12' || printf('%03d', c_custkey % 1000) || '7' WHEN 10 THEN '+91 ******1234'
  ELSE '+91 98-76 ' || printf('%06d', c_custkey) END AS phone FROM customer),
cleaned AS (SELECT *, regexp_replace(trim(phone), '[\\s\\-()]', '', 'g') AS bare FROM accounts),
judged AS (SELECT *, CASE WHEN trim(phone) = '' THEN 'empty_input' WHEN bare = '' THEN 'empty_after_strip' WHEN bare[1] <> '+' THEN 'missing_plus_prefix' WHEN bare = '+' THEN 'no_digits' WHEN NOT regexp_full_match(bare[2:], '[0-9]+') THEN 'contains_non_digits'
  WHEN length(bare) < 8 THEN 'too_short' WHEN length(bare) > 16 THEN 'too_long' END AS problem FROM cleaned)"""
_DAY = "strftime({0}, '%Y-%m-%d %H:%M:%S')"

ORACLE_SQL = {
    "people_directory": with_tables("chunks") + "SELECT sender_id, arg_min(sender_name, strftime(ts, '%Y-%m-%d %H') || vector_id) AS sender_name, count(*) AS n_messages, count(DISTINCT conversation_id) AS n_chats FROM chunks WHERE trim(sender_id) <> '' AND trim(sender_name) <> '' GROUP BY sender_id",
    "first_last_seen": with_tables("messages") + f"SELECT owner_id, account_id, sender_id, {_DAY.format('min(ts)')} AS first_seen, {_DAY.format('max(ts)')} AS last_seen FROM messages GROUP BY ALL",
    "timeline_daily": with_tables("messages") + "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_messages, count(DISTINCT chat_id) AS n_chats, strftime(max(ts), '%H:%M') AS newest FROM messages GROUP BY 1",
    "media_tabs": with_tables("chunks") + "SELECT coalesce(content_type, 'all') AS tab, count(*) AS n FROM chunks WHERE content_type IN ('image', 'video', 'voice', 'audio', 'sticker') GROUP BY ROLLUP (content_type)",
    "document_explorer": with_tables("chunks") + """SELECT vector_id, content_type, filename, conversation_id FROM chunks WHERE (content_type IN ('pdf', 'docx', 'pptx', 'document') OR coalesce(filename, '') <> '') AND (content_type = 'pdf' OR coalesce(suffix(lower(filename), '.pdf'), false))
      AND (coalesce(contains(lower(filename), 'an'), false) OR contains(lower(text), 'an'))""",
    "conversation_detail": with_tables("messages") + f"SELECT message_id, sender_id, {_DAY.format('ts')} AS ts FROM messages WHERE chat_id = 'chat_3'",
    "conversation_list": with_tables("chats") + "SELECT indexing_enabled, count(*) AS n_chats, min(chat_id) AS first_chat FROM chats WHERE NOT is_deleted AND contains(lower(title), '1') GROUP BY 1",
    "dashboard_totals": with_tables("chunks") + "SELECT count(DISTINCT collection) AS collections, count(*) AS documents FROM chunks",
    "recent_searches": "SELECT user_id, query, row_number() OVER (PARTITION BY user_id ORDER BY last_ts DESC, query) AS place FROM (SELECT user_id, event_type || ' ' || CAST(floor(value) AS BIGINT) AS query, max(ts) AS last_ts FROM events GROUP BY 1, 2) QUALIFY place <= 10",
    "corpus_profile": with_tables("messages", "chunks") + rf"""SELECT count(*) AS messages, count(DISTINCT sender_id) AS participants, {_DAY.format('min(ts)')} AS first_message, {_DAY.format('max(ts)')} AS last_message,
      count(*) FILTER (regexp_matches(text, '[\x{{1F300}}-\x{{1FAFF}}\x{{2600}}-\x{{27BF}}]')) AS emoji_messages, count(*) FILTER (regexp_matches(text, '[\x{{0B80}}-\x{{0BFF}}]')) AS tamil_messages, count(*) FILTER (regexp_matches(text, '(?i)message was deleted|deleted this message')) AS deleted_references,
      count(*) FILTER (sender_id = 'system') AS system_messages, (SELECT count(*) FROM chunks) AS chunks, (SELECT round(avg(token_count), 6) FROM chunks) AS average_tokens FROM messages""",
    "phone_quality": "WITH " + _ACCOUNTS + " SELECT coalesce(problem, 'ok') AS status, count(*) AS n FROM judged GROUP BY 1",
    "phone_masked": "WITH " + _ACCOUNTS + """ SELECT c_custkey, CASE WHEN problem IS NULL THEN bare END AS number, CASE WHEN problem IS NULL THEN CASE WHEN length(bare) = 12 AND bare[2] = '1' THEN '+1 ******' || bare[-4:] WHEN length(bare) - 3 <= 6 THEN bare[:3] || ' ******' ELSE bare[:3] || ' ******' || bare[-4:] END END AS shown FROM judged""",
    "phone_audit": "WITH " + _ACCOUNTS + " SELECT CASE WHEN trim(phone) = '' THEN 'no_number' WHEN contains(phone, '*') THEN 'already_masked' WHEN problem IS NOT NULL THEN 'invalid' ELSE 'to_protect' END AS status, count(*) AS n FROM judged GROUP BY 1",
}


def _facets_sql() -> str:
    from chatloom.plans import q_retrieval

    hits = q_retrieval._hits_sql(k="40").replace("rank <= top_k", "rank <= 40")
    return with_tables("chunks", "query_vectors", more=hits) + "SELECT query_id, conversation_id AS value, vector_id, rank FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, conversation_id ORDER BY rank) = 1"


ORACLE_SQL["facets"] = _facets_sql()

#: Parts merge to what one aggregate over all rows gives.
ORACLE_SQL |= {f"incremental_{new}": ORACLE_SQL[old] for new, old in (("people", "people_directory"), ("media_tabs", "media_tabs"), ("timeline", "timeline_daily"), ("seen", "first_last_seen"))}
ORACLE_SQL["incremental_collections"] = with_tables("chunks") + "SELECT collection, count(*) AS document_count, round(avg(token_count), 6) AS average_tokens, count(DISTINCT sender_id) AS about_senders FROM chunks GROUP BY collection"
