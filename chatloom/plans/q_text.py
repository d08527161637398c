"""Normalisation, policy, chat texts and snippets."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatloom.operators import normalize, policy, snippet
from chatloom.plans.sql_tables import with_tables
from chatloom.scratch import scratch_dir as jobs_dir
from chatloom.sources import tables
from chatloom.streaming import jobs

_TS = "yyyy-MM-dd HH:mm:ss"


def _objects(spark, sf_dir):
    return normalize.normalize(tables.events(spark, sf_dir))


def normalize_events(spark, sf_dir):
    return _objects(spark, sf_dir).select(
        "stable_id", "owner_id", "sender_name", "content_type", F.md5("text").alias("text_md5"), F.date_format("ts", _TS).alias("ts"), F.col("attachment.file_id").alias("file_id"), "is_edited", "is_deleted", "kind", "has_text", "has_attachment", "is_indexable")


def rejected_events(spark, sf_dir):
    return normalize.split_events(tables.events(spark, sf_dir))[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def content_type_map(spark, sf_dir):
    e = tables.events(spark, sf_dir)
    return e.groupBy("message_type", F.col("attachment.mime_type").alias("mime_type")).agg(F.count(F.lit(1)).alias("n")).withColumn("content_type", normalize.content_type(F.col("message_type"), F.col("mime_type")))


def _decided(spark, sf_dir):
    objects = _objects(spark, sf_dir)
    processed = objects.where(F.pmod(F.length("stable_id"), F.lit(3)) == 0).select("stable_id")
    return policy.decide(objects, tables.accounts(spark, sf_dir), tables.chats(spark, sf_dir), processed)


def ingest_decisions(spark, sf_dir):
    return _decided(spark, sf_dir).select("stable_id", "action", "reason")


def decision_summary(spark, sf_dir):
    return policy.decision_summary(_decided(spark, sf_dir))


def dedup_new(spark, sf_dir):
    u = tables.updates(spark, sf_dir).select(policy.idempotency_key(F.col("kind"), F.col("account_id"), F.col("chat_id"), F.col("message_id"), F.col("update_id"), F.col("edit_ts")).alias("vector_id"))
    done = u.where(F.col("vector_id").endswith("7"))
    return policy.new_only(u, done)


def segment_messages(spark, sf_dir):
    return normalize.segment(tables.chat_lines(spark, sf_dir), "conv_id").select("conv_id", "message_no", F.md5("message").alias("message_md5"), "n_lines", "fallback_split")


def segment_lines(spark, sf_dir):
    """The same of exports that come line by line, in no order, over many partitions."""
    lines = tables.chat_lines(spark, sf_dir).select("conv_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    found = normalize.segment_lines(lines.repartition(17, "pos"), ["conv_id"], ["pos"])
    return found.select("conv_id", "message_no", F.md5("message").alias("message_md5"), "n_lines", "fallback_split")


def parsed_messages(spark, sf_dir):
    rows = normalize.segment(tables.chat_lines(spark, sf_dir), "conv_id")
    rows = rows.withColumns(normalize.parse_line(F.split("message", "\n")[0]))
    return rows.select("conv_id", "message_no", F.date_format(normalize.chat_time(F.col("stamp")), _TS).alias("ts"), "sender", F.md5("body").alias("body_md5"))


def chunk_stats(spark, sf_dir):
    return normalize.chunk_stats(tables.chat_lines(spark, sf_dir), "conv_id")


def query_terms(spark, sf_dir):
    b = tables.table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.array_join(snippet.query_terms(snippet.preprocess(F.col("text"))), " ").alias("terms"))


def _pairs(spark, sf_dir):
    """Whole questions with whole chat texts: each query asks the conversations of one remainder by 25, so all queries and texts take part.

    Pairs by ids, then the questions and the texts.
    """
    q = tables.query_vectors(spark, sf_dir).select("query_id", "question", F.expr("query_id DIV 20 % 25").alias("q"))
    lines = tables.chat_lines(spark, sf_dir)
    asks, texts = q.select("query_id", "q", snippet.question_id(F.col("question")).alias("question_id")), lines.select("conv_id", snippet.text_id(F.col("text")).alias("text_id"))
    return texts.join(asks, F.col("conv_id") % 25 == F.col("q")).select("query_id", "conv_id", *snippet.PAIR), (q, lines)


def message_scores(spark, sf_dir):
    pairs, parts = _pairs(spark, sf_dir)
    return snippet.scored_messages(pairs, ["query_id", "conv_id"], parts=parts, message=False).select("query_id", "conv_id", "message_no", "exact", "partial", "score")


def snippets(spark, sf_dir):
    pairs, parts = _pairs(spark, sf_dir)
    return snippet.snippets(pairs, ["query_id", "conv_id"], parts=parts)


def stream_ingest(spark, sf_dir):
    """The decisions of ``ingest_decisions`` without a table of processed ids, by a stream over the message table's files."""
    import uuid

    base = f"{jobs_dir(spark)}/{uuid.uuid4().hex}"
    e = tables.events(spark, sf_dir)
    e.write.parquet(f"{base}/in")
    accounts, chats = tables.accounts(spark, sf_dir), tables.chats(spark, sf_dir)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 4).parquet(f"{base}/in")
    jobs.run_to_end(jobs.ingest(stream, accounts, chats), jobs.append_once(f"{base}/out"), f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").groupBy("action", "reason").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {q.__name__: q for q in (
    normalize_events, rejected_events, content_type_map, ingest_decisions, decision_summary, dedup_new, segment_messages, segment_lines, parsed_messages, chunk_stats, query_terms, message_scores, snippets, stream_ingest)}

_KIND = """CASE WHEN message_type = 'document' AND has_att THEN CASE mime_type WHEN 'application/pdf; x=1' THEN 'pdf' WHEN 'application/msword' THEN 'docx' WHEN 'image/png' THEN 'image' ELSE 'document' END
  ELSE CASE message_type WHEN 'text' THEN 'text' WHEN 'photo' THEN 'image' WHEN 'document' THEN 'document' WHEN 'voice' THEN 'voice' WHEN 'video' THEN 'video' WHEN 'poll' THEN 'system' ELSE 'document' END END"""
_OBJECTS = f"""usable AS (SELECT *, {_KIND} AS own FROM raw_events WHERE chat_id IS NOT NULL AND timestamp <> 'junk'),
parts AS (
  SELECT *, 'system' AS content_type, NULL AS body, message_id AS sid, false AS att FROM usable WHERE is_deleted
  UNION ALL SELECT *, CASE WHEN own NOT IN ('text', 'link') AND NOT has_att THEN own WHEN contains(text, 'http://') OR contains(text, 'https://') THEN 'link' ELSE 'text' END, text, message_id, false FROM usable WHERE NOT is_deleted AND trim(coalesce(text, '')) <> ''
  UNION ALL SELECT *, own, NULL, message_id || ':attachment', true FROM usable WHERE NOT is_deleted AND has_att
), objects AS (
  SELECT 'telegram:' || account_id || ':' || chat_id || ':' || sid AS stable_id, owner_id, account_id, chat_id, CASE WHEN trim(sender_name) <> '' THEN sender_name END AS sender_name, content_type, md5(body) AS text_md5,
    strftime(CAST(timestamp[1:19] AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS ts, CASE WHEN att THEN file_id END AS file_id, is_edited, is_deleted, CASE WHEN is_deleted THEN 'delete' WHEN is_edited THEN 'edit' ELSE 'new' END AS kind,
    trim(coalesce(body, '')) <> '' AS has_text, att AS has_attachment, NOT is_deleted AS is_indexable FROM parts
)"""
_CASES = [
    ("c.chat_id IS NULL OR NOT c.indexing_enabled", "ignore", "chat is not enabled for indexing"),
    ("CAST(o.ts AS TIMESTAMP) < c.enabled_at", "ignore", "message is older than the chat''s activation"),
    ("o.is_deleted", "process_delete", "message was deleted"),
    ("NOT o.is_edited AND processed", "ignore", "already processed"),
    ("o.is_edited", "process_edit", "message was edited"),
]


def _decisions(processed):
    case = lambda i: "CASE " + " ".join(f"WHEN {x[0].replace('processed', processed)} THEN '{x[i]}'" for x in _CASES) + (" ELSE 'process' END" if i == 1 else " ELSE 'new message' END")
    return _OBJECTS + f""", decided AS (SELECT o.stable_id, {case(1)} AS action, {case(2)} AS reason
FROM objects o LEFT JOIN chats c ON o.owner_id = c.owner_id AND o.account_id = c.account_id AND o.chat_id = c.chat_id)"""


_STAMP = r"\d{1,2}/\d{1,2}/\d{2,4},\s*\d{1,2}:\d{2}(?:\s*[AP]M)?"
_SENT, _STATED = rf"^({_STAMP})\s*-\s*([^:]+?):\s*(.*)$", rf"^({_STAMP})\s*-\s*(.+)$"
_SEGMENTS = f"""raw_lines AS (SELECT conv_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM chat_lines),
marked AS (SELECT *, regexp_matches(line, '{_SENT}') OR regexp_matches(line, '{_STATED}') AS opens FROM raw_lines),
flagged AS (SELECT *, NOT bool_or(opens) OVER (PARTITION BY conv_id) AS fallback_split FROM marked),
kept_lines AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS nth FROM flagged WHERE NOT fallback_split OR trim(line) <> ''),
numbered_lines AS (SELECT *, sum(CASE WHEN opens OR fallback_split OR nth = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS message_no FROM kept_lines),
segments AS (SELECT conv_id, CAST(message_no AS BIGINT) AS message_no, string_agg(line, chr(10) ORDER BY pos) AS message, CAST(count(*) AS INT) AS n_lines, bool_or(fallback_split) AS fallback_split FROM numbered_lines GROUP BY conv_id, message_no),
parsed AS (SELECT *, string_split(message, chr(10))[1] AS first_line, regexp_matches(first_line, '{_SENT}') AS sent, CASE WHEN regexp_matches(first_line, '{_STATED}') THEN regexp_extract(first_line, '{_STATED}', 1) END AS stamp,
  CASE WHEN sent THEN regexp_extract(first_line, '{_SENT}', 2) END AS sender,
  CASE WHEN sent THEN regexp_extract(first_line, '{_SENT}', 3) WHEN stamp IS NOT NULL THEN regexp_extract(first_line, '{_STATED}', 2) ELSE first_line END AS body,
  coalesce(try_strptime(stamp, '%m/%d/%Y, %I:%M %p'), try_strptime(stamp, '%m/%d/%Y, %H:%M')) AS ts FROM segments)"""
_STOP = ", ".join(f"'{w}'" for w in snippet.STOP_WORDS)
_CLEAN = r"nullif(regexp_replace(trim(regexp_replace({0}, '[\r\n]+', ' ', 'g')), '[ \t]+', ' ', 'g'), '')"
_TERMS = r"list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'), lambda w: NOT list_contains([{1}], w) AND length(w) > 1)"


def _terms(column):
    return _TERMS.format(_CLEAN.format(column), _STOP)


_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"


def snippet_sql(messages, asked, on):
    """Expressions up to ``cut_out``, one row for each of ``asked(query_id, key, question)``, over the messages of ``_SEGMENTS``."""
    body = "CASE WHEN contains(s.message, chr(10)) THEN s.message ELSE s.body END"
    return f"""terms_of AS (SELECT *, coalesce({_terms("question")}, []) AS terms FROM {asked}),
met AS (SELECT t.*, s.message_no, s.message, s.n_lines, s.fallback_split, lower(s.message) AS low, {_WORDS.format("s.message")} AS words,
  list_distinct(list_filter({_WORDS.format(body)}, lambda w: regexp_full_match(w, '[a-z]{{3,}}') AND NOT list_contains([{_STOP}], w))) AS tokens
  FROM terms_of t JOIN {messages} s ON {on}),
counted AS (SELECT *, list_transform(terms, lambda t: len(list_filter(words, lambda x: x = t))) AS found FROM met),
rated AS (SELECT *, CAST(coalesce(list_sum(found), 0) AS INT) AS exact, CAST(len(list_filter(range(1, len(terms) + 1), lambda i: found[i] = 0 AND contains(low, terms[i]))) AS INT) AS partial, exact * 10 + partial * 2 AS score FROM counted),
beside AS (SELECT *, score > 0 OR coalesce(lag(score) OVER w > 0 AND list_has_any(tokens, lag(tokens) OVER w), false) OR coalesce(lead(score) OVER w > 0 AND list_has_any(tokens, lead(tokens) OVER w), false) AS taken
  FROM rated WINDOW w AS (PARTITION BY query_id, key ORDER BY message_no)),
chains AS (SELECT query_id, key, any_value(terms) AS terms, bool_or(fallback_split) AS fallback_split, string_agg(low, chr(10)) AS all_low,
  list({{'used': CAST(0 AS BIGINT), 'own': [message_no], 'lines': CAST(greatest(n_lines, 1) AS BIGINT)}} ORDER BY -score, message_no) FILTER (taken) AS chain FROM beside GROUP BY query_id, key),
chosen_nos AS (SELECT *, list_reduce(list_prepend({{'used': CAST(0 AS BIGINT), 'own': CAST([] AS BIGINT[]), 'lines': CAST(0 AS BIGINT)}}, coalesce(chain, [])), lambda a, x:
  CASE WHEN a.used + x.lines <= 8 OR a.used = 0 AND x.lines > 8 THEN {{'used': a.used + x.lines, 'own': list_concat(a.own, x.own), 'lines': a.lines}} ELSE a END).own AS nos,
  list_filter(terms, lambda t, i: list_position(terms, t) = i AND contains(all_low, t)) AS hit FROM chains),
summed AS (SELECT c.query_id, c.key, any_value(c.hit) AS hit, bool_or(c.fallback_split) AS fallback_split, string_agg(b.message, chr(10) ORDER BY b.message_no) AS joined, count(b.message_no) AS n, coalesce(sum(b.exact), 0) AS e,
  coalesce(sum(b.partial) FILTER (b.score > 0), 0) AS p1, coalesce(sum(b.exact) FILTER (b.score > 0), 0) AS e1, coalesce(string_agg(CAST(b.message_no AS VARCHAR), ',' ORDER BY b.message_no) FILTER (b.score > 0), '') AS nos
  FROM chosen_nos c LEFT JOIN beside b ON b.query_id = c.query_id AND b.key = c.key AND list_contains(c.nos, b.message_no) GROUP BY c.query_id, c.key),
cut_out AS (SELECT a.query_id, a.key, CASE WHEN n > 0 THEN array_to_string(list_slice(string_split(joined, chr(10)), 1, 8), chr(10)) END AS focused_snippet, CASE WHEN n > 0 THEN array_to_string(hit, ',') END AS matched_terms,
  CASE WHEN n > 0 THEN nullif(concat_ws('; ', CASE WHEN len(hit) > 0 AND e > 0 THEN 'Matched keyword: ''' || hit[1] || ''' (' || e || ' occurrence' || CASE WHEN e <> 1 THEN 's' ELSE '' END || ')' END,
    CASE WHEN len(hit) > 1 THEN 'also matched: ' || array_to_string(list_transform(hit[2:], lambda t: '''' || t || ''''), ', ') END,
    CASE WHEN p1 > 0 AND e1 = 0 THEN 'Substring match (' || p1 || ' occurrence' || CASE WHEN p1 <> 1 THEN 's' ELSE '' END || ')' END), '') END AS relevance_reason,
  CASE WHEN n > 0 THEN nos END AS matched_messages, coalesce(n, 0) = 0 AS no_strong_passage, coalesce(fallback_split, false) AS fallback_split FROM {asked} a LEFT JOIN summed USING (query_id, key))"""


_PAIRS_SQL = f"""{_SEGMENTS}, asked AS (SELECT query_id, conv_id AS key, question FROM query_vectors JOIN (SELECT DISTINCT conv_id FROM chat_lines) ON query_id // 20 % 25 = conv_id % 25),
""" + snippet_sql("parsed", "asked", "s.conv_id = t.key")

ORACLE_SQL = {
    "normalize_events": with_tables("raw_events", more=_OBJECTS) + "SELECT * EXCLUDE (account_id, chat_id) FROM objects",
    "rejected_events": with_tables("raw_events") + "SELECT CASE WHEN chat_id IS NULL THEN 'missing chat id' ELSE 'bad timestamp' END AS reason, count(*) AS n FROM raw_events WHERE chat_id IS NULL OR timestamp = 'junk' GROUP BY 1",
    "content_type_map": with_tables("raw_events") + f"SELECT message_type, CASE WHEN has_att THEN mime_type END AS mime_type, {_KIND} AS content_type, count(*) AS n FROM raw_events GROUP BY 1, 2, 3",
    "ingest_decisions": with_tables("raw_events", "chats", more=_decisions("length(o.stable_id) % 3 = 0")) + "SELECT * FROM decided",
    "decision_summary": with_tables("raw_events", "chats", more=_decisions("length(o.stable_id) % 3 = 0")) + "SELECT action, reason, count(*) AS n FROM decided GROUP BY 1, 2",
    "stream_ingest": with_tables("raw_events", "chats", more=_decisions("false")) + "SELECT action, reason, count(*) AS n FROM decided GROUP BY 1, 2",
    "dedup_new": with_tables("updates") + "SELECT DISTINCT 'telegram:' || kind || ':' || account_id || ':' || chat_id || ':' || message_id || ':' || update_id AS vector_id FROM updates WHERE NOT suffix(update_id, '7')",
    "segment_messages": with_tables("chat_lines", more=_SEGMENTS) + "SELECT conv_id, message_no, md5(message) AS message_md5, n_lines, fallback_split FROM segments",
    "segment_lines": with_tables("chat_lines", more=_SEGMENTS) + "SELECT conv_id, message_no, md5(message) AS message_md5, n_lines, fallback_split FROM segments",
    "parsed_messages": with_tables("chat_lines", more=_SEGMENTS) + "SELECT conv_id, message_no, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, sender, md5(body) AS body_md5 FROM parsed",
    "chunk_stats": with_tables("chat_lines", more=_SEGMENTS) + r"""SELECT conv_id, count(*) AS message_count, count(*) FILTER (left_out <> '') AS attachment_count, bool_or(left_out = 'image') AS contains_images, bool_or(left_out = 'audio') AS contains_audio,
      bool_or(left_out = 'video') AS contains_video, bool_or(left_out = 'document') AS contains_documents, coalesce(string_agg(DISTINCT sender, ',' ORDER BY sender), '') AS participants, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start_timestamp,
      strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS end_timestamp, CAST(epoch(max(ts)) - epoch(min(ts)) AS BIGINT) AS duration_seconds, round(avg(length(message)), 6) AS average_message_length
      FROM (SELECT *, lower(regexp_extract(message, '(image|video|audio|document|sticker)\s+omitted', 1, 'i')) AS left_out FROM parsed) GROUP BY conv_id""",
    "query_terms": f"SELECT item_id, array_to_string({_terms('text')}, ' ') AS terms FROM benchmark",
    "message_scores": with_tables("chat_lines", "query_vectors", more=_PAIRS_SQL) + "SELECT query_id, key AS conv_id, message_no, exact, partial, score FROM rated",
    "snippets": with_tables("chat_lines", "query_vectors", more=_PAIRS_SQL) + "SELECT query_id, key AS conv_id, * EXCLUDE (query_id, key) FROM cut_out",
}
