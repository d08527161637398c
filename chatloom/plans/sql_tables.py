"""DuckDB twins of ``sources/tables.py``: common table expressions to put before a query."""

from __future__ import annotations

EPOCH = "TIMESTAMP '2024-01-01 00:00:00'"

_TABLES = {
    "messages": f"""SELECT 'owner_' || conv_id % 5 AS owner_id, 'acc_' || conv_id % 5 AS account_id, 'chat_' || conv_id AS chat_id,
      conv_id || '_' || turn AS message_id, role AS sender_id, upper(role[1]) || lower(role[2:]) AS sender_name, text,
      {EPOCH} + to_minutes(CAST(conv_id * 60 + turn AS BIGINT)) AS ts, conv_id, turn FROM conversations""",
    "chats": f"""SELECT DISTINCT 'owner_' || conv_id % 5 AS owner_id, 'acc_' || conv_id % 5 AS account_id, 'chat_' || conv_id AS chat_id,
      'Chat ' || conv_id AS title, conv_id % 7 <> 0 AS indexing_enabled, {EPOCH} + to_minutes(360) AS enabled_at, conv_id % 11 = 0 AS is_deleted FROM conversations""",
    "accounts": "SELECT DISTINCT owner_id, account_id FROM chats",
    "updates0": """SELECT event_id, ts, user_id, event_type, user_id || '_' || CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS message_id FROM events""",
    "updates1": "SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY ts, event_id) AS n FROM updates0",
    "updates": """SELECT 'acc_' || user_id % 5 AS account_id, 'chat_' || user_id AS chat_id, message_id,
      CASE WHEN event_type = 'error' THEN 'delete' WHEN event_type = 'purchase' THEN 'edit' WHEN n = 1 THEN 'new' ELSE 'edit' END AS kind,
      ts AS edit_ts, lpad(CAST(event_id AS VARCHAR), 12, '0') AS update_id, 10 * (2 * n - CASE WHEN n % 3 = 0 THEN 3 ELSE 0 END) + again AS arrival
      FROM updates1, (SELECT unnest([0, 1]) AS again) WHERE again = 0 OR event_id % 13 = 0""",
    "chunks": f"""SELECT 'col_' || label % 3 AS collection, 'v' || doc_id AS vector_id, text, embedding, 'owner_' || label % 3 AS owner_id,
      CASE WHEN label < 8 THEN 'telegram' ELSE 'other' END AS source, 'acc_' || label % 3 AS account_id, 'chat_' || label AS conversation_id,
      CASE WHEN doc_id % 6 <> 0 THEN 'Chat ' || label END AS conversation_title, d.source AS sender_id,
      CASE WHEN doc_id % 9 = 0 THEN '  ' ELSE upper(d.source[1]) || lower(d.source[2:]) END AS sender_name, 'm' || doc_id // 2 AS source_message_id,
      ['text', 'link', 'pdf', 'image', 'voice', 'video', 'document', 'sticker'][doc_id % 8 + 1] AS content_type,
      {EPOCH} + to_hours(CAST(doc_id AS BIGINT)) AS ts, CASE WHEN doc_id % 4 = 1 THEN 'file' || doc_id || ['.pdf', '.docx', '.txt'][doc_id % 3 + 1] END AS filename,
      doc_id % 5 AS chunk_index, CAST(ceil(n_chars / 4) AS BIGINT) AS token_count, doc_id % 3 + 1 AS message_count, doc_id % 8 = 3 AS contains_images, doc_id % 17 = 0 AS is_deleted, doc_id, CAST(label AS BIGINT) AS label
      FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id""",
    "query_vectors": f"""SELECT vec_id AS query_id, embedding AS query_vector, text AS question, 'owner_' || label % 3 AS owner_id, 5 AS top_k,
      CASE WHEN vec_id // 20 % 3 = 0 THEN 'telegram' END AS source, CASE WHEN vec_id // 20 % 2 = 1 THEN {EPOCH} + to_hours(100) END AS time_from,
      CASE WHEN vec_id // 20 % 4 = 1 THEN {EPOCH} + to_hours(1500) END AS time_to FROM embeddings JOIN benchmark ON vec_id // 20 % 40 = item_id WHERE vec_id % 20 = 0""",
    "event_rows": """SELECT *, (conv_id + turn) AS n FROM messages""",
    "raw_events": """SELECT account_id, CASE WHEN conv_id % 29 <> 3 THEN chat_id END AS chat_id, sender_id, CASE WHEN turn % 6 = 5 THEN '  ' ELSE sender_name END AS sender_name, message_id,
      ['text', 'photo', 'document', 'voice', 'video', 'poll', 'gift'][n % 7 + 1] AS message_type,
      CASE WHEN turn % 5 = 4 THEN NULL WHEN turn % 4 = 3 THEN 'see https://example.org ' || text ELSE text END AS text,
      CASE WHEN n % 31 = 30 THEN 'junk' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') END AS timestamp,
      n % 7 IN (1, 2, 3, 4) AND turn % 3 <> 2 AS has_att, 'file_' || message_id AS file_id, message_id || '.bin' AS att_name,
      ['application/pdf; x=1', 'application/msword', 'image/png', 'text/plain'][n % 4 + 1] AS mime_type, n * 100 AS file_size,
      turn % 9 = 8 AS is_edited, turn % 13 = 12 AS is_deleted, owner_id FROM event_rows""",
    "line_parts": """SELECT conv_id, turn, CASE WHEN conv_id % 5 = 4 THEN text ELSE strftime(ts, '%-m/%-d/%Y, %-H:%M') || ' - ' || CASE WHEN turn % 7 = 6 THEN '' ELSE sender_id || ': ' END || text END AS line FROM messages""",
    "chat_lines": "SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS text FROM line_parts GROUP BY conv_id",
}
_NEEDS = {
    "accounts": ("chats",), "updates1": ("updates0",), "updates": ("updates1",), "event_rows": ("messages",), "raw_events": ("event_rows",),
    "line_parts": ("messages",), "chat_lines": ("line_parts",),
}


def with_tables(*names: str, more: str = "") -> str:
    """``WITH`` and the named tables, those that they need first; ``more`` follows as further expressions."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for x in _NEEDS.get(name, ()):
            add(x)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({_TABLES[n]})" for n in ordered] + ([more] if more else [])
    return "WITH " + ",\n".join(parts) + "\n"
