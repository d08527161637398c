"""Schemas of events and stored rows. Ids are opaque strings; timestamps are TIMESTAMP in a UTC session."""

from __future__ import annotations

from pyspark.sql import types as T

CHAT_SOURCE = "telegram"

ATTACHMENT = T.StructType().add("file_id", "string").add("filename", "string").add("mime_type", "string").add("file_size", "long").add("duration_seconds", "integer")

EVENT = (
    T.StructType()
    .add("account_id", "string").add("chat_id", "string").add("sender_id", "string").add("sender_name", "string")
    .add("message_id", "string").add("message_type", "string").add("text", "string").add("timestamp", "string")
    .add("edited_at", "string").add("attachment", ATTACHMENT).add("reply_to_message_id", "string")
    .add("forwarded_from", "string").add("is_edited", "boolean").add("is_deleted", "boolean")
)

#: Columns of a stored vector that a filter may name, with their kinds.
FILTER_FIELDS = {
    "source_chat": "string", "start_timestamp": "string", "end_timestamp": "string", "chunk_index": "number", "message_count": "number",
    "token_count": "number", "attachment_count": "number", "contains_images": "boolean", "contains_audio": "boolean",
    "contains_video": "boolean", "contains_documents": "boolean",
}

#: All content types.
CONTENT_TYPES = ("text", "link", "pdf", "docx", "pptx", "image", "voice", "video", "sticker", "document", "system")

#: What the message types of an event stand for.
MESSAGE_TYPES = {
    "text": "text", "link": "link", "photo": "image", "video": "video", "audio": "voice", "voice": "voice", "document": "document",
    "sticker": "sticker", "animation": "video", "video_note": "video", "contact": "system", "location": "system", "poll": "system",
    "system": "system", "unknown": "text",
}

#: Media types that refine the message type "document".
MIME_TYPES = {
    "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/msword": "docx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "application/vnd.ms-powerpoint": "pptx",
    "image/jpeg": "image", "image/png": "image", "image/gif": "image", "image/webp": "image", "video/mp4": "video", "video/webm": "video",
    "audio/ogg": "voice", "audio/mpeg": "voice", "audio/mp4": "voice",
}

#: The fields of a stored vector's flat metadata, with their kinds; a missing value becomes "", 0 or false.
METADATA = {
    "owner_id": "string", "source": "string", "source_account_id": "string", "conversation_id": "string", "conversation_title": "string", "conversation_type": "string",
    "sender_id": "string", "sender_name": "string", "source_message_id": "string", "content_type": "string", "timestamp": "string", "filename": "string", "mime_type": "string",
    "attachment_id": "string", "reply_to_message_id": "string", "chunk_index": "bigint", "is_edited": "boolean", "is_deleted": "boolean", "source_chat": "string",
    "start_timestamp": "string", "end_timestamp": "string", "message_count": "bigint", "token_count": "bigint", "attachment_count": "bigint", "contains_images": "boolean",
    "contains_audio": "boolean", "contains_video": "boolean", "contains_documents": "boolean", "embedding_model": "string", "schema_version": "string",
}

#: The operational tables: columns, and those that rows are dealt by. Ids are strings. The latter make a row unique, but for chunks,
#: which lie together by message and are unique by vector_id.
OPERATIONAL = {
    "accounts": (
        "owner_id string, account_id string, display_name string, username string, phone string, authorization_status string, session_status string, is_active boolean, "
        "connected_at timestamp, last_active_at timestamp, created_at timestamp, updated_at timestamp",
        ("owner_id", "account_id"),
    ),
    "chats": (
        "owner_id string, account_id string, chat_id string, title string, chat_type string, indexing_enabled boolean, enabled_at timestamp, last_processed_message_id string, is_deleted boolean, "
        "created_at timestamp, updated_at timestamp",
        ("account_id", "chat_id"),
    ),
    "messages": (
        "account_id string, chat_id string, message_id string, current_version bigint, is_edited boolean, is_deleted boolean, is_known boolean, n_applied bigint, latest_ts timestamp, latest_update_id string, "
        "last_update_id string, took_at bigint, n_updates bigint",
        ("account_id", "chat_id", "message_id"),
    ),
    "attachments": (
        "account_id string, chat_id string, message_id string, file_id string, filename string, mime_type string, file_size bigint, checksum string, download_status string, processing_status string, is_deleted boolean",
        ("account_id", "chat_id", "message_id", "file_id"),
    ),
    "message_chunks": (
        "owner_id string, account_id string, chat_id string, message_id string, source_message_id string, vector_id string, content_part string, chunk_index int, page_number int, slide_number int, "
        "text string, embedding array<float>, message_version bigint, as_of timestamp, is_active boolean",
        ("account_id", "chat_id", "message_id"),
    ),
    "processing_states": (
        "idempotency_key string, account_id string, chat_id string, message_id string, operation_type string, status string, attempt_count int, last_error_code string, started_at timestamp, completed_at timestamp",
        ("idempotency_key",),
    ),
    "deletion_tombstones": ("account_id string, chat_id string, message_id string, deleted_at timestamp", ("account_id", "chat_id", "message_id")),
    "checkpoints": ("account_id string, last_message_id string, last_ts timestamp, last_arrival bigint", ("account_id",)),
}
