"""Edits and deletions: classification, replacement chunks, vector differences, message state, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.operators.normalize import vector_id
from chatloom.operators.policy import idempotency_key

MESSAGE = ("account_id", "chat_id", "message_id")
STUCK_MINUTES = 15


def classify_updates(updates: DataFrame, state: DataFrame | None = None, completed: DataFrame | None = None) -> DataFrame:
    """``updates`` in arrival order with ``status`` and ``version``; all updates of all messages at once.

    Needs account_id, chat_id, message_id, kind, edit_ts, update_id, arrival; optional ``reconstructible`` (an edit whose
    content is known in full, default true). Per message, "earlier" means an earlier arrival.

    * delete: ``skipped`` after another delete, ``not_found`` if the message is unknown, else ``ok``.
    * new: ``blocked`` after a delete, ``ignore`` if the message exists, else ``created``.
    * edit: ``deleted`` after a delete; ``failed`` if the message is unknown and can't be rebuilt; ``duplicate`` if its key was
      completed; ``stale`` if a live edit with a later time, or the same time and a greater update id, came before;
      ``upsert`` if the message is unknown; else ``apply``, with the next version.

    ``state`` (``state_after`` of earlier updates, one row a message) and ``completed`` (idempotency_key of edits that took their turn)
    stand for all that arrived before; without them there was nothing. Two windows over the rows of a message and one
    over those of a message's key; all are partitioned by message.
    """
    if "reconstructible" not in updates.columns:
        updates = updates.withColumn("reconstructible", F.lit(True))
    by_message = Window.partitionBy(*MESSAGE).orderBy("arrival", "update_id")
    earlier = by_message.rowsBetween(Window.unboundedPreceding, -1)
    edit = F.col("kind") == "edit"
    u = updates.withColumn("key", idempotency_key(F.col("kind"), *map(F.col, MESSAGE), F.col("update_id"), F.col("edit_ts")))
    if state is None:
        u = u.withColumns({"was_deleted": F.lit(False), "was_known": F.lit(False), "was_latest": F.lit(None).cast("struct<ts: timestamp, uid: string>"), "was_applied": F.lit(0).cast("bigint")})
    else:
        before = state.select(*MESSAGE, F.col("is_deleted").alias("was_deleted"), F.col("is_known").alias("was_known"), F.when(F.col("latest_ts").isNotNull(), F.struct(F.col("latest_ts").alias("ts"), F.col("latest_update_id").alias("uid"))).alias("was_latest"), F.col("n_applied").alias("was_applied"))
        u = u.join(before, list(MESSAGE), "left").withColumns({"was_deleted": F.coalesce("was_deleted", F.lit(False)), "was_known": F.coalesce("was_known", F.lit(False)), "was_applied": F.coalesce("was_applied", F.lit(0).cast("bigint"))})
    if completed is None:
        u = u.withColumn("was_completed", F.lit(False))
    else:
        u = u.join(completed.select(F.col("idempotency_key").alias("key")).distinct().withColumn("was_completed", F.lit(True)), "key", "left").withColumn("was_completed", F.coalesce("was_completed", F.lit(False)))

    def any_earlier(test: Column) -> Column:
        return F.coalesce(F.max(F.when(test, True).otherwise(False)).over(earlier), F.lit(False))

    u = u.withColumns({"tomb": F.col("was_deleted") | any_earlier(F.col("kind") == "delete"), "exists": F.col("was_known") | any_earlier((F.col("kind") == "new") | (edit & F.col("reconstructible")))})
    u = u.withColumn("live", edit & ~F.col("tomb") & (F.col("exists") | F.col("reconstructible")))
    mark = F.struct(F.col("edit_ts").cast("timestamp").alias("ts"), F.coalesce("update_id", F.lit("")).alias("uid"))
    latest = F.greatest(F.max(F.when(F.col("live") & F.col("edit_ts").isNotNull(), mark)).over(earlier), F.col("was_latest"))
    u = u.withColumn("latest", latest)
    same_time = (F.col("edit_ts") == F.col("latest.ts")) & F.col("update_id").isNotNull() & (F.col("latest.uid") != "") & (F.col("update_id") < F.col("latest.uid"))
    u = u.withColumn("late", F.col("live") & F.coalesce((F.col("edit_ts") < F.col("latest.ts")) | same_time, F.lit(False)))
    of_key = Window.partitionBy(*MESSAGE, "key", "live").orderBy("arrival", "update_id")
    first_late = F.first("late").over(of_key)
    u = u.withColumn("duplicate", F.col("live") & (F.col("was_completed") | (F.row_number().over(of_key) > 1) & ~first_late))
    status = (
        F.when(F.col("kind") == "delete", F.when(F.col("tomb"), "skipped").when(~F.col("exists"), "not_found").otherwise("ok"))
        .when(F.col("kind") == "new", F.when(F.col("tomb"), "blocked").when(F.col("exists"), "ignore").otherwise("created"))
        .when(~F.col("live"), F.when(F.col("tomb"), "deleted").otherwise("failed"))
        .when(F.col("duplicate"), "duplicate").when(F.col("late"), "stale").when(~F.col("exists"), "upsert").otherwise("apply")
    )
    u = u.withColumn("status", status)
    applied = F.col("was_applied") + F.sum(F.when(F.col("status") == "apply", 1).otherwise(0)).over(by_message.rowsBetween(Window.unboundedPreceding, 0))
    version = F.when(F.col("status").isin("apply", "upsert", "created"), applied + 1)
    return u.withColumn("version", version).drop("tomb", "exists", "live", "latest", "late", "duplicate", "reconstructible", "was_deleted", "was_known", "was_latest", "was_applied", "was_completed")


def state_after(classified: DataFrame, state: DataFrame) -> DataFrame:
    """The state of each message after ``classified`` updates, one row a message, of bounded size: what ``classify_updates`` has to know of them.

    Messages without updates keep their row. ``state``: the columns of the operational table "messages".
    """
    took = F.col("status").isin("created", "upsert", "apply")
    # live edits are those that got as far as being compared with the latest one
    live = (F.col("kind") == "edit") & F.col("status").isin("duplicate", "stale", "upsert", "apply")
    mark = F.struct(F.col("edit_ts").cast("timestamp").alias("ts"), F.coalesce("update_id", F.lit("")).alias("uid"))
    new = classified.groupBy(*MESSAGE).agg(
        F.max("version").alias("n_version"), F.bool_or((F.col("kind") == "edit") & took).alias("n_edited"), F.bool_or(F.col("kind") == "delete").alias("n_deleted"),
        F.bool_or((F.col("kind") == "new") | ((F.col("kind") == "edit") & (F.col("status") != "failed"))).alias("n_known"), F.count_if(F.col("status") == "apply").alias("n_apply"),
        F.max(F.when(live & F.col("edit_ts").isNotNull(), mark)).alias("n_latest"), F.max_by("update_id", F.when(took, F.col("arrival"))).alias("n_last"), F.max(F.when(took, F.col("arrival"))).alias("n_took"), F.count(F.lit(1)).alias("n_rows"),
    )
    met = state.join(new, list(MESSAGE), "full_outer")
    either = lambda a, b: F.coalesce(F.col(a), F.lit(False)) | F.coalesce(F.col(b), F.lit(False))
    latest = F.greatest(F.when(F.col("latest_ts").isNotNull(), F.struct(F.col("latest_ts").alias("ts"), F.col("latest_update_id").alias("uid"))), F.col("n_latest"))
    zero = F.lit(0).cast("bigint")
    newer = F.col("n_took").isNotNull() & (F.col("took_at").isNull() | (F.col("n_took") >= F.col("took_at")))
    return met.select(
        *MESSAGE, F.greatest("current_version", "n_version").cast("bigint").alias("current_version"), either("is_edited", "n_edited").alias("is_edited"), either("is_deleted", "n_deleted").alias("is_deleted"),
        either("is_known", "n_known").alias("is_known"), (F.coalesce("n_applied", zero) + F.coalesce("n_apply", zero)).alias("n_applied"), latest["ts"].alias("latest_ts"), latest["uid"].alias("latest_update_id"),
        F.when(newer, F.col("n_last")).otherwise(F.col("last_update_id")).alias("last_update_id"), F.greatest("took_at", "n_took").cast("bigint").alias("took_at"), (F.coalesce("n_updates", zero) + F.coalesce("n_rows", zero)).alias("n_updates"),
    )


def message_state(classified: DataFrame) -> DataFrame:
    """The final state of each message that exists or is tombstoned: version, flags, last applied edit."""
    took = F.col("status").isin("created", "upsert", "apply")
    state = classified.groupBy(*MESSAGE).agg(
        F.max("version").alias("current_version"), F.bool_or((F.col("kind") == "edit") & took).alias("is_edited"), F.bool_or(F.col("kind") == "delete").alias("is_deleted"),
        F.max_by("update_id", F.when(took, F.col("arrival"))).alias("last_update_id"), F.count(F.lit(1)).alias("n_updates"),
    )
    return state.where("current_version IS NOT NULL OR is_deleted")


def tombstones(deletes: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One tombstone for each deleted message, the earliest; an existing one stays."""
    new = deletes.groupBy(*MESSAGE).agg(F.min("edit_ts").alias("deleted_at"))
    if existing is None:
        return new
    return existing.select(*MESSAGE, "deleted_at").union(new.join(existing.select(*MESSAGE), list(MESSAGE), "left_anti"))


def replay_protected(rows: DataFrame, tombs: DataFrame) -> DataFrame:
    """Rows whose message has no tombstone."""
    return rows.join(tombs.select(*MESSAGE), list(MESSAGE), "left_anti")


def caption_only(current_file: Column, current_checksum: Column, new_file: Column, new_checksum: Column) -> Column:
    """An edit that changes only the caption: same file and same known checksum."""
    return F.coalesce((current_file == new_file) & (current_checksum == new_checksum), F.lit(False))


#: Chunks of a kind: the field that counts them, the field of one, what stands in for a missing one.
PARTS = {"pdf": ("page_count", "page", "PDF page"), "docx": ("section_count", "section", "DOCX section"), "pptx": ("slide_count", "slide", "PPTX slide"), "voice": ("segment_count", "segment", "Voice segment"), "video": ("segment_count", "segment", "Video segment")}


def replacement_chunks(edits: DataFrame) -> DataFrame:
    """The chunks that an edited message has from now on, with stable ids.

    ``edits``: account_id, chat_id, message_id, content_type, text, extra MAP<STRING, STRING>; optional reuse_media and media_text
    (of a caption-only edit). Text and links give one chunk; pages, sections, slides and segments one each; an image one of
    caption and read text; anything else one. A caption stands before each chunk's text.
    """
    for c, kind in (("reuse_media", "boolean"), ("media_text", "string")):
        if c not in edits.columns:
            edits = edits.withColumn(c, F.lit(None).cast(kind))
    extra = lambda key: F.element_at("extra", key)
    kind, count, stand_in, field = F.col("content_type"), F.lit(1), F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (counter, one, words) in PARTS.items():
        count = F.when(kind == name, F.coalesce(extra(F.lit(counter)).cast("int"), F.lit(1))).otherwise(count)
        field = F.when(kind == name, one).otherwise(field)
        stand_in = F.when(kind == name, words).otherwise(stand_in)
    e = edits.withColumns({"n": count, "field": field, "words": stand_in, "caption": F.coalesce(F.trim("text"), F.lit(""))}).where("n > 0")
    e = e.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    of_part = F.coalesce(extra(F.concat_ws("_", "field", F.col("chunk_index").cast("string"), F.lit("text"))), F.concat(F.col("words"), F.lit(" "), (F.col("chunk_index") + 1).cast("string"), F.lit(" content")))
    read = F.coalesce(F.when(F.coalesce("reuse_media", F.lit(False)), F.col("media_text")), extra(F.lit("ocr_text")), F.lit(""))
    body = F.when(kind.isin("text", "link"), F.coalesce("text", F.lit(""))).when(kind == "image", F.trim(F.concat_ws(" ", F.nullif("caption", F.lit("")), F.nullif(read, F.lit(""))))).when(
        F.col("field").isNotNull(), F.trim(F.concat_ws(" ", F.nullif("caption", F.lit("")), of_part))).otherwise(F.col("caption"))
    part = F.when(kind.isin("text", "link"), "text").otherwise(kind)
    return e.select(
        *MESSAGE, vector_id(*map(F.col, MESSAGE), part, F.col("chunk_index")).alias("vector_id"), part.alias("content_part"), "chunk_index", body.alias("text"),
        F.when(kind == "pdf", F.col("chunk_index") + 1).alias("page_number"), F.when(kind == "pptx", F.col("chunk_index") + 1).alias("slide_number"),
    )


def vector_set_diff(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = MESSAGE) -> DataFrame:
    """Each vector id of a message before or after an edit: ``reused``, ``new`` or ``stale``."""
    columns = [*keys, "vector_id"]
    both = old.select(*columns, F.lit(1).alias("o"), F.lit(0).alias("n")).union(new.select(*columns, F.lit(0), F.lit(1)))
    found = both.groupBy(*columns).agg(F.max("o").alias("o"), F.max("n").alias("n"))
    return found.select(*columns, F.when((F.col("o") == 1) & (F.col("n") == 1), "reused").when(F.col("n") == 1, "new").otherwise("stale").alias("change"))


def diff_counts(diff: DataFrame, keys: tuple[str, ...] = MESSAGE) -> DataFrame:
    return diff.groupBy(*keys).agg(*(F.count_if(F.col("change") == c).alias(f"n_{c}") for c in ("reused", "new", "stale")))


def reuse_embeddings(new: DataFrame, old: DataFrame) -> DataFrame:
    """New chunks with the embedding of the same id and same text, or null where it has to be computed."""
    o = old.select(F.col("vector_id").alias("o_id"), F.sha2("text", 256).alias("o_key"), "embedding")  # digests, so that old texts aren't shuffled
    keyed = new.withColumn("n_key", F.sha2("text", 256))
    return keyed.join(o, (F.col("vector_id") == F.col("o_id")) & (F.col("n_key") == F.col("o_key")), "left").drop("o_id", "o_key", "n_key")


def apply_edits(chunks: DataFrame, replacements: DataFrame, version: str = "version") -> tuple[DataFrame, DataFrame]:
    """``(chunk table after the edits, counts a message)``: a replaced message has its new chunks active and no stale ones.

    ``chunks``: MESSAGE columns, vector_id, text, message_version, is_active. ``replacements``: MESSAGE columns, vector_id, text and
    the version. The result is one new snapshot, so no reader sees a half-applied edit.
    """
    touched = replacements.select(*MESSAGE).distinct()
    old = chunks.join(touched, list(MESSAGE), "left_semi")
    counts = diff_counts(vector_set_diff(old, replacements))
    untouched = chunks.join(touched, list(MESSAGE), "left_anti")
    new = replacements.select(*MESSAGE, "vector_id", "text", F.col(version).alias("message_version"), F.lit(True).alias("is_active"))
    return untouched.select(*new.columns).union(new), counts


def apply_deletes(chunks: DataFrame, deletes: DataFrame) -> DataFrame:
    """The chunk table without the chunks of deleted messages."""
    return chunks.join(deletes.select(*MESSAGE).distinct(), list(MESSAGE), "left_anti")


def stuck_operations(operations: DataFrame, now: Column, minutes: int = STUCK_MINUTES) -> DataFrame:
    return operations.where((F.col("status") == "processing") & (F.col("started_at") < now - F.expr(f"INTERVAL {minutes} MINUTES")))


def reconcile(messages: DataFrame, chunks: DataFrame, operations: DataFrame, tombs: DataFrame, now: Column) -> DataFrame:
    """Inconsistencies found: ``rule, subject, repair``, one row for each message or operation.

    1 an operation that has been running too long: mark it failed. 2 a deleted message with active chunks: deactivate them and
    delete their vectors. 3 an edited message whose clean-up is pending: delete the vectors and rows of its inactive chunks.
    4 an edited message still processing or failed without an active chunk: mark it failed. 5 vectors of a tombstoned message:
    delete them. Runs twice with the same result once the repairs are made.
    """
    subject = F.concat_ws(":", *MESSAGE)
    active = chunks.where("is_active").select(*MESSAGE).distinct()
    inactive = chunks.where("NOT is_active").select(*MESSAGE).distinct()
    keys = list(MESSAGE)
    alive_edits = messages.where("is_edited AND NOT is_deleted")
    found = [
        (1, stuck_operations(operations, now).select(F.col("idempotency_key").alias("subject")), "mark_failed"),
        (2, messages.where("is_deleted").join(active, keys, "left_semi").select(subject.alias("subject")), "deactivate_and_delete_vectors"),
        (3, alive_edits.where("processing_status = 'cleanup_pending'").join(inactive, keys, "left_semi").select(subject.alias("subject")), "delete_inactive_chunks"),
        (4, alive_edits.where("processing_status IN ('processing', 'failed')").join(active, keys, "left_anti").select(subject.alias("subject")), "reconciliation_no_active_chunks"),
        (5, tombs.join(chunks.select(*MESSAGE).distinct(), keys, "left_semi").select(subject.alias("subject")), "delete_vectors"),
    ]
    out = None
    for rule, rows, repair in found:
        rows = rows.select(F.lit(rule).alias("rule"), "subject", F.lit(repair).alias("repair"))
        out = rows if out is None else out.union(rows)
    return out


def checkpoints(updates: DataFrame) -> DataFrame:
    """Per account, the last message id by arrival and the latest time seen; nulls don't move a mark back."""
    return updates.groupBy("account_id").agg(F.max_by("message_id", F.when(F.col("message_id").isNotNull(), F.struct("arrival", "update_id"))).alias("last_message_id"), F.max("edit_ts").alias("last_ts"))


def dispatch(updates: DataFrame) -> DataFrame:
    """Classified updates with the branch that handles each of them."""
    branch = F.when(F.col("kind") == "delete", "delete_sync").when(F.col("kind") == "edit", "edit_sync").otherwise("ingest")
    return classify_updates(updates).withColumn("handler", branch)
