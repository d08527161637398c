"""Which events are indexed, and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.schemas import CHAT_SOURCE


def decide(objects: DataFrame, accounts: DataFrame, chats: DataFrame, processed: DataFrame | None = None, type_preferences: dict[str, bool] | None = None) -> DataFrame:
    """``objects`` with ``action`` and ``reason``; the first rule that fits counts.

    Not the owner's account, chat not enabled, older than the chat's activation: ignored. Deleted: process_delete. A new
    message already processed: ignored. Edited: process_edit. Else process. ``type_preferences`` may switch off kinds
    of content, after the chat's rules. ``processed`` holds ``stable_id``. One left join each to accounts, chats and processed
    ids; the first two are as small as the installation and are broadcast by size.
    """
    a = accounts.select(F.col("owner_id").alias("a_owner"), F.col("account_id").alias("a_account")).distinct().withColumn("a_known", F.lit(True))
    c = chats.select(F.col("owner_id").alias("c_owner"), F.col("account_id").alias("c_account"), F.col("chat_id").alias("c_chat"), F.col("indexing_enabled").alias("c_enabled"), F.col("enabled_at").alias("c_from")).dropDuplicates(["c_owner", "c_account", "c_chat"])
    met = objects.join(a, (F.col("owner_id") == F.col("a_owner")) & (F.col("source_account_id") == F.col("a_account")), "left")
    met = met.join(c, (F.col("owner_id") == F.col("c_owner")) & (F.col("source_account_id") == F.col("c_account")) & (F.col("conversation_id") == F.col("c_chat")), "left")
    if processed is None:
        met = met.withColumn("p_known", F.lit(None).cast("boolean"))
    else:
        p = processed.select(F.col("stable_id").alias("p_id")).distinct().withColumn("p_known", F.lit(True))
        met = met.join(p, F.col("stable_id") == F.col("p_id"), "left").drop("p_id")
    unwanted = F.lit(False)
    for kind, wanted in (type_preferences or {}).items():
        if not wanted:
            unwanted |= F.col("content_type") == kind
    rules: list[tuple[Column, str, str]] = [
        (F.col("a_known").isNull(), "ignore", "account is not the owner's"),
        (~F.coalesce("c_enabled", F.lit(False)), "ignore", "chat is not enabled for indexing"),
        (F.coalesce(F.col("ts") < F.col("c_from"), F.lit(False)), "ignore", "message is older than the chat's activation"),
        (unwanted, "ignore", "content type is switched off"),
        (F.col("is_deleted"), "process_delete", "message was deleted"),
        (~F.col("is_edited") & F.coalesce("p_known", F.lit(False)), "ignore", "already processed"),
        (F.col("is_edited"), "process_edit", "message was edited"),
    ]
    action, reason = F.lit("process"), F.lit("new message")
    for test, then, why in reversed(rules):
        action, reason = F.when(test, then).otherwise(action), F.when(test, why).otherwise(reason)
    return met.withColumns({"action": action, "reason": reason}).drop("a_owner", "a_account", "a_known", "c_owner", "c_account", "c_chat", "c_enabled", "c_from", "p_known")


def decision_summary(decided: DataFrame) -> DataFrame:
    return decided.groupBy("action", "reason").agg(F.count(F.lit(1)).alias("n"))


def new_only(rows: DataFrame, processed: DataFrame, key: str = "vector_id") -> DataFrame:
    """One row for each key that is not processed yet."""
    return rows.dropDuplicates([key]).join(processed.select(key).distinct(), key, "left_anti")


def idempotency_key(kind: Column, account: Column, chat: Column, message: Column, update_id: Column, ts: Column) -> Column:
    """Same key, same operation: the update's id, else its time, tells operations on one message apart."""
    last = F.coalesce(update_id, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("unknown"))
    return F.concat_ws(":", F.lit(CHAT_SOURCE), kind, account, chat, message, last)


def with_owner(events: DataFrame, accounts: DataFrame, default_owner: str = "default") -> DataFrame:
    """``events`` with the owner of their account, or the default one."""
    a = accounts.groupBy(F.col("account_id").alias("a_account")).agg(F.min("owner_id").alias("a_owner"))
    return events.join(a, F.col("account_id") == F.col("a_account"), "left").withColumn("owner_id", F.coalesce("a_owner", F.lit(default_owner))).drop("a_account", "a_owner")
