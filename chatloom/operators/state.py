"""Upkeep of the small tables around messages: chats, chunks, operations, exported metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def owned_chats(chats: DataFrame, requests: DataFrame) -> DataFrame:
    """Chats that are not deleted and asked for by their owner; a request without an account matches any."""
    c, r = chats.where(~F.col("is_deleted")).alias("c"), requests.alias("r")
    same = (F.col("c.owner_id") == F.col("r.owner_id")) & (F.col("c.chat_id") == F.col("r.chat_id"))
    return c.join(r, same & (F.col("r.account_id").isNull() | (F.col("c.account_id") == F.col("r.account_id"))), "left_semi")


def active_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.where("is_active")


def deactivated(chunks: DataFrame, ids: DataFrame, key: str = "vector_id") -> tuple[DataFrame, DataFrame]:
    """``(the table with those chunks inactive, the ids that were active before)``."""
    wanted = ids.select(key).distinct().withColumn("_off", F.lit(True))
    met = chunks.join(wanted, key, "left")
    changed = met.where("_off AND is_active").select(key)
    return met.withColumn("is_active", F.col("is_active") & F.col("_off").isNull()).select(*chunks.columns), changed


def operations_after(log: DataFrame, results: DataFrame) -> DataFrame:
    """The operation log with results applied: completed ones get their time, failed ones an error and one more attempt.

    ``log``: idempotency_key, status, attempt_count, completed_at, error. ``results``: idempotency_key, ok, at, error.
    """
    latest = results.groupBy("idempotency_key").agg(F.max_by(F.struct("ok", "at", "error"), "at").alias("r"))
    met = log.join(latest, "idempotency_key", "left")
    ok, failed = F.coalesce(F.col("r.ok"), F.lit(False)), F.coalesce(~F.col("r.ok"), F.lit(False))
    return met.select(
        "idempotency_key", F.when(ok, "completed").when(failed, "failed").otherwise(F.col("status")).alias("status"), (F.col("attempt_count") + failed.cast("int")).alias("attempt_count"),
        F.when(ok, F.col("r.at")).otherwise(F.col("completed_at")).alias("completed_at"), F.when(failed, F.col("r.error")).otherwise(F.col("error")).alias("error"),
    )


def exported_lists(rows: DataFrame, *columns: str) -> DataFrame:
    """Array columns as JSON texts, for stores that hold flat values only; a null array is an empty one."""
    return rows.withColumns({c: F.coalesce(F.to_json(F.col(c)), F.lit("[]")) for c in columns})


def effective_scope(requests: DataFrame, auth: Column) -> DataFrame:
    """Requests with the owner that authentication gives, whatever they ask for, and what was overridden."""
    asked = F.col("owner_id")
    return requests.withColumns({"overridden": asked.isNotNull() & (asked != auth), "owner_id": auth})
