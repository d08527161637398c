"""Directory views that grow with their increments: partial aggregates, kept by day and chat, merged when read.

Every aggregate in a part can be merged (counts, sums, first and last, sketches of distinct values), so an increment is aggregated alone,
added to the parts that it touches, and no view reads a message twice. A view is one aggregate over parts, of which there are as many as
days, chats, senders and kinds of content meet, whatever the number of messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.operators.stored import Store
from chatloom.operators.views import MEDIA

DIMENSIONS = ("day", "owner_id", "account_id", "chat_id", "sender_id", "content_type", "collection")
SCHEMA = (
    "day date, owner_id string, account_id string, chat_id string, sender_id string, content_type string, collection string, n bigint, named bigint, first_ts timestamp, last_ts timestamp, "
    "first_named struct<ts: timestamp, id: string, name: string>, tokens double, sized bigint, senders binary"
)
#: For ``Store(tables=...)``.
TABLE = {"view_parts": (SCHEMA, ("day", "chat_id"))}


def _own(rows: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)


def partial(rows: DataFrame, key: str) -> DataFrame:
    """The parts of some messages or chunks; ``key`` tells rows of the same time apart. Columns that ``rows`` lacks count as null."""
    chat = F.col("chat_id") if "chat_id" in rows.columns else F.col("conversation_id")
    flat = rows.select(
        F.to_date("ts").alias("day"), *(_own(rows, c).alias(c) for c in ("owner_id", "account_id")), chat.alias("chat_id"), _own(rows, "sender_id").alias("sender_id"), _own(rows, "content_type").alias("content_type"),
        _own(rows, "collection").alias("collection"), _own(rows, "ts", "timestamp").alias("ts"), F.col(key).alias("id"), _own(rows, "sender_name").alias("name"), _own(rows, "token_count", "double").alias("token_count"),
    )
    named = F.coalesce(F.trim("name"), F.lit("")) != ""
    return flat.groupBy(*DIMENSIONS).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(named).alias("named"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min(F.when(named, F.struct("ts", "id", "name"))).alias("first_named"),
        F.sum("token_count").alias("tokens"), F.count("token_count").alias("sized"), F.hll_sketch_agg(F.coalesce("sender_id", F.lit(""))).alias("senders"),
    )


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Parts of the same dimensions as one."""
    both = old.select(*old.columns).unionByName(new.select(*old.columns))
    return both.groupBy(*DIMENSIONS).agg(
        F.sum("n").alias("n"), F.sum("named").alias("named"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.min("first_named").alias("first_named"), F.sum("tokens").alias("tokens"),
        F.sum("sized").alias("sized"), F.hll_union_agg("senders").alias("senders"),
    )


def add(store: Store, rows: DataFrame, key: str, batch: int) -> None:
    """One increment: only the buckets of its days and chats are read and written, and a batch that comes again counts once."""
    if not store.is_committed(batch):
        store.upsert("view_parts", partial(rows, key), batch, merged)
        store.commit(batch)


def people(parts: DataFrame) -> DataFrame:
    """``views.people`` from parts."""
    kept = parts.where((F.coalesce(F.trim("sender_id"), F.lit("")) != "") & (F.col("named") > 0))
    out = kept.groupBy("sender_id").agg(F.min("first_named").alias("f"), F.sum("named").alias("n_messages"), F.countDistinct("chat_id").alias("n_chats"))
    return out.select("sender_id", F.col("f.name").alias("sender_name"), "n_messages", "n_chats").orderBy(F.desc("n_messages"), "sender_id")


def first_last_seen(parts: DataFrame) -> DataFrame:
    seen = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return parts.groupBy("owner_id", "account_id", "sender_id").agg(seen(F.min("first_ts")).alias("first_seen"), seen(F.max("last_ts")).alias("last_seen"))


def timeline(parts: DataFrame) -> DataFrame:
    return parts.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.sum("n").alias("n_messages"), F.countDistinct("chat_id").alias("n_chats"), F.date_format(F.max("last_ts"), "HH:mm").alias("newest")).orderBy(F.desc("day"))


def media_tabs(parts: DataFrame) -> DataFrame:
    return parts.where(F.col("content_type").isin(*MEDIA)).rollup("content_type").agg(F.sum("n").alias("n")).select(F.coalesce("content_type", F.lit("all")).alias("tab"), "n")


def collections(parts: DataFrame) -> DataFrame:
    """Documents of each collection, mean tokens, and about how many senders they have."""
    return parts.groupBy("collection").agg(F.sum("n").alias("document_count"), F.round(F.sum("tokens") / F.sum("sized"), 6).alias("average_tokens"), F.hll_sketch_estimate(F.hll_union_agg("senders")).alias("about_senders"))
