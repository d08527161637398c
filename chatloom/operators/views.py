"""Directory views and reports over the chunk and message tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MEDIA = ("image", "video", "voice", "audio", "sticker")
DOCUMENT_TYPES = ("pdf", "docx", "pptx", "document", "xlsx", "txt")
RECENT = 10


def people(chunks: DataFrame, search: str | None = None) -> DataFrame:
    """Senders with message and chat counts, most active first; blank ids or names are left out."""
    kept = chunks.where((F.coalesce(F.trim("sender_id"), F.lit("")) != "") & (F.coalesce(F.trim("sender_name"), F.lit("")) != ""))
    out = kept.groupBy("sender_id").agg(F.min_by("sender_name", F.struct("ts", "vector_id")).alias("sender_name"), F.count(F.lit(1)).alias("n_messages"), F.countDistinct("conversation_id").alias("n_chats"))
    if search:
        out = out.where(F.contains(F.lower("sender_name"), F.lit(search.lower())))
    return out.orderBy(F.desc("n_messages"), "sender_id")


def first_last_seen(messages: DataFrame) -> DataFrame:
    return messages.groupBy("owner_id", "account_id", "sender_id").agg(F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_seen"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


def timeline(messages: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Messages a day, newest day first; ``start`` and ``end`` bound the days, the end excluded."""
    kept = messages
    if start:
        kept = kept.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end:
        kept = kept.where(F.col("ts") < F.lit(end).cast("timestamp"))
    day = F.date_format("ts", "yyyy-MM-dd")
    return kept.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n_messages"), F.countDistinct("chat_id").alias("n_chats"), F.date_format(F.max("ts"), "HH:mm").alias("newest")).orderBy(F.desc("day"))


def media_tabs(chunks: DataFrame) -> DataFrame:
    """Counts a media type and of all of them."""
    return chunks.where(F.col("content_type").isin(*MEDIA)).rollup("content_type").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("content_type", F.lit("all")).alias("tab"), "n")


def documents(chunks: DataFrame, tab: str = "all", search: str | None = None) -> DataFrame:
    """Chunks of documents or with a file, by tab (type or file ending), searched by file name or text."""
    kept = chunks.where(F.col("content_type").isin(*DOCUMENT_TYPES) | (F.coalesce("filename", F.lit("")) != ""))
    if tab != "all":
        kept = kept.where((F.col("content_type") == tab) | F.coalesce(F.lower("filename").endswith(f".{tab}"), F.lit(False)))
    if search:
        kept = kept.where(F.coalesce(F.contains(F.lower("filename"), F.lit(search.lower())), F.lit(False)) | F.contains(F.lower("text"), F.lit(search.lower())))
    return kept.select("vector_id", "content_type", "filename", "conversation_id")


def conversation(messages: DataFrame, chat_id: str) -> DataFrame:
    return messages.where(F.col("chat_id") == chat_id).orderBy("ts", "message_id")


def conversations(chats: DataFrame, search: str | None = None) -> DataFrame:
    """Chats that are not deleted, counted by whether they are indexed."""
    kept = chats.where(~F.col("is_deleted"))
    if search:
        kept = kept.where(F.contains(F.lower("title"), F.lit(search.lower())))
    return kept.groupBy("indexing_enabled").agg(F.count(F.lit(1)).alias("n_chats"), F.min("chat_id").alias("first_chat"))


def totals(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("collection").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("collections"), F.sum("n").alias("documents"))


def facets(hits: DataFrame, column: str) -> DataFrame:
    """The first hit of each value of a column, for each query."""
    first = F.row_number().over(Window.partitionBy("query_id", column).orderBy("rank"))
    return hits.where(F.col(column).isNotNull()).withColumn("nth", first).where("nth = 1").select("query_id", F.col(column).alias("value"), "vector_id", "rank")


def recent_searches(log: DataFrame, most: int = RECENT) -> DataFrame:
    """Each user's last distinct queries, newest first."""
    last = log.groupBy("user_id", "query").agg(F.max("ts").alias("last_ts"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("last_ts"), "query"))
    return last.withColumn("place", place).where(F.col("place") <= most)


def corpus_profile(messages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Figures of a corpus in one row: messages, people, span, emoji, Tamil and deleted texts, system messages, chunks."""
    emoji, tamil, deleted = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]", r"[\x{0B80}-\x{0BFF}]", r"(?i)message was deleted|deleted this message"
    m = messages.select("sender_id", "ts", "text", F.lit(None).cast("double").alias("tokens"), F.lit(0).alias("chunk"))
    rows = m.union(chunks.select(F.lit(None).cast("string"), F.lit(None).cast("timestamp"), F.lit(None).cast("string"), F.col("token_count").cast("double"), F.lit(1)))
    return rows.agg(
        F.count_if(F.col("chunk") == 0).alias("messages"), F.countDistinct("sender_id").alias("participants"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("first_message"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_message"),
        F.count_if(F.col("text").rlike(emoji)).alias("emoji_messages"), F.count_if(F.col("text").rlike(tamil)).alias("tamil_messages"), F.count_if(F.col("text").rlike(deleted)).alias("deleted_references"), F.count_if(F.col("sender_id") == "system").alias("system_messages"),
        F.sum("chunk").alias("chunks"), F.round(F.avg("tokens"), 6).alias("average_tokens"),
    )


def retrieval_report(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Queries run, those with a hit, and all hits."""
    found = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    per = queries.select("query_id").join(found, "query_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("n") > 0).alias("with_hits"), F.sum("n").alias("hits"))
