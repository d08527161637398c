"""The engine's logical tables derived from the given ones, by fixed rules (each has a twin in ``plans/sql_tables.py``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatloom.schemas import CHAT_SOURCE
from chatloom.session import table

EPOCH = "2024-01-01 00:00:00"
KINDS = ("text", "link", "pdf", "image", "voice", "video", "document", "sticker")


def _after(minutes) -> F.Column:
    return F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH)) + minutes * 60)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("owner_"), conv % 5).alias("owner_id"), F.concat(F.lit("acc_"), conv % 5).alias("account_id"), F.concat(F.lit("chat_"), conv).alias("chat_id"),
        F.concat_ws("_", conv, "turn").alias("message_id"), F.col("role").alias("sender_id"), F.initcap("role").alias("sender_name"), "text",
        _after(conv * 60 + F.col("turn")).alias("ts"), conv.alias("conv_id"), F.col("turn").alias("turn"),
    )


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    return table(spark, sf_dir, "conversations").select(conv).distinct().select(
        F.concat(F.lit("owner_"), conv % 5).alias("owner_id"), F.concat(F.lit("acc_"), conv % 5).alias("account_id"), F.concat(F.lit("chat_"), conv).alias("chat_id"),
        F.concat(F.lit("Chat "), conv).alias("title"), (conv % 7 != 0).alias("indexing_enabled"), _after(F.lit(360)).alias("enabled_at"), (conv % 11 == 0).alias("is_deleted"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats(spark, sf_dir).select("owner_id", "account_id").distinct()


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``messages`` in the shape of update events (``schemas.EVENT`` without the fields that nothing here sets)."""
    m, turn = messages(spark, sf_dir), F.col("turn")
    n = F.col("conv_id") + turn
    kinds = F.array(*(F.lit(x) for x in ("text", "photo", "document", "voice", "video", "poll", "gift")))
    mime = F.array(*(F.lit(x) for x in ("application/pdf; x=1", "application/msword", "image/png", "text/plain")))
    kind = F.element_at(kinds, (n % 7 + 1).cast("int"))
    attached = F.when((n % 7).isin(1, 2, 3, 4) & (turn % 3 != 2), F.struct(
        F.concat(F.lit("file_"), "message_id").alias("file_id"), F.concat("message_id", F.lit(".bin")).alias("filename"), F.element_at(mime, (n % 4 + 1).cast("int")).alias("mime_type"),
        (n * 100).alias("file_size"), F.lit(None).cast("int").alias("duration_seconds")))
    text = F.when(turn % 5 == 4, F.lit(None)).when(turn % 4 == 3, F.concat(F.lit("see https://example.org "), "text")).otherwise(F.col("text"))
    return m.select(
        "account_id", F.when(F.col("conv_id") % 29 != 3, F.col("chat_id")).alias("chat_id"), "sender_id", F.when(turn % 6 == 5, F.lit("  ")).otherwise(F.col("sender_name")).alias("sender_name"),
        "message_id", kind.alias("message_type"), text.alias("text"), F.when(n % 31 == 30, F.lit("junk")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).alias("timestamp"),
        attached.alias("attachment"), (turn % 9 == 8).alias("is_edited"), (turn % 13 == 12).alias("is_deleted"), F.col("owner_id"),
    )


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New, edit and delete updates in arrival order: some overtake their predecessor, some are delivered twice."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long") % 10
    e = e.select("event_id", "ts", "user_id", "event_type", F.concat_ws("_", "user_id", k).alias("message_id"))
    n = F.row_number().over(Window.partitionBy("message_id").orderBy("ts", "event_id"))
    e = e.withColumn("n", n).select(
        F.concat(F.lit("acc_"), F.col("user_id") % 5).alias("account_id"), F.concat(F.lit("chat_"), "user_id").alias("chat_id"), "message_id",
        F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "purchase", "edit").when(F.col("n") == 1, "new").otherwise("edit").alias("kind"),
        F.col("ts").alias("edit_ts"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("update_id"), (10 * (2 * F.col("n") - F.when(F.col("n") % 3 == 0, 3).otherwise(0))).alias("arrival"), "event_id",
    )
    again = F.explode(F.when(F.col("event_id") % 13 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return e.withColumn("again", again).withColumn("arrival", F.col("arrival") + F.col("again")).drop("again", "event_id")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, v = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    kinds = F.array(*(F.lit(k) for k in KINDS))
    doc, label = F.col("doc_id"), F.col("label")
    return v.join(d, v["vec_id"] == d["doc_id"]).select(
        F.concat(F.lit("col_"), label % 3).alias("collection"), F.concat(F.lit("v"), doc).alias("vector_id"), "text", "embedding", F.concat(F.lit("owner_"), label % 3).alias("owner_id"),
        F.when(label < 8, CHAT_SOURCE).otherwise("other").alias("source"), F.concat(F.lit("acc_"), label % 3).alias("account_id"), F.concat(F.lit("chat_"), label).alias("conversation_id"),
        F.when(doc % 6 != 0, F.concat(F.lit("Chat "), label)).alias("conversation_title"), F.col("source").alias("sender_id"), F.when(doc % 9 == 0, "  ").otherwise(F.initcap("source")).alias("sender_name"),
        F.concat(F.lit("m"), F.floor(doc / 2)).alias("source_message_id"), F.element_at(kinds, (doc % 8 + 1).cast("int")).alias("content_type"), _after(doc * 60).alias("ts"),
        F.when(doc % 4 == 1, F.concat(F.lit("file"), doc, F.element_at(F.array(*(F.lit(x) for x in (".pdf", ".docx", ".txt"))), (doc % 3 + 1).cast("int")))).alias("filename"),
        (doc % 5).alias("chunk_index"), F.ceil(F.col("n_chars") / 4).alias("token_count"), (doc % 3 + 1).alias("message_count"), (doc % 8 == 3).alias("contains_images"), (doc % 17 == 0).alias("is_deleted"), doc.alias("doc_id"), label.cast("long").alias("label"),
    )


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every vector whose id is divisible by 20, with the benchmark texts in turn as questions, each scoped to its own owner."""
    v, b = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 20 == 0), table(spark, sf_dir, "benchmark")
    n = F.expr("vec_id DIV 20")
    return v.join(b, n % 40 == b["item_id"]).select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("text").alias("question"), F.concat(F.lit("owner_"), F.col("label") % 3).alias("owner_id"),
        F.lit(5).alias("top_k"), F.when(n % 3 == 0, F.lit(CHAT_SOURCE)).alias("source"), F.when(n % 2 == 1, _after(F.lit(100 * 60))).alias("time_from"), F.when(n % 4 == 1, _after(F.lit(1500 * 60))).alias("time_to"),
    )


def chat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as the text of an exported chat; every fifth one has no time stamps at all."""
    m = messages(spark, sf_dir)
    stamped = F.concat(F.date_format("ts", "M/d/yyyy, H:mm"), F.lit(" - "), F.when(F.col("turn") % 7 == 6, F.lit("")).otherwise(F.concat("sender_id", F.lit(": "))), "text")
    line = F.when(F.col("conv_id") % 5 == 4, F.col("text")).otherwise(stamped)
    parts = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("parts"))
    return parts.select("conv_id", F.array_join(F.transform("parts", lambda x: x["line"]), "\n").alias("text"))
