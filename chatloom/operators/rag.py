"""From hits to sources, citations, context and prompts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from chatloom.schemas import CHAT_SOURCE

SNIPPET_CHARS = 200
CHARS_PER_TOKEN = 4
CONTEXT_TOKENS = 3000
SEPARATOR = "\n\n---\n\n"


class ContextError(ValueError):
    """A budget too small for the first hit."""


def sources(hits: DataFrame, by_chat: bool = True) -> DataFrame:
    """One source for each message and part among a query's hits: the highest score, at the place of the first.

    ``by_chat`` tells messages of different chats with the same id apart.
    """
    kept = hits.where((F.col("source") == CHAT_SOURCE) | (F.coalesce("owner_id", F.lit("")) != ""))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c in hits.columns else F.lit("") for c in ("source_message_id", "content_type", "page_number", "slide_number", "transcript_segment")]
    chat = [F.col("account_id"), F.col("conversation_id")] if by_chat else []
    kept = kept.withColumn("source_key", F.concat_ws(":", *chat, *parts))
    best = Window.partitionBy("query_id", "source_key").orderBy(F.desc("similarity"), "rank")
    kept = kept.withColumns({"choice": F.row_number().over(best), "first_rank": F.min("rank").over(Window.partitionBy("query_id", "source_key"))}).where("choice = 1")
    text = F.coalesce(F.nullif("focused_snippet", F.lit("")), F.col("text")) if "focused_snippet" in hits.columns else F.col("text")
    return kept.select(
        "query_id", "vector_id", F.row_number().over(Window.partitionBy("query_id").orderBy("first_rank")).alias("position"), F.coalesce("conversation_id", F.lit("")).alias("conversation_id"),
        F.coalesce("source_message_id", F.lit("")).alias("message_id"), F.coalesce("content_type", F.lit("text")).alias("content_type"), F.substring(F.coalesce(text, F.lit("")), 1, SNIPPET_CHARS).alias("snippet"), F.col("similarity").alias("score"),
    )


def citations(hits: DataFrame) -> DataFrame:
    """Provenance of each hit in rank order; blanks become ``Unknown`` or empty, bad or negative positions 0."""
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    return hits.select(
        "query_id", "rank", "vector_id", "similarity", F.coalesce(F.nullif(text("conversation_title"), F.lit("")), F.lit("Unknown")).alias("source_chat"),
        F.greatest(F.coalesce(F.col("chunk_index").cast("string").try_cast("int"), F.lit(0)), F.lit(0)).alias("chunk_index"),
        *(text(c).alias(c) if c in hits.columns else F.lit("").alias(c) for c in ("start_timestamp", "end_timestamp")),
    )


@F.pandas_udf(StringType())
def four_digits(numbers: pd.Series) -> pd.Series:
    """A number with four digits, rounded by its exact binary value as Python and SQL do; ``format_string`` rounds what it would print in full."""
    return numbers.map(lambda x: None if pd.isna(x) else f"{x:.4f}").astype(object)


def context_blocks(hits: DataFrame) -> DataFrame:
    """Each hit as a labelled block of text."""
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) if c in hits.columns else F.lit("")
    start, end = text("start_timestamp"), text("end_timestamp")
    when = F.when((start != "") & (end != "") & (start != end), F.concat(start, F.lit(" to "), end)).when(start != "", start).when(end != "", end).otherwise("N/A")
    block = F.concat_ws(
        "\n", F.concat(F.lit("[Document "), F.col("rank"), F.lit("]")), F.concat(F.lit("Similarity : "), four_digits("similarity")), F.concat(F.lit("ID         : "), F.col("vector_id")),
        F.concat(F.lit("Source     : "), F.coalesce(F.nullif(text("conversation_title"), F.lit("")), F.lit("Unknown"))), F.concat(F.lit("Timestamp  : "), when),
        F.concat(F.lit("Chunk      : "), F.coalesce(F.col("chunk_index").cast("string"), F.lit("N/A"))), F.lit(""), F.col("text"),
    )
    return hits.select("query_id", "rank", "vector_id", block.alias("block"))


def context(hits: DataFrame, budget_tokens: int = CONTEXT_TOKENS) -> DataFrame:
    """``query_id, n_documents, chars, context, error``: blocks in rank order up to the first that does not fit.

    Separators are not counted. If not even the first block fits there is no context, and ``error`` says so.
    """
    budget = budget_tokens * CHARS_PER_TOKEN
    blocks = context_blocks(hits)
    used = F.sum(F.char_length("block")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    blocks = blocks.withColumn("used", used).withColumn("fits", F.col("used") <= budget)
    own = F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("rank", "block"))))
    out = blocks.groupBy("query_id").agg(own.alias("own"), F.coalesce(F.max(F.when(F.col("fits"), F.col("used"))), F.lit(0)).alias("chars"))
    return out.select(
        "query_id", F.size("own").alias("n_documents"), "chars", F.when(F.size("own") > 0, F.array_join(F.transform("own", lambda x: x["block"]), SEPARATOR)).alias("context"),
        F.when(F.size("own") == 0, F.lit("the context budget is too small for the first document")).alias("error"),
    )


def confidence(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """The mean similarity of a query's hits, 0 without any."""
    mean = hits.groupBy("query_id").agg(F.avg("similarity").alias("mean"))
    return queries.select("query_id").join(mean, "query_id", "left").select("query_id", F.round(F.coalesce("mean", F.lit(0.0)), 6).alias("confidence"))


def prompts(queries: DataFrame, contexts: DataFrame, system: str) -> DataFrame:
    """``query_id, system, user`` rows for answering offline."""
    user = F.concat(F.lit("Context:\n"), F.col("context"), F.lit("\n\nQuestion:\n"), F.col("question"))
    return queries.select("query_id", "question").join(contexts.where("error IS NULL"), "query_id").select("query_id", F.lit(system).alias("system"), user.alias("user"))
