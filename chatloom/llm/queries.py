"""The operators over their whole tables, with production parameters, and the columns that their contracts name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm import chat_format, decontamination, hard_negatives, language, licenses, line_dedup, lm_scores, mixing, ngram_join, prefix_trie, quality, sharding, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole documents go through both passes; what is returned of them is computed afterwards."""
    out = sharding.shard_documents(_table(spark, sf_dir, "documents"))
    size, crc = sharding.stored_size(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32")
    return out.select("doc_id", size, crc, F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "starts", "first_slot")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(_table(spark, sf_dir, "documents"), keep=("doc_id",))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", language.held_out(F.col("doc_id"), 4))
    model = language.trained(docs.where(~F.col("held_out")))
    found = language.identified(docs, model)
    return found.select("doc_id", language.held_out(F.col("doc_id"), 4).alias("held_out"), "lang_pred", "score", "n_languages")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = language.held_out(F.col("doc_id"), 7)
    model, weights = lm_scores.trained(docs.where(~held))
    found = lm_scores.scored(docs, model, weights)
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source, hundreds, tens; every tenth one is its directory's licence file."""
    docs = _table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 10 == 0, "LICENSE").otherwise(F.concat(F.col("doc_id"), F.lit(".txt")))
    path = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 100), F.floor(F.col("doc_id") / 10), name)
    return licenses.licensed(docs.select("doc_id", "text", path.alias("path")))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(rows.withColumnRenamed("embedding", "vector"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that says what the template's own marks say."""
    kind = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, "assistant", marks)], kind.schema)
    template = chat_format.Instruct()
    return chat_format.read_back(chat_format.formatted(kind.union(added), template), template)
