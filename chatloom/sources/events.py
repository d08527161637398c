"""Update events from files, as a batch or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.schemas import EVENT


def read_events(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Events of JSON files. Unreadable files and those that hold only a comment give no rows."""
    rows = spark.read.schema(EVENT).option("multiLine", multi_line).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(path)
    return rows.withColumn("file", F.input_file_name()).where("message_id IS NOT NULL OR chat_id IS NOT NULL")


def stream_events(spark: SparkSession, path: str, files_a_batch: int = 100, schema=EVENT, form: str = "json") -> DataFrame:
    """The same as a stream of the files that arrive in a folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch)
    return reader.option("multiLine", True).json(path) if form == "json" else reader.format(form).load(path)


def read_export_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, n, line`` of exported chats: a large file is read in blocks by several tasks; block and n, ascending, give the lines' order."""
    rows = spark.read.text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))
