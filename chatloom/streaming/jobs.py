"""Continuous jobs: ingest of new events and upkeep of message state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.operators import normalize, policy, sync


def ingest(events: DataFrame, accounts: DataFrame, chats: DataFrame, default_owner: str = "default") -> DataFrame:
    """Owner, normal form and decision of each event: stateless, so the same plan serves a batch and a stream."""
    return policy.decide(normalize.normalize(policy.with_owner(events.drop("owner_id"), accounts, default_owner)), accounts, chats)


def once(stream: DataFrame, key: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """Each key once within the watermark's delay: what a reconnect delivers again is dropped, and old state goes."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Take all that has arrived, batch by batch, and stop."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to its own folder: a batch that runs again replaces what it wrote before."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def update_log_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Keep the update log; message state is classified from it. Redelivered updates stay: the classification knows them."""
    return append_once(path)


def state_from_log(spark: SparkSession, path: str) -> DataFrame:
    """Classified updates from the log, whatever batches they came in: order is by arrival, not by batch."""
    return sync.classify_updates(spark.read.parquet(path).drop("batch"))


def progress(classified: DataFrame) -> DataFrame:
    """Marks per account and how many updates took effect."""
    took = F.count_if(F.col("status").isin("created", "apply", "upsert", "ok"))
    marks = sync.checkpoints(classified)
    return marks.join(classified.groupBy("account_id").agg(took.alias("n_applied")), "account_id")
