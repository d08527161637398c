"""Collections of vectors as tables: insert, update, delete, registry, migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.schemas import METADATA

INSERT_BATCH = 100
OWNER_BUCKETS = 64


class CollectionError(ValueError):
    """A write that the collection's rules forbid."""


def duplicate_ids(rows: DataFrame, keys: tuple[str, ...] = ("collection", "vector_id")) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = ("collection", "vector_id")) -> tuple[DataFrame, DataFrame]:
    """``(rows to append, summary)``. A known id is skipped; an id twice in ``incoming`` is an error before anything is written."""
    twice = duplicate_ids(incoming, keys).take(1)
    if twice:
        raise CollectionError(f"id twice in one batch: {twice[0].asDict()}")
    return incoming.join(existing.select(*keys), list(keys), "left_anti"), storage_summary(existing, incoming, keys)


def storage_summary(existing: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = ("collection", "vector_id")) -> DataFrame:
    """``collection, received, inserted, skipped, final_count`` in one aggregation of old and new keys together."""
    both = existing.select(*keys, F.lit(1).alias("old"), F.lit(0).alias("new")).union(incoming.select(*keys, F.lit(0), F.lit(1)))
    per_id = both.groupBy(*keys).agg(F.max("old").alias("old"), F.sum("new").alias("new"))
    return per_id.groupBy("collection").agg(
        F.sum("new").alias("received"), F.sum(F.when(F.col("old") == 0, F.least("new", F.lit(1))).otherwise(0)).alias("inserted"),
        F.sum(F.when(F.col("old") == 1, F.col("new")).otherwise(F.greatest(F.col("new") - 1, F.lit(0)))).alias("skipped"), F.count(F.lit(1)).alias("final_count"),
    )


def upsert_latest(existing: DataFrame, incoming: DataFrame, keys: list[str], seq: str, keep_old_values: bool = False) -> DataFrame:
    """The latest row of each key by ``seq``; with ``keep_old_values`` a null in the new row leaves the old row's value."""
    latest = incoming.groupBy(*keys).agg(F.max_by(F.struct(*incoming.columns), seq).alias("row")).select("row.*")
    o, n = existing.alias("o"), latest.alias("n")
    met = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    newer = F.col(f"n.{seq}").isNotNull() & (F.col(f"o.{seq}").isNull() | (F.col(f"n.{seq}") >= F.col(f"o.{seq}")))
    columns = []
    for c in existing.columns:
        new = F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if keep_old_values or c in keys else F.col(f"n.{c}")
        columns.append(F.when(newer, new).otherwise(F.col(f"o.{c}")).alias(c))
    return met.select(*columns)


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    return incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def update_existing(existing: DataFrame, incoming: DataFrame, key: str = "vector_id") -> tuple[DataFrame, DataFrame]:
    """``(updated table, ids to update that don't exist)``."""
    missing = incoming.join(existing.select(key), key, "left_anti").select(key)
    kept = existing.join(incoming.select(key), key, "left_anti")
    return kept.unionByName(incoming.join(existing.select(key), key, "left_semi").select(*existing.columns)), missing


def delete_by_ids(existing: DataFrame, ids: DataFrame, key: str = "vector_id") -> tuple[DataFrame, DataFrame]:
    """``(what is left, counts of ids requested and rows deleted)``; unknown ids are ignored."""
    wanted = ids.select(key).distinct()
    counts = wanted.join(existing.select(key, F.lit(1).alias("hit")), key, "left").agg(F.countDistinct(key).alias("requested"), F.count("hit").alias("deleted"))
    return existing.join(wanted, key, "left_anti"), counts


def delete_by_message(existing: DataFrame, messages: DataFrame, keys: tuple[str, ...] = ("owner_id", "source", "account_id", "conversation_id", "source_message_id")) -> DataFrame:
    """What is left when all chunks of the given messages go; all five columns have to agree."""
    return existing.join(messages.select(*keys).distinct(), list(keys), "left_anti")


def get_by_ids(existing: DataFrame, ids: DataFrame, key: str = "vector_id") -> DataFrame:
    return existing.join(ids.select(key).distinct(), key, "left_semi")


def check_guard(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """``collection, status`` for collections to open: created, ok, or what does not fit.

    Another model or schema version is an error, another distance metric only a warning.
    """
    r = registry.select("collection", *(F.col(c).alias(f"r_{c}") for c in ("embedding_model", "schema_version", "distance_metric")))
    status = (
        F.when(F.col("r_embedding_model").isNull(), "created").when(F.col("r_embedding_model") != F.col("embedding_model"), "error: embedding model")
        .when(F.col("r_schema_version") != F.col("schema_version"), "error: schema version").when(F.col("r_distance_metric") != F.col("distance_metric"), "warning: distance metric").otherwise("ok")
    )
    return wanted.join(r, "collection", "left").select("collection", status.alias("status"))


def list_collections(chunks: DataFrame, registry: DataFrame) -> DataFrame:
    counts = chunks.groupBy("collection").agg(F.count(F.lit(1)).alias("document_count"))
    return registry.join(counts, "collection", "full_outer").select(
        "collection", F.coalesce("document_count", F.lit(0)).alias("document_count"), F.coalesce("embedding_model", F.lit("unknown")).alias("embedding_model"), F.coalesce("schema_version", F.lit("unknown")).alias("schema_version"))


def write_collection(rows: DataFrame, path: str, mode: str = "append", batch: int | None = None) -> None:
    """Rows as Parquet by collection and owner bucket, chats together within a file."""
    placed = rows.withColumn("owner_bucket", F.pmod(F.xxhash64("owner_id"), F.lit(OWNER_BUCKETS)).cast("int"))
    writer = placed.sortWithinPartitions("collection", "owner_bucket", "conversation_id").write.mode(mode).partitionBy("collection", "owner_bucket")
    if batch:
        writer = writer.option("maxRecordsPerFile", batch)
    writer.parquet(path)


def read_collection(spark: SparkSession, path: str, owner_id: str | None = None, collection: str | None = None) -> DataFrame:
    """The stored rows; owner and collection prune folders before any file is read."""
    df = spark.read.parquet(path)
    if collection is not None:
        df = df.where(F.col("collection") == collection)
    if owner_id is not None:
        bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(owner_id)), F.lit(OWNER_BUCKETS))).first()[0]
        df = df.where((F.col("owner_bucket") == bucket) & (F.col("owner_id") == owner_id))
    return df.drop("owner_bucket")


def drop_collection(spark: SparkSession, path: str, collection: str) -> None:
    """Remove a collection's folder; an unknown one is an error."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/collection={collection}")
    fs = folder.getFileSystem(conf)
    if not fs.exists(folder):
        raise CollectionError(f"unknown collection {collection!r}")
    fs.delete(folder, True)


def migration_report(legacy: DataFrame, target: DataFrame) -> DataFrame:
    """``collection, old_count, inserted, skipped, new_count, status`` of merging legacy collections into the shared root."""
    keys = ["collection", "vector_id"]
    both = legacy.select(*keys, F.lit(1).alias("old"), F.lit(0).alias("there")).union(target.select(*keys, F.lit(0), F.lit(1)))
    per_id = both.groupBy(*keys).agg(F.max("old").alias("old"), F.max("there").alias("there"))
    report = per_id.groupBy("collection").agg(
        F.sum("old").alias("old_count"), F.sum(F.when((F.col("old") == 1) & (F.col("there") == 0), 1).otherwise(0)).alias("inserted"),
        F.sum(F.when((F.col("old") == 1) & (F.col("there") == 1), 1).otherwise(0)).alias("skipped"), F.count(F.lit(1)).alias("new_count"),
    ).where("old_count > 0")
    return report.withColumn("status", F.when(F.col("inserted") + F.col("skipped") == F.col("old_count"), F.when(F.col("inserted") > 0, "migrated").otherwise("already_done")).otherwise("failed"))


def migrate(legacy: DataFrame, target: DataFrame, path: str, dry_run: bool = True) -> DataFrame:
    """The report; unless it is a dry run, the missing rows are appended to the collections at ``path``, one collection after another.

    After each write the store is read again: a collection that lacks one of its rows is ``failed``, and the migration stops there.
    """
    report = migration_report(legacy, target)
    if dry_run:
        return report
    spark, keys, done = legacy.sparkSession, ["collection", "vector_id"], []
    for row in sorted(report.collect(), key=lambda r: r["collection"]):  # one row a collection, before the writes change what it counts
        own = legacy.where(F.col("collection") == row["collection"])
        write_collection(own.join(target.select(*keys), keys, "left_anti"), path)
        there = own.select(*keys).distinct().join(read_collection(spark, path, collection=row["collection"]).select(*keys), keys, "left_semi").count()
        done.append((*row[:-1], row["status"] if there == row["old_count"] else "failed"))
        if there != row["old_count"]:
            break
    return spark.createDataFrame(done, report.schema)


def migration_totals(report: DataFrame) -> DataFrame:
    failed = F.count_if(F.col("status") == "failed")
    return report.agg(
        F.sum("old_count").alias("total_old"), F.sum("inserted").alias("total_inserted"), F.sum("skipped").alias("total_skipped"), failed.alias("failed"),
        F.when(failed == 0, "PASS").otherwise("FAIL").alias("verdict"),
    )


def flat_metadata(rows: DataFrame) -> DataFrame:
    """Metadata with no nulls: typed defaults, times as ISO strings, a chat's title or else its id as ``source_chat``."""
    blank = F.lit("")
    return rows.select(
        "vector_id", F.coalesce("owner_id", blank).alias("owner_id"), F.coalesce("source", blank).alias("source"), F.coalesce(F.nullif(F.trim("conversation_title"), blank), F.col("conversation_id"), blank).alias("source_chat"),
        F.coalesce("sender_name", blank).alias("sender_name"), F.coalesce(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), blank).alias("timestamp"), F.coalesce("filename", blank).alias("filename"),
        F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"), F.coalesce("is_deleted", F.lit(False)).alias("is_deleted"),
    )


def vector_metadata(rows: DataFrame, key: str = "vector_id") -> DataFrame:
    """``key, metadata``: all fields of ``schemas.METADATA`` and whatever ``extra`` has, as one map of typed scalars (VARIANT).

    Fields that ``rows`` lacks, or has as null, get their kind's default; ``timestamp`` comes from ``ts`` if there is no such column and is an ISO text;
    ``source_chat`` falls back on the chat's title and its id. ``extra`` (a map to VARIANT) goes on top: a key that a field has too
    takes the field's place, with a type of its own; null values of it are left out. Owner and source are checked by ``mandatory_split``.
    """
    have = set(rows.columns)
    zero = {"string": F.lit(""), "bigint": F.lit(0).cast("bigint"), "boolean": F.lit(False)}

    def field(name: str, kind: str) -> Column:
        if name == "source_chat":
            options = [F.nullif(F.col(c), F.lit("")) for c in ("source_chat", "conversation_title", "conversation_id") if c in have]
            return F.coalesce(*options, zero[kind])
        if name == "timestamp" and "timestamp" not in have and "ts" in have:
            return F.coalesce(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), zero[kind])
        return F.coalesce(F.col(name).cast(kind), zero[kind]) if name in have else zero[kind]

    fields = F.create_map(*(x for name, kind in METADATA.items() for x in (F.lit(name), field(name, kind).cast("variant"))))
    if "extra" not in have:
        return rows.select(key, fields.alias("metadata"))
    extra = F.map_filter(F.coalesce("extra", F.from_json(F.lit("{}"), "map<string,variant>")), lambda k, v: v.isNotNull() & ~F.is_variant_null(v))
    return rows.select(key, F.map_concat(F.map_filter(fields, lambda k, v: ~F.map_contains_key(extra, k)), extra).alias("metadata"))


def typed(metadata: Column, field: str) -> Column:
    """A field of ``vector_metadata`` by its own kind; null where ``extra`` put something there that has no such value."""
    return F.try_variant_get(F.element_at(metadata, field), "$", METADATA[field])


def mandatory_split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, quarantine)``: rows need an owner and a source."""
    ok = (F.coalesce(F.trim("owner_id"), F.lit("")) != "") & (F.coalesce(F.trim("source"), F.lit("")) != "")
    return rows.where(ok), rows.where(~ok)


def knowledge_metadata(objects: DataFrame, part: str = "text", index: int = 0) -> DataFrame:
    """Metadata of a content row, with what only its open map holds."""
    own = lambda key: F.element_at("metadata", F.lit(key))
    return objects.select("*", own("conversation_title").alias("conversation_title"), own("conversation_type").alias("conversation_type"), own("attachment_id").alias("attachment_id"), F.lit(part).alias("content_part"), F.lit(index).alias("chunk_index"))
