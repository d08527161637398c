"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters the rows into buckets by a seeded hash, so many that a bucket fits into a task's memory, and
writes them to the shared folder. Pass two shuffles each bucket (Spark's ``shuffle`` is a Fisher-Yates shuffle)
and numbers the rows through all buckets: that number, dealt round the shards like cards, gives every row its
shard and its place there. The law that holds is ``rows``: shards differ by at most one row.

A hot key, source or group of copies does not matter: the scattering hash takes all columns of a row, so rows that differ in
any of them spread over all buckets. Rows alike in every column are interchangeable; those that would fill a good part of a bucket are
numbered, in parts, and the hash takes the number's block too, so they spread as well. Shards and slots hang on
the rows, the seed and the number of buckets only, not on how the input is split or on which task does what, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.operators.scan import numbered
from chatloom.scratch import written

SHARDS = 16
SEED = 20240229
#: Rows of a bucket hold about this many bytes.
BUCKET_BYTES = 16 << 20
#: Rows alike are spread if their copies hold one of so many parts of a bucket.
COPIES = 8
LAW = "rows"
#: Tasks of the second pass at most; each takes several buckets beyond that.
MOST_TASKS = 100000


def stored_size(text) -> F.Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _buckets(total_bytes: int, bucket_bytes: int) -> int:
    return max(1, -(-total_bytes // bucket_bytes))


def _hashable(df: DataFrame, row: str) -> list[F.Column]:
    """The fields of a row as values that can be hashed and ordered: those that hold maps or variants as their JSON text."""
    out = []
    for f in df.schema[row].dataType.fields:
        c, kind = F.col(row)[f.name], f.dataType.simpleString()
        out.append(F.to_json(F.struct(c.alias("x"))) if "map<" in kind or "variant" in kind else c)
    return out


def row_bytes(df: DataFrame) -> F.Column:
    """About how many bytes a row holds, all its columns together."""
    parts = []
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        parts.append(F.coalesce(F.octet_length(c if kind in ("string", "binary") else F.to_json(F.struct(c.alias("x")))), F.lit(0)) if kind in ("string", "binary") or "<" in kind or "variant" in kind else F.lit(8))
    return (sum(parts, F.lit(8))).cast("long")


def scattered(df: DataFrame, buckets: int, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``df(row STRUCT, bytes)`` as ``row, mark, bucket``, written to the shared folder: ``bucket`` is a seeded hash of the whole row.

    ``mark`` is a second hash of the row, by which rows are put in order whatever their types. Rows alike whose copies hold a ``COPIES``-th of a
    bucket or more are numbered by ``scan.numbered``, and each so many of them go to a bucket of their own.
    """
    fields = _hashable(df, "row")
    hashed = df.withColumns({"mark": F.xxhash64(F.lit(seed), *fields), "twin": F.xxhash64(F.lit(seed + 1), *fields)})
    same = ["mark", "twin"]
    hot = hashed.groupBy(*same).agg(F.sum("bytes").alias("all_bytes"), F.count(F.lit(1)).alias("copies")).where((F.col("all_bytes") * COPIES > bucket_bytes) & (F.col("copies") > 1))
    hot = written(hot.select(*same, F.greatest(F.ceil(F.col("copies") * bucket_bytes / COPIES / F.col("all_bytes")), F.lit(1)).alias("together")), "shard-hot")
    bucket = lambda *more: F.pmod(F.xxhash64(F.lit(seed), "mark", "twin", *more), F.lit(buckets)).cast("long").alias("bucket")
    if hot.isEmpty():
        return written(hashed.select("row", "mark", bucket()), "scattered")
    cold = hashed.join(hot.select(*same), same, "left_anti").select("row", "mark", bucket())
    copies = hashed.join(hot, same).withColumn("lot", F.rand(seed))
    numbered_copies = numbered(copies, same, ["lot"], "n", "shard-copies")
    return written(cold.union(numbered_copies.select("row", "mark", bucket(F.floor(F.col("n") / F.col("together"))))), "scattered")


def shuffled(bucketed: DataFrame, buckets: int, seed: int = SEED) -> DataFrame:
    """``bucketed(row STRUCT, mark, bucket)`` as ``(place, row)``: all rows in random order, numbered from 0 without gaps.

    The numbers of a bucket start where those of the buckets before it end; there are as many sums as buckets. A task takes whole
    buckets, in their order, and its random numbers hang on its own number: so their count is set here and not left to be merged.
    """
    tasks = min(buckets, MOST_TASKS)
    rows = bucketed.repartition(tasks, "bucket").groupBy("bucket").agg(F.collect_list(F.struct("mark", "row")).alias("rows")).sortWithinPartitions("bucket")
    by_mark = F.array_sort("rows", lambda a, b: F.when(a["mark"] < b["mark"], -1).when(a["mark"] > b["mark"], 1).otherwise(0))
    rows = rows.select("bucket", F.transform(F.shuffle(by_mark, seed), lambda x: x["row"]).alias("rows"))
    counts = bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return (
        rows.join(starts, "bucket")
        .select("start", F.posexplode("rows").alias("pos", "row"))
        .select((F.col("start") + F.col("pos")).cast("long").alias("place"), "row")
    )


def dealt(df: DataFrame, columns: list, total_bytes: int, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """``columns`` of every row of ``df``, with ``shard`` (0 to ``shards - 1``) and ``slot`` (gapless from 0 in each shard)."""
    buckets = _buckets(total_bytes, bucket_bytes)
    rows = scattered(df.select(F.struct(*columns).alias("row"), row_bytes(df).alias("bytes")), buckets, seed, bucket_bytes)
    placed = shuffled(rows, buckets, seed)
    return placed.select("row.*", (F.col("place") % shards).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED, text: str = "text") -> DataFrame:
    """Every row of ``docs`` in full with ``shard`` and ``slot``; a partition holds whole buckets in slot order.

    ``docs`` may have any columns; ``shard`` and ``slot`` of the input are replaced. Null texts take one byte,
    null keys and repeated rows are rows like others, an empty table gives no rows.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")]
    total = docs.agg(F.sum(row_bytes(docs))).first()[0] or 0
    return dealt(docs, kept, total, shards, bucket_bytes, seed)


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """The shards as folders ``shard=0`` ... under ``path``, each file a stretch of one shard in slot order."""
    out = shard_documents(docs, **options)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
