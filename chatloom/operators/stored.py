"""Tables that change in place, by key: an upsert or delete reads and writes the buckets of its keys only.

A row lies in the bucket of its key's hash. A batch writes the buckets that it touches anew, in a folder of its own, and a manifest that names the
batch which last wrote each bucket of each table makes them the present ones, all tables at once. Until then readers see the tables as they
were, and a batch that failed half-way, or is delivered again, begins from the same state and replaces what it wrote. A committed
batch is known and not applied twice. Logs only grow: their rows lie in the folders of their batches, by bucket as well.

One writer a store. A manifest has at most tables times buckets entries, whatever the number of rows or batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatloom.schemas import OPERATIONAL
from chatloom.scratch import delete_folder, release, written

BUCKETS = 64
#: Committed manifests, and the buckets that they name, which stay readable.
KEPT = 2


def bucket_of(keys: tuple[str, ...] | list[str], buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class Store:
    """Keyed tables and logs below ``root``; ``tables`` and ``logs``: name to (schema, key columns)."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, tuple[str, tuple[str, ...]]] = OPERATIONAL, logs: dict[str, tuple[str, tuple[str, ...]]] | None = None, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.tables, self.logs = dict(tables), dict(logs or {})
        self._pending: dict[int, dict[str, list[int]]] = {}

    # manifests: small files that only the driver reads and writes

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self) -> list[int]:
        fs, folder = self._files(), self._path("_manifests")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit()) if fs.exists(folder) else []

    def manifest(self, before: int | None = None) -> dict[str, dict[str, int]]:
        """Of the last committed batch (before another one): table to bucket to the batch that wrote it."""
        known = [b for b in self.committed() if before is None or b < before]
        if not known:
            return {}
        stream = self._files().open(self._path("_manifests", f"{known[-1]:020d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def is_committed(self, batch: int) -> bool:
        return batch in self.committed()

    def commit(self, batch: int) -> None:
        """Make all that ``batch`` wrote the present state: one small file, renamed into place."""
        found = {t: dict(b) for t, b in self.manifest(before=batch).items()}
        for table, buckets in self._pending.pop(batch, {}).items():
            found.setdefault(table, {}).update({str(b): batch for b in buckets})
        fs, draft, final = self._files(), self._path("_manifests", f"_{batch:020d}"), self._path("_manifests", f"{batch:020d}")
        out = fs.create(draft, True)
        out.write(json.dumps(found).encode())
        out.close()
        if not fs.rename(draft, final):
            raise OSError(f"batch {batch} was committed by another writer")

    def vacuum(self) -> list[str]:
        """Remove bucket folders of keyed tables that none of the last ``KEPT`` manifests names; returns them."""
        known, gone, fs = self.committed(), [], self._files()
        manifests = [self.manifest(before=b + 1) for b in known[-KEPT:]]
        for table in self.tables:
            live = {(str(batch), b) for m in manifests for b, batch in m.get(table, {}).items()}
            found = fs.globStatus(self._path(table, "batch=*", "bucket=*")) or []
            for f in found:
                path = f.getPath()
                at = path.getParent().getName().partition("=")[2], path.getName().partition("=")[2]
                if at not in live and known and int(at[0]) <= known[-1]:
                    delete_folder(self.spark, path.toString())
                    gone.append(path.toString())
        return gone

    # tables

    def _schema(self, name: str) -> T.StructType:
        return T._parse_datatype_string((self.tables | self.logs)[name][0])

    def read(self, table: str, buckets: list[int] | None = None, before: int | None = None) -> DataFrame:
        """A keyed table as it stands (before a batch), or some of its buckets: only their folders are listed and read."""
        at = self.manifest(before).get(table, {})
        fs = self._files()
        paths = [f"{self.root}/{table}/batch={batch}/bucket={b}" for b, batch in at.items() if buckets is None or int(b) in buckets]
        paths = [p for p in paths if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p))]  # a bucket whose rows were all deleted has none
        schema = self._schema(table)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def touched(self, name: str, rows: DataFrame) -> list[int]:
        """The buckets that hold the keys of ``rows``: at most as many as the store has."""
        keys = (self.tables | self.logs)[name][1]
        return sorted(r[0] for r in rows.select(bucket_of(keys, self.buckets).alias("b")).distinct().collect())

    def rewrite(self, table: str, rows: DataFrame, buckets: list[int], batch: int) -> None:
        """Write the rows that ``buckets`` of a table have from ``batch`` on; buckets without rows are empty from then on."""
        keys = self.tables[table][1]
        path = f"{self.root}/{table}/batch={batch}"
        before = self._pending.get(batch, {}).get(table, [])
        if set(before) & set(buckets):
            raise ValueError(f"{table}: a batch writes a bucket once")
        placed = rows.select(*self._schema(table).fieldNames()).withColumn("bucket", bucket_of(keys, self.buckets))
        delete_folder(self.spark, path) if not before else None
        placed.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)
        self._pending.setdefault(batch, {})[table] = [*before, *buckets]

    def upsert(self, table: str, rows: DataFrame, batch: int, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> list[int]:
        """New and changed rows by key; returns the buckets that were read and written.

        ``merge`` makes the new rows of the touched buckets of the old ones and ``rows``; without it ``rows``, one a key, replace old rows.
        """
        rows = written(rows, f"upsert-{table}")
        buckets = self.touched(table, rows)
        if buckets:
            old, keys = self.read(table, buckets, before=batch), list(self.tables[table][1])
            made = merge(old, rows) if merge else old.join(rows.select(*keys), keys, "left_anti").unionByName(rows.select(*old.columns))
            self.rewrite(table, made, buckets, batch)
        release(rows)
        return buckets

    def delete(self, table: str, ids: DataFrame, batch: int) -> tuple[int, int]:
        """Delete by key; unknown keys are ignored. Returns how many keys were asked for and how many rows went."""
        keys = list(self.tables[table][1])
        ids = written(ids.select(*keys).distinct(), f"delete-{table}")
        buckets = self.touched(table, ids)
        old = self.read(table, buckets, before=batch) if buckets else self.read(table, [])
        counts = ids.count(), old.join(ids, keys, "left_semi").count()
        if counts[1]:
            self.rewrite(table, old.join(ids, keys, "left_anti"), buckets, batch)
        release(ids)
        return counts

    # logs

    def append(self, log: str, rows: DataFrame, batch: int) -> None:
        placed = rows.select(*self._schema(log).fieldNames()).withColumn("bucket", bucket_of(self.logs[log][1], self.buckets))
        placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{log}/batch={batch}")

    def read_log(self, log: str, buckets: list[int] | None = None, before: int | None = None) -> DataFrame:
        """The rows of all committed batches (before one), or some buckets of them."""
        schema, fs = self._schema(log), self._files()
        known = [b for b in self.committed() if (before is None or b < before) and fs.exists(self._path(log, f"batch={b}"))]
        if not known:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])).option("basePath", f"{self.root}/{log}").parquet(*(f"{self.root}/{log}/batch={b}" for b in known))
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        return rows.select(*schema.fieldNames())


def latest_by(keys: list[str], seq: str, keep_old_values: bool = False) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge that keeps each key's latest row by ``seq``; a null in a new row may leave the old row's value."""
    from chatloom.operators.collection import upsert_latest

    return lambda old, rows: upsert_latest(old, rows, keys, seq, keep_old_values)
