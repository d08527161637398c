"""Tables written once and read again, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Only a local session, where driver and executors are one process, may fall back on a temporary
    folder; on a cluster a missing setting is an error, since a folder of one machine would not do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.startswith("local["):
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return found.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nobody has used."""
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: The lists that note what the present context writes. A thread has its own context, so queries that run beside each other
#: never note each other's tables.
_recorders: ContextVar[tuple[list[str], ...]] = ContextVar("recorders", default=())


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of the tables that the present context writes meanwhile."""
    made: list[str] = []
    before = _recorders.set((*_recorders.get(), made))
    try:
        yield made
    finally:
        _recorders.reset(before)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, its lineage cut, safe from lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    for made in _recorders.get():
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(*tables: DataFrame) -> None:
    """Remove tables made by ``written`` that nothing will read again."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            folder = file.rpartition("/")[0]
            if folder.rpartition("/")[0].endswith(scratch_dir(df.sparkSession).rpartition("/")[2]):
                delete_folder(df.sparkSession, folder)


def release_paths(spark: SparkSession, paths: list[str], keep: DataFrame) -> None:
    """Remove recorded tables but those that ``keep`` reads."""
    read = {file.rpartition("/")[0].rpartition("/")[2] for file in keep.inputFiles()}
    for path in paths:
        if path.rpartition("/")[2] not in read:
            delete_folder(spark, path)
