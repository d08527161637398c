"""A feed of updates as a streaming source with offsets: shards of numbered records, read from where a stream left off.

A feed is a folder that all machines reach: ``shard=<n>/<first>-<end>.jsonl`` holds the records ``first`` to ``end - 1`` of a shard, one JSON object a
line. Segments are written whole and never changed, so how far a shard goes is told by its file names. An offset is the next record of
each shard; the reader itself remembers nothing, so whatever process plans a batch, the offsets in the stream's checkpoint tell which
records it has. Each segment's part of a batch is read by a task of its own, as Arrow batches. A stream that starts again reads what it
planned before and goes on: nothing is lost, nothing comes twice. (Python sources can't limit a batch in this Spark version; a batch takes
what there is, and its tasks are as many as its segments.)
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

NAME = "update_feed"
#: Records of one Arrow batch.
ROWS = 8192
#: Records of a segment at most, so of a reading task too.
SEGMENT = 65_536


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def segments(path: str) -> dict[int, list[tuple[int, int, str]]]:
    """Of each shard its segments in order: first record, end, file."""
    files, root = _open(path)
    found: dict[int, list[tuple[int, int, str]]] = {}
    for f in files.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
        name = f.base_name
        if f.type == pafs.FileType.File and name.endswith(".jsonl") and name[0].isdigit():
            first, _, end = name.removesuffix(".jsonl").partition("-")
            found.setdefault(int(f.path.rsplit("/shard=", 1)[1].split("/")[0]), []).append((int(first), int(end), f.path))
    return {shard: sorted(s) for shard, s in sorted(found.items())}


class Part(InputPartition):
    """Records ``start`` to ``stop - 1`` of a shard, all in one segment."""

    def __init__(self, path: str, first: int, start: int, stop: int) -> None:
        self.path, self.first, self.start, self.stop = path, first, start, stop


class FeedReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, path: str) -> None:
        self._schema, self._path = schema, path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {str(shard): own[-1][1] for shard, own in segments(self._path).items()}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        out = []
        for shard, own in segments(self._path).items():
            low, high = start.get(str(shard), 0), end.get(str(shard), 0)
            out += [Part(path, first, max(first, low), min(stop, high)) for first, stop, path in own if max(first, low) < min(stop, high)]
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(self._schema)
        files, _ = _open(self._path)
        rows: list[dict] = []
        with files.open_input_stream(part.path) as raw:
            for n, line in enumerate(_lines(raw), part.first):
                if n >= part.stop:
                    break
                if n >= part.start:
                    rows.append(json.loads(line))
                if len(rows) == ROWS:
                    yield _batch(rows, kinds)
                    rows = []
        if rows:
            yield _batch(rows, kinds)

    def commit(self, end: dict) -> None:
        """Segments stay: other streams may read them."""


def _lines(raw: pa.NativeFile) -> Iterator[bytes]:
    """Lines of a stream, a block at a time."""
    rest = b""
    while block := raw.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from whole
    if rest:
        yield rest


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    """Values by their field's type; times are ISO-8601 texts in the feed. A missing or unreadable value is null."""
    columns = []
    for f in schema:
        texts = [r.get(f.name) for r in rows]
        if pa.types.is_timestamp(f.type):
            columns.append(pa.array([None if t is None else t.removesuffix("Z") for t in texts], pa.string()).cast(pa.timestamp("us")).cast(f.type))
        else:
            columns.append(pa.array(texts, f.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


class FeedSource(DataSource):
    """``spark.readStream.format("update_feed").schema(...).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "account_id string, chat_id string, message_id string, kind string, edit_ts timestamp, update_id string, arrival bigint"

    def streamReader(self, schema: StructType) -> FeedReader:
        return FeedReader(schema, self.options["path"])


def stream_feed(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    spark.dataSource.register(FeedSource)
    reader = spark.readStream.format(NAME)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def append_to_feed(rows: DataFrame, path: str, shards: int, order: str, key: list[str], most: int = SEGMENT) -> None:
    """Append ``rows`` to a feed: a key's rows in ``order`` in one shard, each shard's as one more segment (or some of ``most`` records each), numbered on from its last record."""
    ends = {shard: s[-1][1] for shard, s in segments(path).items()}
    placed = rows.withColumn("shard", F.pmod(F.xxhash64(*key), F.lit(shards)).cast("int"))
    iso = {f.name: F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") for f in rows.schema if f.dataType.typeName().startswith("timestamp")}
    line = F.to_json(F.struct(*(iso.get(c, F.col(c)).alias(c) for c in rows.columns)))
    sorted_rows = placed.select("shard", F.col(order).alias("_order"), line.alias("line")).repartition(shards, "shard").sortWithinPartitions("shard", "_order", "line")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each shard lies in one task, sorted: a draft is written as its rows come and takes its name when its length is known."""
        files, root = _open(path)
        shard, out, first, n, draft = None, None, 0, 0, ""

        def close() -> None:
            out.close()
            files.move(draft, f"{root}/shard={shard}/{first:020d}-{first + n:020d}.jsonl")

        for b in batches:
            for s, text in zip(b.column("shard").to_pylist(), b.column("line").to_pylist(), strict=True):
                if s != shard or n == most:
                    if out:
                        close()
                    first = first + n if s == shard else ends.get(s, 0)
                    shard, n, draft = s, 0, f"{root}/shard={s}/_draft-{first:020d}"
                    files.create_dir(f"{root}/shard={s}", recursive=True)
                    out = files.open_output_stream(draft)
                out.write(text.encode() + b"\n")
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array([], pa.int32())], names=["shard"])
        if out:
            close()

    sorted_rows.select("shard", "line").mapInArrow(write, "shard int").write.format("noop").mode("overwrite").save()
