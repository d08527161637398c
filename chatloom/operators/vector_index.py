"""An inverted-file index for approximate search: cells of a k-means quantiser, product-quantised residuals, exact re-ranking.

Unit vectors are dealt to the nearest of ``cells`` centroids; what is left of a vector after its centroid is cut into short parts,
each replaced by the number of its nearest codeword, so a row costs ``parts`` bytes to look at. A query looks at the cells whose centroids are
about as near as the nearest one: few where vectors lie in clusters, more where they don't. The rows of those cells that its scope
allows are compared by their codes, and only the best ``RERANK`` times ``top_k`` of them by their vectors.

Both quantisers are fitted on a bounded sample (``SAMPLE`` rows, drawn by a hash of the id); every row is in the index. It is stored
by cell, so a look-up reads the files of its cells, and the codes without the vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatloom.operators.nearest import STEP_PAIRS, _blocks, _passes
from chatloom.operators.search import MOST_QUERIES, distance, filter_columns, norm, not_deleted, similarity

#: Rows that the quantisers are fitted on, and most cells.
SAMPLE, MOST_CELLS = 65_536, 4096
#: Components of one part of a residual, and codewords of a part.
PART, CODEWORDS = 4, 256
ROUNDS = 12
#: A cell is probed if its centroid is at most so many times as far as the nearest one; this many cells at least.
MARGIN, LEAST_PROBES = 1.18, 4
#: Rows that are compared by their vectors, times ``top_k``.
RERANK = 8


@dataclass
class VectorIndex:
    """Where the rows are, and both quantisers: ``centroids`` (cells, dim) and ``codebooks`` (parts, codewords, PART)."""

    path: str
    centroids: np.ndarray
    codebooks: np.ndarray

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows")


def _units(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    v = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in chunks]).astype(np.float64).reshape(len(column), -1)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _nearest(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The nearest of ``points`` to each row; ``STEP_PAIRS`` distances at once, however many points there are."""
    step, norms = max(1, STEP_PAIRS // len(points)), (points * points).sum(1)[None, :]
    out = np.zeros(len(x), np.int64)
    for i in range(0, len(x), step):
        out[i : i + step] = (norms - 2 * (x[i : i + step] @ points.T)).argmin(1)
    return out


def _parts(x: np.ndarray) -> np.ndarray:
    """Rows cut into parts of ``PART`` components, the last one filled up with zeros."""
    n, dim = x.shape
    wide = np.zeros((n, -(-dim // PART) * PART))
    wide[:, :dim] = x
    return wide.reshape(n, -1, PART)


def _codebook(x: np.ndarray, seed: int) -> np.ndarray:
    """Codewords of one part by k-means; with fewer distinct rows than codewords the rest repeat the first."""
    rng = np.random.default_rng(seed)
    known = np.unique(x, axis=0)
    words = known[rng.choice(len(known), min(CODEWORDS, len(known)), replace=False)]
    for _ in range(ROUNDS):
        own = _nearest(x, words)
        sums, counts = np.zeros_like(words), np.bincount(own, minlength=len(words))
        np.add.at(sums, own, x)
        words = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], words)
    return np.vstack([words, np.repeat(words[:1], CODEWORDS - len(words), axis=0)])


def _residual_parts(centroids: np.ndarray) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _units(b.column("embedding"))
                cut = _parts(x - centroids[_nearest(x, centroids)])
                at = np.tile(np.arange(cut.shape[1], dtype=np.int32), len(x))
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(list(cut.reshape(-1, PART)), pa.list_(pa.float64()))], names=["part", "x"])

    return task


def _trained_part(key: tuple, rows: pa.Table) -> pa.Table:
    part = key[0].as_py()
    words = _codebook(np.stack(rows["x"].to_pylist()), part)
    return pa.table({"part": pa.array([part], pa.int32()), "words": pa.array([words.ravel().tolist()], pa.list_(pa.float64()))})


def indexable(chunks: DataFrame) -> DataFrame:
    """Rows that have a vector of finite components that isn't zero."""
    broken = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return chunks.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(~broken).where(norm(F.col("embedding")) > 0)


def build(chunks: DataFrame, path: str, cells: int | None = None) -> VectorIndex | None:
    """Fit both quantisers and write every row of ``chunks`` with a usable vector by cell; None without such rows.

    ``cells``: about the square root of the rows, ``MOST_CELLS`` at most. Rows are written by ranges of cell and id, so that one cell with
    very many rows is the work of several tasks.
    """
    spark = chunks.sparkSession
    usable = indexable(chunks)
    n = usable.count()
    if not n:
        return None
    one_in = -(-n // SAMPLE)
    sample = usable.where(F.pmod(F.xxhash64("vector_id"), F.lit(one_in)) == 0).select(F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    sample.write.mode("overwrite").parquet(f"{path}/sample")
    sample = spark.read.parquet(f"{path}/sample")
    units = sample.select(F.transform("embedding", lambda x: x / norm(F.col("embedding"))).alias("unit"))
    k = min(cells or max(1, round(n**0.5)), MOST_CELLS)
    model = KMeans(k=k, seed=1, maxIter=ROUNDS, featuresCol="features").fit(units.select(array_to_vector("unit").alias("features"))) if k > 1 else None
    centroids = np.array(model.clusterCenters()) if model else np.array(units.select(F.array(*(F.avg(F.col("unit")[i]) for i in range(units.select(F.size("unit")).first()[0])))).first()[0])[None, :]
    parts = sample.mapInArrow(_residual_parts(centroids), "part int, x array<double>").groupBy("part").applyInArrow(_trained_part, "part int, words array<double>")
    books = np.stack([np.array(r["words"]).reshape(CODEWORDS, PART) for r in sorted(parts.collect(), key=lambda r: r["part"])])  # dim / PART rows
    held = spark.sparkContext.broadcast((centroids, books))
    names = usable.columns

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, books = held.value
        for b in batches:
            cell, code = np.zeros(0, np.int32), []
            if b.num_rows:
                x = _units(b.column("embedding"))
                cell = _nearest(x, centroids).astype(np.int32)
                cut = _parts(x - centroids[cell])
                code = [c.tobytes() for c in np.stack([_nearest(cut[:, p], books[p]) for p in range(len(books))], axis=1).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(code, pa.binary())], names=[*names, "cell", "code"])

    schema = usable.withColumns({"cell": F.lit(0), "code": F.lit(b"")}).schema
    placed = usable.mapInArrow(coded, schema).repartitionByRange("cell", "vector_id").sortWithinPartitions("cell", "vector_id")
    placed.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    model_rows = [("centroid", i, c.tolist()) for i, c in enumerate(centroids)] + [("codebook", i, b.ravel().tolist()) for i, b in enumerate(books)]
    spark.createDataFrame(model_rows, "kind string, at int, values array<double>").write.mode("overwrite").parquet(f"{path}/model")
    return VectorIndex(path, centroids, books)


def load(spark: SparkSession, path: str) -> VectorIndex:
    found = sorted(spark.read.parquet(f"{path}/model").collect(), key=lambda r: r["at"])  # MOST_CELLS rows at most
    of = lambda kind: [np.array(r["values"]) for r in found if r["kind"] == kind]
    return VectorIndex(path, np.stack(of("centroid")), np.stack([b.reshape(CODEWORDS, PART) for b in of("codebook")]))


def _probed(vectors: np.ndarray, centroids: np.ndarray, margin: float) -> Iterator[np.ndarray]:
    """Which cells a query looks at, for stretches of the queries."""
    step, norms = max(1, STEP_PAIRS // len(centroids)), (centroids**2).sum(1)[None, :]
    for i in range(0, len(vectors), step):
        away = np.sqrt(np.maximum(1 - 2 * (vectors[i : i + step] @ centroids.T) + norms, 0))
        out = away <= margin * away.min(1, keepdims=True)
        least = np.argsort(away, axis=1, kind="stable")[:, :LEAST_PROBES]
        np.put_along_axis(out, least, True, axis=1)
        yield out


def _probing(index: VectorIndex, queries: DataFrame, margin: float, what: str, of: Callable[[pa.Array, np.ndarray], list[pa.Array]]) -> DataFrame:
    held = queries.sparkSession.sparkContext.broadcast(index.centroids)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for some in _probed(_units(b.column("embedding")), held.value, margin) if b.num_rows else ():
                yield pa.RecordBatch.from_arrays(of(b.column("query_id").slice(at, len(some)), some), names=["query_id", what.split()[0]])
                at += len(some)

    kind = queries.schema["query_id"].dataType.simpleString()
    return indexable(queries.select("query_id", F.col("query_vector").alias("embedding"))).mapInArrow(task, f"query_id {kind}, {what}")


def probes(index: VectorIndex, queries: DataFrame, margin: float = MARGIN) -> DataFrame:
    """``query_id, cell``: the cells that each query looks at."""

    def rows(ids: pa.Array, some: np.ndarray) -> list[pa.Array]:
        at, cell = np.nonzero(some)
        return [ids.take(pa.array(at)), pa.array(cell.astype(np.int32))]

    return _probing(index, queries, margin, "cell int", rows)


def _probe_bits(index: VectorIndex, queries: DataFrame, margin: float) -> DataFrame:
    """``query_id, probed``: the same, a row a query and a bit a cell."""
    return _probing(index, queries, margin, "probed binary", lambda ids, some: [ids, pa.array([row.tobytes() for row in np.packbits(some, axis=1)], pa.binary())])


def _estimating(held, same: tuple[str, ...], among: tuple[str, ...], timed: bool, pairs: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Coded rows meet queries: each query's ``first_k`` best rows by their codes, of the cells that it looks at."""

    def meet(rows: pa.Table, asks: pa.Table) -> pa.Table:
        ask, row, value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if rows.num_rows and asks.num_rows:
            centroids, books = held.value
            rows = rows.sort_by([("cell", "ascending"), ("vector_id", "ascending")])
            cell, k, units = rows["cell"].to_numpy(), asks["first_k"].to_numpy(), _units(asks["query_vector"])
            place = np.argsort(np.argsort(np.array(rows["vector_id"].to_pylist())))  # among equals the smaller id
            codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(cell), len(books))
            probed = np.unpackbits(np.frombuffer(b"".join(asks["probed"].to_pylist()), np.uint8).reshape(len(k), -1), axis=1).astype(bool)
            passing, worst, step = _passes(rows, asks, same, among, timed), np.full(len(k), -np.inf), max(1, pairs // len(k))
            for start in range(0, len(cell), step):
                end = min(start + step, len(cell))
                own = np.concatenate([books[p][codes[start:end, p]] for p in range(len(books))], axis=1)[:, : centroids.shape[1]] + centroids[cell[start:end]]
                own /= np.linalg.norm(own, axis=1, keepdims=True)
                near = np.full((len(k), end - start), -np.inf)
                cuts = [0, *(np.flatnonzero(np.diff(cell[start:end])) + 1), end - start]
                for low, high in zip(cuts, cuts[1:], strict=False):
                    who = np.flatnonzero(probed[:, cell[start + low]])
                    near[who, low:high] = units[who] @ own[low:high].T
                allowed = passing(start, end)
                if allowed is not None:
                    near[~allowed] = -np.inf
                at = max(end - start - int(k.max()), 0)
                edge = np.maximum(np.partition(near, at, axis=1)[:, at], worst)
                a, r = np.nonzero((near >= edge[:, None]) & (near > -np.inf))
                ask, row, value = (np.concatenate(x) for x in ((ask, a), (row, r + start), (value, near[a, r])))
                order = np.lexsort((place[row], -value, ask))
                ask, row, value = ask[order], row[order], value[order]
                nth = np.arange(len(ask)) - np.searchsorted(ask, np.arange(len(k)))[ask]
                full = nth == k[ask] - 1
                worst[ask[full]] = value[full]
                kept = nth < k[ask]
                ask, row, value = ask[kept], row[kept], value[kept]
        return pa.table({"query_id": asks["query_id"].take(pa.array(ask)), "vector_id": rows["vector_id"].take(pa.array(row)), "cell": rows["cell"].take(pa.array(row)), "estimate": value})

    return meet


def candidates(index: VectorIndex, queries: DataFrame, margin: float = MARGIN, most: int = MOST_QUERIES, pairs: int = STEP_PAIRS) -> DataFrame:
    """``query_id, vector_id, cell, top_k, estimate``: each query's best rows by their codes, ``RERANK`` times its ``top_k``.

    Filters of ``scope`` and ``in_time`` and the deletion rule hold before anything is ranked. Blocks of an owner's codes meet blocks of at most
    ``most`` of its queries, ``pairs`` pairs at once, and each meeting keeps as many rows a query as can come first; pairs are never sorted.
    """
    spark = queries.sparkSession
    timed = not {"time_from", "time_to"}.isdisjoint(queries.columns)
    of_rows, of_asks, same, among = filter_columns(queries, timed)
    asked = queries.where(F.col("top_k") > 0).select("query_id", "owner_id", "query_vector", (F.col("top_k") * RERANK).cast("int").alias("first_k"), *of_asks)
    living = index.rows(spark).where(not_deleted())
    sizes = _blocks(living, asked, most)
    rows = living.join(sizes, F.col("owner_id") == F.col("owner")).select("vector_id", "cell", "code", F.col("owner").alias("owner"), *of_rows, F.pmod(F.xxhash64("vector_id"), F.col("n_rows")).cast("int").alias("row_block"), F.explode(F.sequence(F.lit(0), F.col("n_asks") - 1)).alias("ask_block"))
    asked = asked.join(sizes, F.col("owner_id") == F.col("owner")).join(_probe_bits(index, queries, margin), "query_id")
    asked = asked.select(*(c for c in asked.columns if c not in ("owner_id", "owner", "n_rows", "n_asks")), F.col("owner").alias("owner"), F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("row_block"), F.pmod(F.xxhash64("query_id"), F.col("n_asks")).cast("int").alias("ask_block"))
    held = spark.sparkContext.broadcast((index.centroids, index.codebooks))
    keys, kind = ["owner", "row_block", "ask_block"], queries.schema["query_id"].dataType.simpleString()
    met = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_estimating(held, same, among, timed, pairs), f"query_id {kind}, vector_id string, cell int, estimate double")
    met = met.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("estimate"), "vector_id")))
    return met.join(queries.select("query_id", F.col("top_k").cast("long").alias("top_k")), "query_id").where(F.col("place") <= F.col("top_k") * RERANK)


def search(index: VectorIndex, queries: DataFrame, margin: float = MARGIN) -> DataFrame:
    """``query_id, vector_id, similarity, rank``: about the ``top_k`` nearest rows by cosine within each query's scope.

    ``queries`` as for ``search.knn``. Queries without a usable vector find nothing. Ties go to the smaller id.
    """
    spark = queries.sparkSession
    best = candidates(index, queries, margin).select("query_id", "vector_id", F.col("cell").alias("in_cell"), "top_k")
    vectors = index.rows(spark).select(F.col("vector_id").alias("c_id"), "cell", "embedding")
    met = best.join(vectors, (F.col("vector_id") == F.col("c_id")) & (F.col("in_cell") == F.col("cell"))).join(queries.select("query_id", "query_vector"), "query_id")
    met = met.withColumn("distance", F.round(distance(F.col("embedding"), F.col("query_vector"), "cosine"), 9)).withColumn("similarity", F.round(similarity(F.col("distance"), "cosine"), 6))
    order = Window.partitionBy("query_id").orderBy("distance", "vector_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("top_k")).select("query_id", "vector_id", "similarity", "rank")
