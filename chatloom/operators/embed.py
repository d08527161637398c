"""Embedding jobs: cache, de-duplication, batches, validation."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH = 32
UNIT_TOLERANCE = 1e-4
WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def cache_key(text: Column) -> Column:
    return F.sha2(text, 256)


def split_by_cache(rows: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with ``key`` and ``hit``; the cache is a table ``key, embedding``."""
    c = cache.select(F.col("key").alias("c_key"), F.lit(True).alias("c_hit")).distinct()
    keyed = rows.withColumn("key", cache_key(F.col(text)))
    return keyed.join(c, F.col("key") == F.col("c_key"), "left").withColumn("hit", F.coalesce("c_hit", F.lit(False))).drop("c_key", "c_hit")


def cache_stats(split: DataFrame, cache: DataFrame) -> DataFrame:
    """``size, hits, misses, hit_rate`` in one aggregate over look-ups and cache entries together."""
    both = split.select(F.col("hit").cast("int").alias("hit"), (~F.col("hit")).cast("int").alias("miss"), F.lit(0).alias("entry")).union(cache.select(F.lit(0), F.lit(0), F.lit(1)))
    sums = both.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("entry", "size"), ("hit", "hits"), ("miss", "misses"))))
    rate = F.when(F.col("hits") + F.col("misses") > 0, F.round(F.col("hits") / (F.col("hits") + F.col("misses")), 6)).otherwise(0.0)
    return sums.withColumn("hit_rate", rate)


def evict(cache: DataFrame, most: int, inserted: str = "inserted_at", key: str = "key") -> DataFrame:
    """The ``most`` entries inserted last."""
    return cache.orderBy(F.desc(inserted), key).limit(most)


def hashing_embedder(dim: int) -> Callable[[list[str]], np.ndarray]:
    """A stand-in for a model: words in lower case, counted in hashed dimensions, normalised. Needs no weights."""
    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in WORD.findall(t.lower()):
                out[i, int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim] += 1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return embed


def made_of(wanted: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = BATCH) -> DataFrame:
    """``key, embedding`` of each row of ``key, text``; only ``batch`` texts at once are Python objects."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            model = model or load()
            keys, texts = b.column("key"), b.column("text")
            made = [model(texts.slice(i, batch).to_pylist()).astype(np.float32) for i in range(0, b.num_rows, batch)]
            if made:
                flat, dim = np.concatenate(made).ravel(), made[0].shape[1]
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * dim), pa.array(flat))
                yield pa.RecordBatch.from_arrays([keys, vectors], names=["key", "embedding"])

    return wanted.select("key", "text").mapInArrow(task, "key string, embedding array<float>")


def embed(rows: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], dim: int, text: str = "text", cache: DataFrame | None = None, batch: int = BATCH) -> DataFrame:
    """``rows`` with ``embedding``: equal texts are embedded once in the whole table, cached ones not at all, blank ones are zero.

    ``load`` runs once a Python worker's task and returns the model, a function of a list of texts.
    """
    keyed = rows.withColumn("key", cache_key(F.col(text)))
    wanted = keyed.where(F.coalesce(F.trim(text), F.lit("")) != "").select("key", F.col(text).alias("text")).dropDuplicates(["key"])
    if cache is not None:
        wanted = wanted.join(cache.select("key").distinct(), "key", "left_anti")

    made = made_of(wanted, load, batch)
    if cache is not None:
        made = made.unionByName(cache.select("key", "embedding"))
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return keyed.join(made, "key", "left").withColumn("embedding", F.coalesce("embedding", zero)).drop("key")


def vector_problem(v: Column, dim: int | None = None) -> Column:
    """What is wrong with a vector: missing, empty, not finite, wrong dimension, zero; else null."""
    infinite = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = F.when(v.isNull(), "missing").when(F.size(v) == 0, "empty").when(infinite, "not finite")
    if dim is not None:
        out = out.when(F.size(v) != dim, "wrong dimension")
    return out.when(squared_norm(v) == 0, "zero")


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def is_normalised(v: Column) -> Column:
    return F.abs(squared_norm(v) - 1.0) < UNIT_TOLERANCE


def enriched(rows: DataFrame, model: str) -> DataFrame:
    """Rows with what a stored vector says about its making."""
    return rows.withColumns({"embedding_model": F.lit(model), "embedding_dim": F.size("embedding"), "is_normalised": is_normalised(F.col("embedding"))})
