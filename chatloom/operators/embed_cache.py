"""A stored cache of embeddings, by the digest of their text: looked up, added to and evicted over many runs.

Entries lie in buckets by key; a run reads the buckets of its keys, and of those only the keys (the vectors are joined to the hits). Keys are
digests, so a large look-up is an equi-join for which Spark builds its own Bloom filter of the smaller side once it pays.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.operators import embed
from chatloom.operators.stored import Store
from chatloom.scratch import release, written

TABLE = {"embedding_cache": ("key string, embedding array<float>, inserted bigint", ("key",))}
#: Digits of a digest that one step of the eviction looks at.
DIGITS = 3


def run(store: Store, rows: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], dim: int, batch: int, most: int | None = None, text: str = "text") -> tuple[DataFrame, dict[str, int]]:
    """``rows`` with ``embedding`` and what the cache did: distinct texts found (``hits``), made (``misses``), ``evicted``, and its ``size`` afterwards.

    New entries are added as inserted by ``batch``; beyond ``most`` entries those inserted first go. Blank texts are zero vectors and never cached.
    """
    keyed = rows.withColumn("key", embed.cache_key(F.col(text)))
    shown = keyed.where(F.coalesce(F.trim(text), F.lit("")) != "").select("key", F.col(text).alias("text"))
    wanted = written(shown.select("key").distinct(), "wanted")  # digests only: of the texts just those that are missing are dealt out, once
    buckets = store.touched("embedding_cache", wanted)
    cache = store.read("embedding_cache", buckets, before=batch) if buckets else store.read("embedding_cache", [])
    known = written(cache.join(wanted, "key", "left_semi"), "known")
    missing = written(wanted.join(known.select("key"), "key", "left_anti"), "missing")
    texts = shown.join(missing, "key", "left_semi").dropDuplicates(["key"])
    made = written(embed.made_of(texts, load).withColumn("inserted", F.lit(batch).cast("bigint")), "made")
    after = cache.unionByName(made)
    if buckets:
        store.rewrite("embedding_cache", after, buckets, batch)
    store.commit(batch)
    release(wanted, missing)
    hits, misses = known.count(), made.count()
    gone = evict(store, most, batch + 1) if most is not None else 0
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    out = keyed.join(known.select("key", "embedding").unionByName(made.select("key", "embedding")), "key", "left").withColumn("embedding", F.coalesce("embedding", zero)).drop("key")
    return out, {"hits": hits, "misses": misses, "evicted": gone, "size": store.read("embedding_cache").count()}


def evict(store: Store, most: int, batch: int) -> int:
    """Keep the ``most`` entries inserted last, within a run those of smaller digests; returns how many went. Commits ``batch``.

    No sort of the cache: counts a run tell in which run the line falls, counts of digests by their first digits where in it, and only the
    entries that share those digits are put in order.
    """
    cache = store.read("embedding_cache", before=batch)
    left, cut = most, None
    for r in sorted(cache.groupBy("inserted").count().collect(), key=lambda r: -r["inserted"]):  # a row a run
        if r["count"] > left:
            cut = r["inserted"]
            break
        left -= r["count"]
    if cut is None:
        store.commit(batch)
        return 0
    own = cache.where(F.col("inserted") == cut)
    prefix, last = F.substring("key", 1, DIGITS), None
    for r in sorted(own.groupBy(prefix.alias("p")).count().collect(), key=lambda r: r["p"]):  # 16 ** DIGITS rows at most
        if r["count"] > left:
            last = r["p"]
            break
        left -= r["count"]
    edge = [r["key"] for r in own.where(prefix == last).select("key").orderBy("key").limit(left + 1).collect()][-1]  # of one prefix
    gone = written(cache.where((F.col("inserted") < cut) | (F.col("inserted") == cut) & (F.col("key") >= edge)).select("key"), "evicted")
    _, n = store.delete("embedding_cache", gone, batch)
    store.commit(batch)
    return n
