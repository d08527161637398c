"""Hard negatives: for each anchor and each of its positives, the best rows of other labels within a window of scores.

Rows hang in a multiway hyperplane tree: a node has up to ``FAN_OUT`` split points, a row goes below the nearest one, and for
each split point the node keeps the range of its distances to the rows below each sibling. A query knows its distances to
the split points, so the triangle inequality bounds its distance, and with the norms its score, to whatever lies below a
sibling; siblings whose bounds miss the query's window are passed over. Leaves are compared exactly, in blocks.

The tree is fitted on a bounded sample of rows (``SAMPLE``) and has at most ``FAN_OUT ** LEVELS`` leaves; every row is
assigned to a leaf and counts in the ranges. Queries, rows and results stay distributed: a leaf is cut into blocks of about
``BLOCK_ROWS`` rows, the queries that visit it into blocks of about ``BLOCK_QUERIES``, and a task multiplies one by the other.
Rows of equal vector and label are alike but for their ids, so only the ``POSITIVES + 1`` smallest ids of each such class are
searched, and each distinct vector and label of the anchors is searched once: a vector that a third of all rows share costs no more
than any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.scratch import written

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these hundredths of the positive's.
LEAST, MOST = 50, 95
#: Split points of a node, levels of nodes, rows that the tree is fitted on, and about how many rows a leaf should have.
FAN_OUT, LEVELS, SAMPLE, LEAF_ROWS = 16, 3, 16384, 4096
#: About how many rows and queries meet in one product.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024
#: Larger components could make products that no long holds; such rows take no part.
LARGEST = 1 << 24


@dataclass
class Node:
    points: np.ndarray
    #: A node's number, or ~leaf.
    children: list[int]
    #: By split point and child: least and greatest distance; by child: least and greatest norm.
    near: np.ndarray = field(default=None)
    far: np.ndarray = field(default=None)
    short: np.ndarray = field(default=None)
    long: np.ndarray = field(default=None)


def _codes(batch: pa.RecordBatch) -> tuple[np.ndarray, list[bytes | None]]:
    """``floor(SCALE * x)`` of each vector as bytes of 32-bit integers; None for vectors that take no part."""
    out: list[bytes | None] = []
    for v in batch.column("vector"):
        x = np.asarray(v.values.to_numpy(zero_copy_only=False), dtype=float) if v.is_valid else np.array([np.nan])
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(SCALE * x)
        out.append(x.astype("<i4").tobytes() if np.all(np.abs(x) <= LARGEST) else None)  # not so for NaN, which nulls become
    return out


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        codes = pa.array(_codes(b), pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), codes], names=["vec_id", "label", "code"])


def _matrix(codes: pa.ChunkedArray | pa.Array | list[bytes], dim: int) -> np.ndarray:
    """Codes as rows of whole numbers, shorter ones filled up with zeros."""
    found = [c.as_py() if isinstance(c, pa.Scalar) else c for c in codes]
    if all(len(c) == 4 * dim for c in found):
        return np.frombuffer(b"".join(found), "<i4").reshape(len(found), dim).astype(float)
    out = np.zeros((len(found), dim))
    for row, c in zip(out, found, strict=True):
        x = np.frombuffer(c, "<i4")
        row[: len(x)] = x
    return out


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: as doubles if none can pass 2**53, else as integers."""
    most = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * rows.shape[1]
    if most < 2**53:
        return (queries @ rows.T).astype(np.int64)
    return queries.astype(np.int64) @ rows.astype(np.int64).T


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(1)[:, None] + (points * points).sum(1)[None, :] - 2 * (x @ points.T)
    return np.sqrt(np.maximum(squares, 0))


def _split_points(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Up to ``FAN_OUT`` of a few times as many candidates, each as far as possible from those taken before."""
    at = np.unique(x[rng.choice(len(x), min(len(x), 3 * FAN_OUT), replace=False)], axis=0)
    taken, away = [0], _distances(at, at[:1])[:, 0]
    while len(taken) < FAN_OUT and away.max() > 0:
        taken.append(int(away.argmax()))
        away = np.minimum(away, _distances(at, at[taken[-1:]])[:, 0])
    return at[taken]


def fitted(sample: np.ndarray, n_rows: int) -> tuple[list[Node], int]:
    """Nodes, the root first, and the number of leaves."""
    nodes: list[Node] = []
    leaves = 0
    rng = np.random.default_rng(0)
    waiting = [(sample, 0, None)]
    while waiting:
        x, level, place = waiting.pop(0)
        points = _split_points(x, rng) if level == 0 or level < LEVELS and len(x) >= 2 * FAN_OUT and len(x) / len(sample) * n_rows > LEAF_ROWS else None
        if points is None or len(points) < 2 and level > 0:
            own = ~leaves
            leaves += 1
        else:
            own = len(nodes)
            nodes.append(Node(points, [0] * len(points)))
            nearest = _distances(x, points).argmin(1)
            waiting += [(x[nearest == j], level + 1, (own, j)) for j in range(len(points))]
        if place:
            nodes[place[0]].children[place[1]] = own
    return nodes, leaves


def _descent(nodes: list[Node], x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """At each node that rows reach: its number, the rows, their distances to its split points, the child of each."""
    waiting = [(0, np.arange(len(x)))]
    while waiting:
        k, rows = waiting.pop()
        away = _distances(x[rows], nodes[k].points)
        child = away.argmin(1)
        yield k, rows, away, child
        for j in np.unique(child):
            if nodes[k].children[j] >= 0:
                waiting.append((nodes[k].children[j], rows[child == j]))


def _assigner(nodes: list[Node], dim: int) -> Callable:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, leaf = _matrix(b.column("code"), dim), np.zeros(b.num_rows, np.int32)
            for k, rows, _, child in _descent(nodes, x) if len(x) else ():
                to = np.array(nodes[k].children)[child]
                leaf[rows[to < 0]] = ~to[to < 0]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("vec_id", "label", "code", "class")), pa.array(leaf)], names=["vec_id", "label", "code", "class", "leaf"])

    return assign


_RANGES = "node int, point int, child int, lo double, hi double"


def _ranger(nodes: list[Node], dim: int) -> Callable:
    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Least and greatest distances of a task's rows; norms count as distances to a further point."""
        least, most = ([np.full((len(n.points) + 1, len(n.points)), fill) for n in nodes] for fill in (np.inf, -np.inf))
        for b in batches:
            x = _matrix(b.column("code"), dim)
            for k, rows, away, child in _descent(nodes, x) if len(x) else ():
                away = np.hstack([away, np.sqrt((x[rows] * x[rows]).sum(1))[:, None]])
                for j in np.unique(child):
                    least[k][:, j] = np.minimum(least[k][:, j], away[child == j].min(0))
                    most[k][:, j] = np.maximum(most[k][:, j], away[child == j].max(0))
        for k in range(len(nodes)):
            i, j = np.nonzero(least[k] < np.inf)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(least[k][i, j]), pa.array(most[k][i, j])], names=["node", "point", "child", "lo", "hi"])

    return ranges


def _with_ranges(nodes: list[Node], rows: DataFrame, dim: int) -> list[Node]:
    """The ranges over all rows. Their number hangs on ``FAN_OUT`` and ``LEVELS`` alone, not on the rows."""
    for n in nodes:
        m = len(n.points)
        n.near, n.far = np.full((m + 1, m), np.inf), np.full((m + 1, m), -np.inf)
    found = rows.select("code").mapInArrow(_ranger(nodes, dim), _RANGES).groupBy("node", "point", "child").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    for r in found.toLocalIterator():
        nodes[r["node"]].near[r["point"], r["child"]], nodes[r["node"]].far[r["point"], r["child"]] = r["lo"], r["hi"]
    for n in nodes:
        n.short, n.long, n.near, n.far = n.near[-1], n.far[-1], n.near[:-1], n.far[:-1]
    return nodes


def surviving(nodes: list[Node], x: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Leaves and the queries (by place) that may have a row of theirs in a window; ``lows``, ``highs``: queries by windows."""
    norms = np.sqrt((x * x).sum(1))
    waiting = [(0, np.arange(len(x)), np.zeros(len(x)), np.full(len(x), np.inf))]
    while waiting:
        k, q, at_least, at_most = waiting.pop()
        n, away = nodes[k], _distances(x[q], nodes[k].points)
        for j, to in enumerate(n.children):
            if n.short[j] > n.long[j]:  # no rows below it
                continue
            near = np.maximum(at_least, np.maximum(n.near[:, j] - away, away - n.far[:, j]).max(1))
            far = np.minimum(at_most, (away + n.far[:, j]).min(1))
            product = norms[q] * n.long[j]
            slack = 1e-6 * product + 1e-3
            top = np.minimum((norms[q] ** 2 + n.long[j] ** 2 - near**2) / 2, product) + slack
            bottom = np.maximum((norms[q] ** 2 + n.short[j] ** 2 - far**2) / 2, -product) - slack
            stay = ((lows[q] <= top[:, None]) & (highs[q] >= bottom[:, None])).any(1)
            if stay.any():
                if to < 0:
                    yield ~to, q[stay]
                else:
                    waiting.append((to, q[stay], near[stay], far[stay]))


def _visitor(tree, dim: int) -> Callable:
    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, home = _matrix(b.column("code"), dim), b.column("leaf").to_numpy(zero_copy_only=False)
            low, high = (b.column(c).to_pylist() for c in ("lows", "highs"))
            width = max(1, *map(len, low))
            lows, highs = np.full((len(x), width), np.inf), np.full((len(x), width), -np.inf)
            for i in range(len(x)):
                lows[i, : len(low[i])], highs[i, : len(high[i])] = low[i], high[i]
            for leaf, q in surviving(tree.value, x, lows, highs):
                q = q[home[q] != leaf]
                yield pa.RecordBatch.from_arrays([b.column("class").take(pa.array(q)), pa.array(np.full(len(q), leaf, np.int32))], names=["class", "leaf"])

    return visits


def _best(scores: np.ndarray, ids: np.ndarray, found: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of ``found``: higher scores first, then smaller ids."""
    if len(found) > k:
        own = scores[found]
        found = found[own >= np.partition(own, len(own) - k)[len(own) - k]]
    return found[np.lexsort((ids[found], -scores[found]))[:k]]


_FOUND = "class string, asked bigint, vec_id bigint, score bigint"


def _meeting(dim: int, negatives: bool) -> Callable:
    """A block of a leaf's rows against a block of queries: the best rows of each query (of the same label) or window."""
    def meet(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows and queries.num_rows:
            ids, labels = rows["vec_id"].to_numpy(), np.array(rows["label"].to_pylist(), object)
            scores = _scores(_matrix(queries["code"], dim), _matrix(rows["code"], dim))
            asks = queries["asks"].to_pylist() if negatives else [[0]] * queries.num_rows
            alike = {label: labels == label for label in set(queries["label"].to_pylist())}
            for s, key, label, own in zip(scores, queries["class"].to_pylist(), queries["label"].to_pylist(), asks, strict=True):
                same = np.flatnonzero(alike[label]) if not negatives else None
                other = np.flatnonzero(~alike[label]) if negatives else None
                for p in own:
                    if negatives:
                        hundred = 100 * s[other]
                        within = _best(s, ids, other[(hundred >= LEAST * p) & (hundred <= MOST * p)], NEGATIVES)
                    else:
                        within = _best(s, ids, same, POSITIVES + 1)
                    out += [(key, p, int(ids[i]), int(s[i])) for i in within]
        columns = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["class", "asked", "vec_id", "score"])

    return meet


def _met(rows: DataFrame, queries: DataFrame, visits: DataFrame, dim: int, negatives: bool, label: str) -> DataFrame:
    """What the visited leaves hold for the queries, the best of each block.

    A leaf's rows and its visits are dealt to blocks by hash; each block of rows meets each block of queries. Leaves are few
    (``FAN_OUT ** LEVELS`` at most), so the two tables of their sizes are broadcast.
    """
    blocks = lambda df, size, name: df.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    sizes = F.broadcast(blocks(rows, BLOCK_ROWS, "row_blocks").join(blocks(visits, BLOCK_QUERIES, "query_blocks"), "leaf"))
    own = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(sizes, "leaf").select("leaf", own("vec_id", F.col("row_blocks")).alias("r"), every("query_blocks").alias("q"), "vec_id", "label", "code")
    asked = queries.select("class", "label", "code", *(["asks"] if negatives else []))
    right = visits.join(sizes, "leaf").join(asked, "class").select("leaf", every("row_blocks").alias("r"), own("class", F.col("query_blocks")).alias("q"), *asked.columns)
    keys = ("leaf", "r", "q")
    return written(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_meeting(dim, negatives), _FOUND), label)


def _first(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each key; what is beyond them goes before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


OUT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def hard_negatives(rows: DataFrame, every: int = 50) -> DataFrame:
    """``OUT`` of ``rows(vec_id, label, vector)``: anchors are the rows whose ``vec_id`` is divisible by ``every``.

    Vectors count as ``floor(SCALE * x)``, scores are inner products, higher ones first, ties by smaller ``vec_id``. An anchor's
    positives are its first ``POSITIVES`` rows of the same label and another ``vec_id``; its negatives the first ``NEGATIVES`` rows of
    another label whose score lies between ``LEAST`` and ``MOST`` hundredths of the positive's. A positive without negatives
    has no row. Rows without id, label or vector, with a null, non-finite or huge component (``LARGEST``) take no part; shorter
    vectors count as filled up with zeros; rows repeated whole count once; other columns are ignored; no rows, no result.
    """
    spark = rows.sparkSession
    known = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), "vector")
    known = known.mapInArrow(_coded, "vec_id bigint, label string, code binary").where("code IS NOT NULL")
    known = written(known.withColumn("class", F.md5(F.concat(F.col("code"), F.lit("/").cast("binary"), F.col("label").cast("binary")))), "vectors")
    n_rows, length = known.agg(F.count(F.lit(1)), F.max(F.octet_length("code"))).first()
    if not n_rows:
        return spark.createDataFrame([], OUT)
    dim = max(1, length // 4)
    w = Window.partitionBy("class").orderBy("vec_id")
    # dense ranks, as a row repeated whole counts once; ids of an equal rank are dropped afterwards
    searched = known.withColumn("_n", F.dense_rank().over(w)).where(F.col("_n") <= POSITIVES + 1).drop("_n").dropDuplicates(["class", "vec_id"])
    sample = known.select("code").distinct().orderBy(F.xxhash64("code"), "code").limit(SAMPLE).collect()  # bounded by SAMPLE
    nodes, _ = fitted(_matrix([r["code"] for r in sample], dim), n_rows)
    searched = written(searched.select("vec_id", "label", "code", "class").mapInArrow(_assigner(nodes, dim), "vec_id bigint, label string, code binary, class string, leaf int"), "leaves")
    tree = spark.sparkContext.broadcast(_with_ranges(nodes, searched, dim))

    anchors = known.where(F.col("vec_id") % every == 0).select("vec_id", "class").distinct()
    one = searched.groupBy("class").agg(F.first("label").alias("label"), F.first("code").alias("code"), F.first("leaf").alias("leaf"))
    queries = written(one.join(anchors.select("class").distinct(), "class", "left_semi"), "queries")

    def visits(asking: DataFrame, label: str) -> DataFrame:
        """The leaves besides its own that each query has to see."""
        return written(asking.select("class", "code", "leaf", "lows", "highs").mapInArrow(_visitor(tree, dim), "class string, leaf int"), label)

    # positives: the own leaf gives a bound, the others are seen if they may reach it
    home = _met(searched, queries, queries.select("class", "leaf"), dim, False, "positives-home")
    worst = _first(home, ["class"], POSITIVES + 1).groupBy("class").agg(F.min("score").alias("worst"), F.count(F.lit(1)).alias("n"))
    bound = F.when(F.col("n") > POSITIVES, F.col("worst").cast("double")).otherwise(float("-inf"))
    asking = queries.join(worst, "class", "left").select(*queries.columns, F.array(F.coalesce(bound, F.lit(float("-inf")))).alias("lows"), F.array(F.lit(float("inf"))).alias("highs"))
    away = _met(searched, queries, visits(asking, "positive-visits"), dim, False, "positives-away")
    found = written(_first(home.union(away), ["class"], POSITIVES + 1).select("class", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # negatives: one window for each score of a positive; without a window there is nothing to see
    windows = found.where("positive_score >= 0").groupBy("class").agg(F.array_sort(F.collect_set("positive_score")).alias("asks"))
    asking = queries.join(windows, "class").withColumns({
        "lows": F.transform("asks", lambda p: p * (LEAST / 100)), "highs": F.transform("asks", lambda p: p * (MOST / 100)),
    })
    near = _met(searched, asking, asking.select("class", "leaf"), dim, True, "negatives-home")
    more = _met(searched, asking, visits(asking, "negative-visits"), dim, True, "negatives-away")
    w = Window.partitionBy("class", "asked").orderBy(F.desc("score"), "vec_id")
    best = near.union(more).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= NEGATIVES)
    best = best.groupBy("class", F.col("asked").alias("positive_score")).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")))).alias("negatives"))

    of_class = found.join(best, ["class", "positive_score"], "left").groupBy("class").agg(F.collect_list(F.struct((-F.col("positive_score")).alias("order"), "positive_id", "positive_score", "negatives")).alias("positives"))
    others = F.slice(F.array_sort(F.filter("positives", lambda p: p["positive_id"] != F.col("anchor_id"))), 1, POSITIVES)
    out = anchors.withColumnRenamed("vec_id", "anchor_id").join(of_class, "class").select("anchor_id", F.explode(others).alias("p"))
    out = out.select("anchor_id", "p.positive_id", "p.positive_score", F.explode("p.negatives").alias("n"))
    return out.select("anchor_id", "positive_id", F.col("n.rank").alias("rank"), F.col("n.negative_id").alias("negative_id"), "positive_score", F.col("n.negative_score").alias("negative_score"))
