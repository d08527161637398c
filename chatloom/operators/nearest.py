"""Exact nearest rows of many queries at once: blocks of an owner's rows meet blocks of its queries in matrix products.

Only ids, vectors and the columns that filters ask about take part. Each meeting of two blocks keeps ``first_k`` rows a query, so that
neither disk nor memory holds the pairs; their number is that of brute force, as the search is exact.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An owner's rows are cut into about ``BLOCKS`` blocks of a size between these; queries into blocks of at most ``MOST_ASKS``.
LEAST_ROWS, MOST_ROWS, BLOCKS, MOST_ASKS = 8192, 65_536, 16, 8192
#: Bytes of the vectors of a block at most, and pairs looked at at once.
BLOCK_BYTES, STEP_PAIRS = 64 << 20, 1 << 22
#: Distances count by so many digits; rows that agree in them go by the smaller id.
DIGITS = 9
_HALF = 0.5 * 10.0**-DIGITS


def usable(vector: str) -> Column:
    """There is a vector, and all its components are finite."""
    broken = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & ~F.coalesce(broken, F.lit(True))


def _blocks(counted: DataFrame, asks: DataFrame, most_asks: int) -> DataFrame:
    """``owner, n_rows, n_asks``: into how many blocks the rows and queries of an owner are cut."""
    rows = counted.groupBy(F.col("owner_id").alias("owner")).agg(F.count(F.lit(1)).alias("rows"))
    found = asks.groupBy(F.col("owner_id").alias("asking")).agg(F.count(F.lit(1)).alias("asks"), F.max(F.size("query_vector")).alias("dim"))
    most = F.greatest(F.lit(BLOCK_BYTES) / (8 * F.col("dim")), F.lit(1.0))
    own = F.least(F.greatest(F.least(F.col("rows") / BLOCKS, F.lit(float(MOST_ROWS))), F.lit(float(LEAST_ROWS))), most)
    return rows.join(found, F.col("owner") == F.col("asking")).select("owner", F.ceil(F.col("rows") / own).cast("int").alias("n_rows"), F.ceil(F.col("asks") / F.least(most, F.lit(float(most_asks)))).cast("int").alias("n_asks"))


def nearest(rows: DataFrame, asks: DataFrame, metric: str, same: tuple[str, ...] = (), among: tuple[str, ...] = (), timed: bool = False, counted: DataFrame | None = None, most: int = MOST_ASKS, pairs: int = STEP_PAIRS, buckets: bool = False) -> DataFrame:
    """``query_id, vector_id, distance``: each query's ``first_k`` best rows of its owner, and more of them from other blocks.

    ``rows``: vector_id (without repeats), owner_id, embedding; ``asks``: query_id, owner_id, query_vector, first_k. ``same`` and ``among`` name columns that both
    have: a row passes if the query's value is null, or equals (is an array that holds) the row's. ``timed``: rows have ``at``,
    asks ``at_least`` and ``at_most``, all in microseconds. Vectors of other lengths than the query's take no part. ``counted``: a cheaper
    table with the rows' owners, for the size of the blocks. ``most``: queries of a block at most; ``pairs``: pairs looked at
    at once. ``buckets``: both have ``buckets``, and only pairs that agree in one of them, place by place, count.
    """
    sizes = _blocks(rows if counted is None else counted, asks, most)
    row_filters, ask_filters = [*same, *among, *(["at"] if timed else []), *(["buckets"] if buckets else [])], [*same, *among, *(["at_least", "at_most"] if timed else []), *(["buckets"] if buckets else [])]
    c = rows.where(usable("embedding")).join(sizes, F.col("owner_id") == F.col("owner"))
    c = c.select("vector_id", "embedding", *row_filters, F.col("owner").alias("owner"), F.size("embedding").alias("dim"), F.pmod(F.xxhash64("vector_id"), F.col("n_rows")).cast("int").alias("row_block"), F.explode(F.sequence(F.lit(0), F.col("n_asks") - 1)).alias("ask_block"))
    q = asks.where(usable("query_vector") & (F.col("first_k") > 0)).join(sizes, F.col("owner_id") == F.col("owner"))
    q = q.select("query_id", "query_vector", F.col("first_k").cast("int").alias("first_k"), *ask_filters, F.col("owner").alias("owner"), F.size("query_vector").alias("dim"), F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("row_block"), F.pmod(F.xxhash64("query_id"), F.col("n_asks")).cast("int").alias("ask_block"))
    schema = f"query_id {asks.schema['query_id'].dataType.simpleString()}, vector_id {rows.schema['vector_id'].dataType.simpleString()}, distance double"
    keys = ["owner", "dim", "row_block", "ask_block"]
    return c.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(_meeting(metric, same, among, timed, pairs, buckets), schema)


def _matrix(column: pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    n = len(column)
    parts = [chunk.flatten().to_numpy(zero_copy_only=False) for chunk in column.chunks]
    return np.concatenate(parts).astype(kind).reshape(n, -1)


def _rounded(x: np.ndarray) -> np.ndarray:
    """To ``DIGITS`` digits, halves away from zero."""
    y = np.abs(x) * 10.0**DIGITS
    whole = np.floor(y)
    return np.copysign((whole + (y - whole >= 0.5)) / 10.0**DIGITS, x)


class _Metric:
    """Values to be minimised of blocks of pairs: ``quick`` by a matrix product, ``exact`` component by component, in order."""

    def __init__(self, metric: str, rows: np.ndarray, asks: np.ndarray) -> None:
        self.metric, self.of_rows, self.of_asks = metric, np.ascontiguousarray(rows.T), np.ascontiguousarray(asks.T)
        lengths = lambda v: np.sqrt(self._sum(v, v, np.multiply))
        self.row_norms, self.ask_norms = lengths(self.of_rows), lengths(self.of_asks)
        scale = np.ones(len(asks))
        if metric == "cosine":
            rows, asks = (v / np.where(n > 0, n, 1.0)[:, None] for v, n in ((rows, self.row_norms), (asks, self.ask_norms)))
        elif metric == "l2":
            scale = self.ask_norms**2 + self.row_norms.max() ** 2
        else:
            scale = 1.0 + self.ask_norms * self.row_norms.max()
        self.rows, self.asks = rows, asks
        self.slack = 8 * (rows.shape[1] + 8) * np.finfo(np.float64).eps * scale  # more than a product's rounding can move

    @staticmethod
    def _sum(a: np.ndarray, b: np.ndarray, how: Callable) -> np.ndarray:
        total = np.zeros(a.shape[1])
        for x, y in zip(a, b, strict=True):
            total += how(x, y)
        return total

    def quick(self, start: int, end: int) -> np.ndarray:
        products = self.asks @ self.rows[start:end].T
        if self.metric == "cosine":
            return np.subtract(1.0, products, out=products)
        if self.metric == "ip":
            return np.negative(products, out=products)
        products *= -2.0
        products += (self.ask_norms**2)[:, None]
        products += (self.row_norms[start:end] ** 2)[None, :]
        return products

    def exact(self, ask: np.ndarray, row: np.ndarray) -> np.ndarray:
        total = np.zeros(len(ask))
        for x, y in zip(self.of_rows, self.of_asks, strict=True):
            a, b = x[row], y[ask]
            total += (a - b) ** 2 if self.metric == "l2" else a * b
        if self.metric == "l2":
            return _rounded(np.sqrt(total))
        if self.metric == "ip":
            return -_rounded(total)
        norms = self.row_norms[row] * self.ask_norms[ask]
        return _rounded(np.where(norms == 0, 1.0, 1.0 - total / np.where(norms == 0, 1.0, norms)))

    def below(self, value: np.ndarray, by: float, of: np.ndarray | slice) -> np.ndarray:
        """The quick value under which all pairs lie whose exact one is under ``value + by``."""
        if self.metric == "l2":
            edge = value + by
            return np.where(edge > 0, edge * edge + self.slack[of], -np.inf)
        return value + by + self.slack[of]


def _holder(who: np.ndarray, what: np.ndarray, of_rows: np.ndarray, free: np.ndarray) -> Callable[[int, int], np.ndarray]:
    """Which of a stretch's rows have a value that a query names; ``who`` names ``what``, in the order of the latter. Queries that are ``free`` name none."""

    def check(start: int, end: int) -> np.ndarray:
        values, at = np.unique(of_rows[start:end], return_inverse=True)
        first = np.searchsorted(what, values)
        n = np.searchsorted(what, values, side="right") - first
        named = np.zeros((len(free), len(values)), bool)
        column = np.repeat(np.arange(len(values)), n)
        named[who[np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)], column] = True
        named[free] = True
        return named[:, at]

    return check


def _passes(rows: pa.Table, asks: pa.Table, same: tuple[str, ...], among: tuple[str, ...], timed: bool) -> Callable[[int, int], np.ndarray | None]:
    """A function of a stretch of rows: which of its rows pass the filters of which queries; None if all do."""
    checks: list[Callable[[int, int], np.ndarray]] = []
    for name in (*same, *among):
        asked = asks[name].to_pylist()
        if all(a is None for a in asked):
            continue
        allowed = [(i, x) for i, a in enumerate(asked) if a is not None for x in (a if name in among else [a]) if x is not None]
        place = {x: n for n, x in enumerate({x for _, x in allowed})}
        number = pc.index_in(rows[name], value_set=pa.array(list(place), rows[name].type))
        of_rows = np.where(pc.is_null(rows[name]).to_numpy(), -1, pc.fill_null(number, -1).to_numpy())
        who, what = np.array([i for i, _ in allowed], np.int64), np.array([place[x] for _, x in allowed], np.int64)
        order = np.argsort(what, kind="stable")
        checks.append(_holder(who[order], what[order], of_rows, np.array([a is None for a in asked])))
    if timed:
        first, last = (pc.fill_null(asks[c], edge).to_numpy() for c, edge in (("at_least", -(2**62)), ("at_most", 2**62)))
        bound = ~(pc.is_null(asks["at_least"]).to_numpy() & pc.is_null(asks["at_most"]).to_numpy())
        none, at = pc.is_null(rows["at"]).to_numpy(), pc.fill_null(rows["at"], 0).to_numpy()
        checks.append(lambda s, e: np.where(none[None, s:e], ~bound[:, None], (at[None, s:e] >= first[:, None]) & (at[None, s:e] <= last[:, None])))

    def passing(start: int, end: int) -> np.ndarray | None:
        out = None
        for check in checks:
            found = check(start, end)
            out = found if out is None else out & found
        return out

    return passing


class _Shared:
    """Which queries and rows agree in a bucket."""

    def __init__(self, asks: np.ndarray, rows: np.ndarray) -> None:
        self.asks, self.rows = np.ascontiguousarray(asks.T), np.ascontiguousarray(rows.T)

    def block(self, asks: np.ndarray, start: int, end: int) -> np.ndarray:
        out = np.zeros((len(asks), end - start), bool)
        for a, r in zip(self.asks, self.rows, strict=True):
            out |= a[asks][:, None] == r[None, start:end]
        return out

    def each(self, ask: np.ndarray, row: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ask), bool)
        for a, r in zip(self.asks, self.rows, strict=True):
            out |= a[ask] == r[row]
        return out


def _meeting(metric: str, same: tuple[str, ...], among: tuple[str, ...], timed: bool, pairs: int, buckets: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def meet(rows: pa.Table, asks: pa.Table) -> pa.Table:
        if not rows.num_rows or not asks.num_rows:
            return pa.table({"query_id": asks["query_id"].slice(0, 0), "vector_id": rows["vector_id"].slice(0, 0), "distance": pa.array([], pa.float64())})
        rows = rows.sort_by("vector_id")  # so that a later row never wins among equals
        m = _Metric(metric, _matrix(rows["embedding"]), _matrix(asks["query_vector"]))
        passing, k = _passes(rows, asks, same, among, timed), asks["first_k"].to_numpy()
        ask, row, value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        worst = np.full(len(k), np.inf)  # the value of the last row that a query would keep; infinite while it has too few
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        shared = _Shared(_matrix(asks["buckets"], np.int64), _matrix(rows["buckets"], np.int64)) if buckets else None
        step = max(1, pairs // len(k))
        for start in range(0, rows.num_rows, step):
            end = min(start + step, rows.num_rows)
            far, allowed = m.quick(start, end), passing(start, end)
            if allowed is not None:
                far[~allowed] = np.inf
            edge = m.below(worst, -_HALF, slice(None))
            open_ = np.flatnonzero(np.isinf(worst))
            if len(open_) and shared:
                far[open_] = np.where(shared.block(open_, start, end), far[open_], np.inf)
            if len(open_):
                at = min(int(k[open_].max()), end - start) - 1
                last = np.partition(far[open_], at, axis=1)[:, at]
                edge[open_] = m.below(np.sqrt(np.maximum(last, 0)) if metric == "l2" else last, 4 * _HALF, open_) + m.slack[open_]
                if metric == "l2":  # a root of what rounding has moved
                    edge[open_] += 2 * np.sqrt(m.slack[open_]) * 4 * _HALF
            a, r = np.nonzero(far < edge[:, None])
            if shared:
                met = shared.each(a, r + start)
                a, r = a[met], r[met]
            v = m.exact(a, r + start)
            better = v < worst[a]
            waiting.append((a[better], r[better] + start, v[better]))
            if len(open_) or end == rows.num_rows or sum(len(x[0]) for x in waiting) * 2 > len(ask):
                ask, row, value = (np.concatenate([own, *(x[i] for x in waiting)]) for i, own in enumerate((ask, row, value)))
                waiting = []
                order = np.lexsort((row, value, ask))
                ask, row, value = ask[order], row[order], value[order]
                place = np.arange(len(ask)) - np.searchsorted(ask, np.arange(len(k)))[ask]
                full = place == k[ask] - 1
                worst[ask[full]] = value[full]
                kept = place < k[ask]
                ask, row, value = ask[kept], row[kept], value[kept]
        return pa.table({"query_id": asks["query_id"].take(pa.array(ask)), "vector_id": rows["vector_id"].take(pa.array(row)), "distance": -value if metric == "ip" else value})

    return meet
