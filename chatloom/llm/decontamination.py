"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Words are runs of letters, digits and non-ASCII characters, in lower case, so that case, spacing and punctuation
don't matter. Window widths form a geometric ladder. Each benchmark item is fingerprinted at the widest step that fits
into it and at the widest that fits into half of it, in a few places; each text at the same widths, at every word. With
64 bits in four blocks, fingerprints within a radius of 7 agree up to one bit in at least one block, so the block tables
hold every item block with each of its bits flipped: no fingerprint within the radius is missed. A hit says where the whole
item would lie in the text; the shingles of that stretch and of the item then decide. A shingle of the item weighs more the fewer
items of the whole benchmark have it; one that the item lacks weighs as much as one that no item has.

A window's fingerprint is a majority of its words' bits. The bits are summed eight to a 64-bit number, one a byte, by
running sums over the batch; differences of those give all windows of one width at once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm import arrays
from chatloom.scratch import written

WIDTHS = (1, 2, 3, 5, 8, 12, 18, 27, 40, 60, 90, 135, 200)
RADIUS = 7
BLOCKS, BLOCK_BITS = 4, 16
SHINGLE = 5
THRESHOLD = 0.8
#: Items go to the tasks in slices of about this many bytes of text; each slice is one more pass over the texts.
SLICE_BYTES = 8 << 20

_ONES = np.uint64(0x0101010101010101)
_TOPS = np.uint64(0x8080808080808080)
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = arrays.lowered(raw)
    starts, ends, bounds = arrays.runs(_INSIDE[low], offsets)
    return arrays.span_hashes(low, starts, ends), bounds


def running_bits(hashes: np.ndarray) -> list[np.ndarray]:
    """Eight running sums; the k-th holds the words' bits k, k + 8, ... in a byte each, modulo 2**64."""
    out = []
    for k in range(8):
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum((hashes >> np.uint64(k)) & _ONES, dtype=np.uint64, out=sums[1:])
        out.append(sums)
    return out


def fingerprints(sums: list[np.ndarray], width: int) -> np.ndarray:
    """The SimHash of every run of ``width`` words (at most 254): the bits that over half of them have."""
    total = np.zeros(max(0, len(sums[0]) - width), np.uint64)
    bias = np.uint64(127 - width // 2) * _ONES
    for k in range(8 if len(total) else 0):
        total |= ((sums[k][width:] - sums[k][:-width] + bias) & _TOPS) >> np.uint64(7 - k)
    return total


def widths_for(length: int) -> set[int]:
    fits = [w for w in WIDTHS if w <= length]
    halves = [w for w in WIDTHS if w <= length // 2 and w >= SHINGLE]
    return {fits[-1]} | set(halves[-1:])


@dataclass
class Width:
    """What the items look like at one window width."""

    prints: np.ndarray
    items: np.ndarray
    shifts: np.ndarray
    #: per block: first entry of each value, and the entries themselves
    starts: list[np.ndarray] = field(default_factory=list)
    entries: list[np.ndarray] = field(default_factory=list)

    def index(self) -> Width:
        flips = np.concatenate([[0], 1 << np.arange(BLOCK_BITS)])
        for b in range(BLOCKS):
            value = ((self.prints >> np.uint64(b * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)
            near = (value[:, None] ^ flips).ravel()
            order = np.argsort(near, kind="stable")
            self.entries.append(np.repeat(np.arange(len(value)), len(flips))[order].astype(np.int32))
            self.starts.append(np.searchsorted(near[order], np.arange((1 << BLOCK_BITS) + 1)).astype(np.int32))
        return self

    def search(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(window, entry)`` of all pairs within the radius, each once."""
        found = []
        for b in range(BLOCKS):
            value = ((prints >> np.uint64(b * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)
            first, count = self.starts[b][value], self.starts[b][value + 1] - self.starts[b][value]
            hit = np.flatnonzero(count)
            count, first = count[hit], first[hit]
            window = np.repeat(hit, count)
            entry = self.entries[b][np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())]
            near = np.bitwise_count(prints[window] ^ self.prints[entry]) <= RADIUS
            found.append(window[near] * np.int64(len(self.prints)) + entry[near])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.prints), pairs % len(self.prints)


class Index:
    """A slice of the benchmark, ready for the tasks."""

    def __init__(self, ids: list, texts: list[str], n_items: int, having: dict[int, int] | None = None):
        """``n_items`` and ``having`` are of the whole benchmark; without ``having`` this slice is all of it."""
        self.ids = ids
        hashes, bounds = words(*arrays.text_bytes(pa.array(texts, pa.string())))
        self.lengths = np.diff(bounds)
        shingles, ends = arrays.shingles(hashes, bounds, SHINGLE)
        self.sets = [dict.fromkeys(shingles[a:b].tolist(), 0.0) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        if having is None:
            having = Counter(x for s in self.sets for x in s)
        self.rarest = math.log(1 + (n_items + 1))
        self.weight = {x: math.log(1 + (n_items + 1) / (having[x] + 1)) for s in self.sets for x in s}
        self.total = np.array([sum(self.weight[x] for x in s) for s in self.sets])
        self.known = np.array(sorted(self.weight), np.uint64)
        self.known_weight = np.array([self.weight[x] for x in sorted(self.weight)])
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.known >> np.uint64(48)).astype(np.int64)] = True
        self.widths: dict[int, Width] = {}
        sums = running_bits(hashes)
        by_width: dict[int, list[tuple[int, int, int]]] = {}
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            for w in widths_for(b - a) if b > a else ():
                room = b - a - w
                for shift in sorted({0, room // 3, room // 2, 2 * room // 3, room}):
                    by_width.setdefault(w, []).append((a + shift, i, shift))
        for w, places in sorted(by_width.items()):
            at, items, shifts = (np.array(x) for x in zip(*places, strict=True))
            self.widths[w] = Width(fingerprints(sums, w)[at], items, shifts).index()

    def similarity(self, item: int, shingles: np.ndarray) -> float:
        """Weighted Jaccard similarity of an item and a stretch of text."""
        shared = other = 0.0
        for x in set(shingles.tolist()):
            if x in self.sets[item]:
                shared += self.weight[x]
            else:
                other += self.rarest
        return shared / (self.total[item] + other)

    def weights(self, shingles: np.ndarray) -> np.ndarray:
        """The weight of each shingle that some item has; 0 for others."""
        out = np.zeros(len(shingles))
        at = np.flatnonzero(self.maybe[(shingles >> np.uint64(48)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.known, shingles[at]), len(self.known) - 1)
        out[at] = np.where(self.known[place] == shingles[at], self.known_weight[place], 0.0)
        return out

    def hits(self, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float, int]]:
        """``(row, item, similarity, first word)`` for each row and item that verify, with the best stretch."""
        hashes, bounds = words(raw, offsets)
        if not len(hashes) or not self.widths:
            return []
        sums = running_bits(hashes)
        ends = np.repeat(bounds[1:], np.diff(bounds))
        candidates = []
        for w, own in self.widths.items():
            prints = fingerprints(sums, w)
            inside = np.flatnonzero(np.arange(len(prints)) + w <= ends[: len(prints)])
            window, entry = own.search(prints[inside])
            at, item = inside[window], own.items[entry]
            row = np.searchsorted(bounds, at, side="right") - 1
            first = np.clip(at - own.shifts[entry], bounds[row], None)
            candidates.append(np.stack([row, item, first], axis=1))
        row, item, first = np.unique(np.concatenate(candidates), axis=0).T
        # a stretch can't reach the threshold unless the items' shingles in it weigh enough, which running sums tell
        shingles, upto = arrays.shingles(hashes, bounds, SHINGLE)
        sums_of_weight = np.concatenate([[0.0], np.cumsum(self.weights(shingles))])
        last = np.minimum(first + self.lengths[item], bounds[row + 1])
        lo = upto[row] + first - bounds[row]
        hi = np.minimum(np.maximum(lo + last - first - SHINGLE + 1, lo), upto[row + 1])
        short = self.lengths[item] < SHINGLE
        go = short | (sums_of_weight[hi] - sums_of_weight[lo] >= THRESHOLD * self.total[item] - 1e-6)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for r, i, f, t, a, b in np.stack([row, item, first, last, lo, hi], axis=1)[go].tolist():
            own = shingles[a:b] if self.lengths[i] >= SHINGLE else arrays.shingles(hashes[f:t], np.array([0, t - f]), SHINGLE)[0]
            score = self.similarity(i, own)
            if score >= THRESHOLD - 1e-9 and score > best.get((r, i), (0.0, 0))[0]:
                best[r, i] = (score, f - int(bounds[r]))
        return [(row, item, score, first) for (row, item), (score, first) in sorted(best.items())]


def _item_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(slice, shingle)`` for each item's distinct shingles."""
    for batch in batches:
        for first, last, raw, offsets in arrays.pieces(batch.column(1)):
            hashes, bounds = arrays.sets(*arrays.shingles(*words(raw, offsets), SHINGLE))
            of = batch.column(0).slice(first, last - first).take(pa.array(np.repeat(np.arange(last - first), np.diff(bounds))))
            yield pa.record_batch([of, pa.array(hashes.view(np.int64))], ["slice", "shingle"])


def _slices(benchmark: DataFrame, text: str, key: str) -> Iterator[Index]:
    """The benchmark in slices that fit into a task, one at a time. Null texts and those without words match nothing.

    How many items have a shingle is counted over the whole benchmark; the driver gets the counts of one slice's shingles.
    """
    items = benchmark.select(F.col(key).alias("item_id"), F.col(text).alias("text")).where("text is not null")
    found = items.agg(F.sum(F.octet_length("text")).alias("size"), F.count(F.lit(1)).alias("n")).first()
    n = -(-(found["size"] or 0) // SLICE_BYTES)
    items = items.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n))).cast("long"))
    counts = None
    if n > 1:
        once = items.select("slice", "text").mapInArrow(_item_shingles, "slice bigint, shingle bigint")
        counts = written(once.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.collect_set("slice").alias("slices")), "benchmark-shingles")
    for k in range(n):
        rows = items.where(F.col("slice") == k).orderBy("item_id", "text").collect()
        if rows:
            own = counts and counts.where(F.array_contains("slices", F.lit(k).cast("long"))).select("shingle", "n").toArrow()
            having = own and dict(zip(own.column(0).to_numpy().view(np.uint64).tolist(), own.column(1).to_pylist(), strict=True))
            yield Index([r.item_id for r in rows], [r.text for r in rows], found["n"], having or None)


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """``key, item_id, similarity, first_word`` for each row and each benchmark item that it holds nearly whole.

    ``similarity`` is that of the best stretch; ``first_word`` is where it begins. Null or empty texts and items match
    nothing. An item of fewer than five words is one shingle, so only its exact words match. Repeated rows or items each
    give rows. An empty table on either side gives no rows. Other columns don't matter, whatever their names.
    """
    spark = docs.sparkSession
    kinds = [docs.select(F.col(key)).schema[0].dataType.simpleString(), benchmark.select(F.col(item_key)).schema[0].dataType.simpleString()]
    schema = f"key {kinds[0]}, item_id {kinds[1]}, similarity double, first_word bigint"
    out = spark.createDataFrame([], schema)
    for index in _slices(benchmark, item_text, item_key):
        held = spark.sparkContext.broadcast(index)
        del index  # the driver keeps the broadcast's file only

        def task(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, last, raw, offsets in arrays.pieces(batch.column(1)):
                    if found := held.value.hits(raw, offsets):
                        rows, items, scores, starts = zip(*found, strict=True)
                        keys = batch.column(0).slice(first, last - first).take(pa.array(rows))
                        yield pa.record_batch([keys, pa.array([held.value.ids[i] for i in items]), pa.array(scores), pa.array(starts, pa.int64())], ["key", "item_id", "similarity", "first_word"])

        out = out.union(docs.select(F.col(key), F.col(text)).mapInArrow(task, schema))
    return out.withColumnRenamed("key", key)


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, in full. One pass for each slice of the benchmark, no shuffle."""
    spark = docs.sparkSession
    at = docs.columns.index(text)
    for index in _slices(benchmark, item_text, item_key):
        held = spark.sparkContext.broadcast(index)
        del index  # the driver keeps the broadcast's file only

        def task(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for first, _, raw, offsets in arrays.pieces(batch.column(at)):
                    for row, *_ in held.value.hits(raw, offsets):
                        keep[first + row] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(task, docs.schema)
    return docs
