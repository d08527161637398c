"""Scores of texts under a hashed maximum-entropy language model with class-factored softmax.

``p(token | text before) = p(class | context) * p(token | class, context)``. The most frequent tokens are classes of their
own, all others share classes by a hash of their last two bytes. Both factors are softmaxes with hashed features:

* The class softmax has three features of the two tokens before: the last one, the one before it with the last one skipped,
  and the pair of them. A context is known by the buckets of its two tokens, so its training data come down to counts of
  (context, class), a table of bounded size that all training tokens are counted into. Gradients are computed on its
  blocks in parallel and added up; every round is one full-batch update.
* The softmax inside a class has each token's own bias and one feature for each pair of last token's bucket and token that
  the training texts hold. These weights are a distributed table that grows with the corpus. Given the normalisers of the
  round before, a few numbers for each class and bucket, every weight is updated on its own by Newton's steps on its
  penalised likelihood; then the normalisers are summed anew. Unseen tokens have a share of each class, so every text has
  a probability.

Tasks get the most frequent pairs with their weights, whose number is bounded; the others' tokens, few of all occurrences,
are joined with the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm import arrays
from chatloom.scratch import recorded, release_paths, written

#: Classes: OWN_CLASSES frequent tokens, the others in SHARED_CLASSES.
OWN_CLASSES, SHARED_CLASSES = 20, 12
CLASSES = OWN_CLASSES + SHARED_CLASSES
#: Buckets of context tokens: 0 before the text, OWN_BUCKETS frequent tokens, the others in the rest.
BUCKETS, OWN_BUCKETS = 256, 200
CONTEXTS = BUCKETS * BUCKETS
#: Hash buckets of the pair feature.
PAIRS = 4096
FEATURES = 1 + 2 * BUCKETS + PAIRS
BLOCKS = 64
ROUNDS, RATE, DECAY = 25, 0.5, 1e-6
#: Rounds of the weights inside classes, Newton steps in each, and the penalty on half their squares.
INSIDE_ROUNDS, NEWTON_STEPS, PENALTY = 6, 8, 0.5
#: About this many of the most frequent pairs go to all tasks, with their weights (42 MB).
HEAD = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
LOG_E = math.log10(math.e)
FLUSH = 1 << 20
END = np.uint64(0x51ED270B9F1C4D33)


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hashes, tails, bounds)``: each row's words in lower case and one end, and a hash of each token's last two bytes."""
    low = arrays.lowered(raw)
    starts, ends, bounds = arrays.runs(~arrays.SPACES[low], offsets)
    n = len(bounds) - 1
    rows = np.arange(n)
    hashes = np.full(len(starts) + n, END, np.uint64)
    tails = np.zeros(len(hashes), np.int64)
    real = np.ones(len(hashes), bool)
    real[bounds[1:] + rows] = False
    hashes[real] = arrays.span_hashes(low, starts, ends)
    last = low[ends - 1].astype(np.uint64) << np.uint64(8) | low[np.maximum(ends - 2, starts)].astype(np.uint64)
    tails[real] = (arrays.mixed(last) >> np.uint64(40)).astype(np.int64)
    return hashes, tails, bounds + np.arange(n + 1)


def _count(top_of=None):
    """``(token, place, n)`` for the distinct tokens of a task, or of each stretch of it that fits into memory.

    ``place`` is 0 without the top tokens; with them it holds the bucket of the token before and the token's class.
    """
    def summed(parts: list) -> tuple[np.ndarray, ...]:
        keys, names, places, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        found, first, back = np.unique(keys, return_index=True, return_inverse=True)
        return found, names[first], places[first], np.bincount(back, weights=n).astype(np.int64)

    def rows(part: tuple) -> pa.RecordBatch:
        return pa.record_batch([pa.array(part[1].view(np.int64)), pa.array(part[2]), pa.array(part[3])], ["token", "place", "n"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for _, _, raw, offsets in arrays.pieces(batch.column(0)):
                names, tails, bounds = tokens(raw, offsets)
                place = np.zeros(len(names), np.int16)
                if top_of is not None:
                    top = top_of.value
                    place = (top.contexts(names, tails, bounds) % BUCKETS * CLASSES + top.classes(names, tails)).astype(np.int16)
                held.append(summed([(pair_keys(names, place // CLASSES), names, place, np.ones(len(names), np.int64))]))
                if sum(len(x[0]) for x in held) > FLUSH:
                    held = [summed(held)]
                    if len(held[0][0]) > FLUSH // 2:
                        yield rows(held[0])
                        held = []
        if held:
            yield rows(summed(held))

    return task


COUNTED = "token bigint, place smallint, n bigint"


def pair_keys(names: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each token with the bucket of the one before."""
    return arrays.mixed(names + (buckets.astype(np.uint64) + np.uint64(1)) * _STEP)


@dataclass
class Top:
    """The most frequent tokens, most frequent first, with their counts."""

    names: np.ndarray
    counts: np.ndarray

    def number(self, names: np.ndarray, own: int) -> np.ndarray:
        """The place of each token among the ``own`` most frequent ones; -1 for others."""
        top = self.names[:own]
        if not len(top):
            return np.full(len(names), -1)
        order = np.argsort(top)
        at = np.minimum(np.searchsorted(top[order], names), len(top) - 1)
        return np.where(top[order][at] == names, order[at], -1)

    def classes(self, names: np.ndarray, tails: np.ndarray) -> np.ndarray:
        own = self.number(names, OWN_CLASSES)
        return np.where(own >= 0, own, OWN_CLASSES + tails % SHARED_CLASSES)

    def contexts(self, names: np.ndarray, tails: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """``bucket of the token two before * BUCKETS + bucket of the one before`` for each token."""
        own = self.number(names, OWN_BUCKETS)
        bucket = np.where(own >= 0, own + 1, 1 + OWN_BUCKETS + tails % (BUCKETS - 1 - OWN_BUCKETS))
        before, two_before = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        before[1:], two_before[2:] = bucket[:-1], bucket[:-2]
        before[bounds[:-1]] = 0
        two_before[bounds[:-1]] = 0
        second = bounds[:-1] + 1
        two_before[second[second < bounds[1:]]] = 0
        return two_before * BUCKETS + before


@dataclass
class Head:
    """The frequent pairs in an open hash table, with their tokens' counts and their weights."""

    keys: np.ndarray
    counts: np.ndarray
    weights: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> Head:
        size = 1 << max(4, (2 * len(keys) - 1).bit_length())
        table, own, values = np.zeros(size, np.uint64), np.zeros(size, np.int64), np.zeros(size, np.float32)
        left = np.arange(len(keys))
        at = (keys & np.uint64(size - 1)).astype(np.int64)
        while len(left):  # one of those that want a free place takes it, the others move on
            free = left[own[at[left]] == 0]
            table[at[free]], own[at[free]], values[at[free]] = keys[free], counts[free], weights[free]
            left = left[table[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & (size - 1)
        return Head(table, own, values)

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and weights; 0 for pairs outside the head."""
        mask = len(self.keys) - 1
        at = (keys & np.uint64(mask)).astype(np.int64)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.counts[at] > 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            open_ = open_[(self.keys[at[open_]] != keys[open_]) & (self.counts[at[open_]] > 0)]
        found = self.keys[at] == keys
        return np.where(found, self.counts[at], 0), np.where(found, self.weights[at].astype(np.float64), 0.0)


def _head(weights: DataFrame, most: int | None = None) -> Head:
    """About ``most`` of the most frequent pairs by the steps of a logarithmic scale; of the step in which the cut falls, those with the least hashes."""
    most = HEAD if most is None else most
    pairs = weights.select("token", "n", F.explode(F.arrays_zip("buckets", "counts", "weights")).alias("p")).select("token", "n", "p.*")
    step = F.floor(F.log2("counts") * 16)
    cut, share, total = None, 0, 0
    for row in sorted(pairs.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        if total + row["count"] > most:
            cut, share = row["step"], (most - total) / row["count"]
            break
        total += row["count"]
    if cut is not None:
        low = F.pmod(F.xxhash64("token", "buckets"), F.lit(1 << 20)) < int(share * (1 << 20))
        pairs = pairs.where((step > cut) | ((step == cut) & low))
    rows = pairs.select("token", "n", "buckets", "weights").toArrow()
    keys = pair_keys(rows.column("token").to_numpy().view(np.uint64), rows.column("buckets").to_numpy())
    return Head.of(keys, rows.column("n").to_numpy(), rows.column("weights").to_numpy())


def feature_weights(n: np.ndarray, seen: np.ndarray, share: np.ndarray, normaliser: np.ndarray) -> np.ndarray:
    """The weights at which the penalised likelihood's derivative ``n - seen * share * e**w / normaliser - PENALTY * w`` is 0.

    ``n``: how often the pair occurs; ``seen``: how often its bucket comes before a token of the class; ``share``: the token's
    share of the class. The derivative is concave, so Newton's steps from the right of its root don't overshoot.
    """
    a = seen * share / normaliser
    w = np.maximum(0, np.minimum(n / PENALTY, np.log(n / a)))
    for _ in range(NEWTON_STEPS):
        expected = a * np.exp(w)
        w = w + (n - expected - PENALTY * w) / (expected + PENALTY)
    return w.astype(np.float32)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """``(token's number in the batch, its count, cell of bucket and class, class, pair's count)`` of each pair."""
    lists = batch.column(batch.schema.get_field_index("buckets"))
    times = batch.column(batch.schema.get_field_index("counts")).flatten().to_numpy()
    of = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
    classes = batch.column(batch.schema.get_field_index("class")).to_numpy()[of].astype(np.int64)
    return of, batch.column(batch.schema.get_field_index("n")).to_numpy()[of], lists.flatten().to_numpy().astype(np.int64) * CLASSES + classes, classes, times


@dataclass
class Inside:
    """What the weights inside classes depend on: class sizes, how often each bucket comes before a class, normalisers."""

    sizes: np.ndarray
    seen: np.ndarray
    normaliser: np.ndarray

    def weights(self, n: np.ndarray, cells: np.ndarray, classes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight and share of each pair's token; a token that is a class has weight 0."""
        share = (n + 1) / self.sizes[classes]
        return np.where(classes < OWN_CLASSES, np.float32(0), feature_weights(times, self.seen[cells], share, self.normaliser[cells])), share


def _cell_sums(tokens_: DataFrame, inside_of=None) -> np.ndarray:
    """For each bucket and class, the sum over its pairs of their counts, or with weights of ``share * (e**w - 1)``."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(BUCKETS * CLASSES)
        for batch in batches:
            _, n, cells, classes, times = _flat(batch)
            value = times
            if inside_of is not None:
                w, share = inside_of.value.weights(n, cells, classes, times)
                value = share * np.expm1(w.astype(np.float64))
            out += np.bincount(cells, weights=value, minlength=len(out))
        cells = np.flatnonzero(out)
        yield pa.record_batch([pa.array(cells, pa.int32()), pa.array(out[cells])], ["cell", "value"])

    rows = tokens_.select("n", "class", "buckets", "counts").mapInArrow(task, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(BUCKETS * CLASSES)
    for row in rows:
        out[row["cell"]] = row["value"]
    return out


def _weighted(inside_of):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, n, cells, classes, times = _flat(batch)
            w, _ = inside_of.value.weights(n, cells, classes, times)
            buckets = batch.column(2)
            bounds = pa.array(np.append(0, np.cumsum(buckets.value_lengths().to_numpy())).astype(np.int32))
            yield pa.record_batch([batch.column(0), batch.column(1), buckets, batch.column(3), pa.ListArray.from_arrays(bounds, pa.array(w, pa.float32()))], ["token", "n", "buckets", "counts", "weights"])

    return task


def _context_counts(head_of):
    """``(block, cells, counts)``: how often each class follows each context, packed by blocks of contexts."""
    schema = pa.schema([("block", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, total = head_of.value, np.zeros(CONTEXTS * CLASSES, np.int32)
        for batch in batches:
            for _, _, raw, offsets in arrays.pieces(batch.column(0)):
                names, tails, bounds = tokens(raw, offsets)
                cell = head.contexts(names, tails, bounds) * CLASSES + head.classes(names, tails)
                found, n = np.unique(cell, return_counts=True)
                total[found] += n.astype(np.int32)
        for block, some in enumerate(np.split(total, BLOCKS)):
            cells = np.flatnonzero(some)
            if len(cells):
                yield pa.record_batch([pa.array([block], pa.int32()), pa.array([cells.astype(np.int32).tobytes()], pa.binary()), pa.array([some[cells].tobytes()], pa.binary())], schema)

    return task


def _block_sum(table: pa.Table) -> pa.Table:
    total = np.zeros(CONTEXTS * CLASSES // BLOCKS, np.int64)
    for cells, counts in zip(table.column("cells"), table.column("counts"), strict=True):
        total[np.frombuffer(cells.as_py(), np.int32)] += np.frombuffer(counts.as_py(), np.int32)
    cells = np.flatnonzero(total)
    return pa.table({"block": table.column("block").slice(0, 1), "cells": pa.array([cells.astype(np.int32).tobytes()], pa.binary()), "counts": pa.array([total[cells].tobytes()], pa.binary())})


def features(contexts: np.ndarray) -> np.ndarray:
    """The three features of each context besides the bias, as rows of the weights."""
    before, two_before = contexts % BUCKETS, contexts // BUCKETS
    pair = (arrays.mixed(contexts.astype(np.uint64)) % np.uint64(PAIRS)).astype(np.int64)
    return np.stack([1 + before, 1 + BUCKETS + two_before, 1 + 2 * BUCKETS + pair], axis=1)


def class_probabilities(weights: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    scores = weights[0] + weights[features(contexts)].sum(axis=1)
    scores -= scores.max(axis=1, keepdims=True)
    out = np.exp(scores)
    return out / out.sum(axis=1, keepdims=True)


def _gradient(weights_of):
    """Gradient of the log likelihood over a task's blocks, as one row of packed numbers, and the number of tokens."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, out, n = weights_of.value, np.zeros((FEATURES, CLASSES)), 0
        for batch in batches:
            for block, cells, counts in zip(*(batch.column(c) for c in ("block", "cells", "counts")), strict=True):
                dense = np.zeros(CONTEXTS * CLASSES // BLOCKS)
                dense[np.frombuffer(cells.as_py(), np.int32)] = np.frombuffer(counts.as_py(), np.int64)
                seen = dense.reshape(-1, CLASSES)
                contexts = block.as_py() * len(seen) + np.arange(len(seen))
                used = np.flatnonzero(seen.any(axis=1))
                seen, contexts = seen[used], contexts[used]
                miss = seen - seen.sum(axis=1, keepdims=True) * class_probabilities(weights, contexts)
                out[0] += miss.sum(axis=0)
                np.add.at(out, features(contexts).ravel(), np.repeat(miss, 3, axis=0))
                n += int(seen.sum())
        if n:
            yield pa.record_batch([pa.array([out.astype(np.float32).tobytes()], pa.binary()), pa.array([n])], ["gradient", "n"])

    return task


def trained_weights(blocks: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Class weights after ``rounds`` full-batch updates, each feature's step scaled by its past gradients.

    ``blocks`` has BLOCKS rows at most; a round's gradients are as many arrays of fixed size at most.
    """
    sc = blocks.sparkSession.sparkContext
    blocks = blocks.coalesce(sc.defaultParallelism)
    weights, squares = np.zeros((FEATURES, CLASSES)), np.full((FEATURES, CLASSES), 1e-8)
    for _ in range(rounds):
        held = sc.broadcast(weights)
        parts = blocks.mapInArrow(_gradient(held), "gradient binary, n bigint").collect()
        total = sum(p["n"] for p in parts)
        if not total:
            break
        step = sum(np.frombuffer(p["gradient"], np.float32).reshape(FEATURES, CLASSES).astype(np.float64) for p in parts) / total - DECAY * weights
        squares += step**2
        weights = weights + RATE * step / np.sqrt(squares)
        held.unpersist()
    return weights


@dataclass
class Model:
    top: Top
    head: Head
    #: log10 of the class probabilities by context and class
    classes: np.ndarray
    #: log10 of the denominators inside each class, by the bucket before and class
    inside: np.ndarray
    n: int
    distinct: int

    def scored(self, raw: np.ndarray, offsets: np.ndarray) -> tuple:
        """Per row: tokens, those known, log10 base and model scores without what the tail's tokens add; then those tokens, the buckets before them, and their bounds."""
        names, tails, bounds = tokens(raw, offsets)
        contexts, classes = self.top.contexts(names, tails, bounds), self.top.classes(names, tails)
        before = contexts % BUCKETS
        counts, weights = self.head.look_up(pair_keys(names, before))
        own = np.flatnonzero(classes < OWN_CLASSES)
        counts[own], weights[own] = self.top.counts[classes[own]], 0
        known = counts > 0
        logs = np.log10(counts + 1.0)
        model = self.classes[contexts * CLASSES + classes] + logs + weights * LOG_E - self.inside[before * CLASSES + classes]
        sums = [arrays.row_sums(x, bounds) for x in (known.astype(np.int64), logs, model)]
        tail = np.flatnonzero(~known)
        return np.diff(bounds), *sums, names[tail], before[tail].astype(np.int16), np.searchsorted(tail, bounds)


def trained(docs: DataFrame, text: str = "text") -> tuple[Model, DataFrame]:
    """The model of all rows of ``docs``, and the table ``(token, n, buckets, counts, weights)`` of all their tokens.

    A token's lists have a place for each bucket that comes before it: BUCKETS at most.
    """
    sc, texts = docs.sparkSession.sparkContext, docs.select(F.col(text).alias("text"))
    counted = texts.mapInArrow(_count(), COUNTED).groupBy("token").agg(F.sum("n").alias("n"))
    most = counted.orderBy(F.col("n").desc(), "token").limit(max(OWN_BUCKETS, OWN_CLASSES)).collect()
    top = Top(np.array([r["token"] for r in most], np.int64).view(np.uint64), np.array([r["n"] for r in most], np.int64))
    top_of = sc.broadcast(top)
    with recorded() as made:
        pairs = texts.mapInArrow(_count(top_of), COUNTED).repartition("token").groupBy("token", "place").agg(F.sum("n").alias("n"))
        seen = F.collect_list(F.struct(F.floor(F.col("place") / CLASSES).cast("smallint").alias("bucket"), "n"))
        grouped = pairs.groupBy("token").agg(F.sum("n").alias("n"), F.min(F.col("place") % CLASSES).cast("smallint").alias("class"), seen.alias("seen"))
        tokens_ = written(grouped.select("token", "n", F.col("seen.bucket").alias("buckets"), F.col("seen.n").alias("counts"), "class"), "lm-tokens")
    sizes = np.ones(CLASSES)
    n = distinct = 0
    for row in tokens_.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct")).collect():
        sizes[row["class"]] = row["n"] + row["distinct"] + (row["class"] >= OWN_CLASSES)  # one more for unseen tokens
        n, distinct = n + row["n"], distinct + row["distinct"]
    inside = Inside(sizes, _cell_sums(tokens_), np.ones(BUCKETS * CLASSES))
    for last in range(INSIDE_ROUNDS, -1, -1):
        inside_of = sc.broadcast(inside)
        normaliser = 1 + _cell_sums(tokens_, inside_of)
        if last:
            inside = Inside(sizes, inside.seen, normaliser)
    weights = tokens_.mapInArrow(_weighted(inside_of), "token bigint, n bigint, buckets array<smallint>, counts array<bigint>, weights array<float>")
    weights = written(weights, "lm-weights")
    release_paths(docs.sparkSession, made, keep=weights)
    head = _head(weights)
    blocks = texts.mapInArrow(_context_counts(top_of), "block int, cells binary, counts binary").groupBy("block")
    blocks = written(blocks.applyInArrow(_block_sum, "block int, cells binary, counts binary"), "lm-contexts")
    class_weights = trained_weights(blocks)
    log_classes = np.concatenate([np.log10(class_probabilities(class_weights, some)) for some in np.split(np.arange(CONTEXTS), BLOCKS)])
    denominators = np.log10(np.tile(sizes, BUCKETS) * normaliser)
    return Model(top, head, log_classes.ravel().astype(np.float32), denominators, n, distinct), weights


def scored(df: DataFrame, model: Model, weights: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of every row with ``n_tokens, n_known, train_tokens, base_score, score``.

    Scores are log10 probabilities of the whole text and its end. Null text counts as empty: its end alone. Repeated rows
    get a row each; no rows, no result. Columns of ``df`` not in ``keep`` don't matter, whatever their names.
    """
    held = df.sparkSession.sparkContext.broadcast(model)
    kept = [df.schema[c] for c in keep]
    fields = ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(kept))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, last, raw, offsets in arrays.pieces(batch.column(0)):
                n = last - first
                n_tokens, known, logs, score, tail, before, tail_bounds = held.value.scored(raw, offsets)
                cuts = pa.array(tail_bounds.astype(np.int32))
                tails = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (tail.view(np.int64), before)]
                own = [c.slice(first, n) for c in batch.columns[1:]]
                yield pa.record_batch([pa.array(serial + np.arange(n)), pa.array(n_tokens), pa.array(known), pa.array(logs), pa.array(score), *tails, *own], ["row", "n_tokens", "known", "logs", "part", "tail", "before", *(f"k{i}" for i in range(len(own)))])
                serial += n

    rows = df.select(F.col(text).alias("text"), *(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)))
    rows = written(rows.mapInArrow(task, f"row bigint, n_tokens bigint, known bigint, logs double, part double, tail array<bigint>, before array<smallint>, {fields}"), "lm-rows")
    tail = rows.select("row", F.explode(F.arrays_zip("tail", "before")).alias("t")).select("row", F.col("t.tail").alias("token"), "t.before")
    weight = F.coalesce(F.get("weights", (F.array_position("buckets", F.col("before")) - 1).cast("int")).cast("double"), F.lit(0.0))
    tail = tail.join(weights.select("token", "n", "buckets", "weights"), "token").select("row", F.log10(F.col("n") + 1.0).alias("log"), (weight * LOG_E).alias("weight"))
    tail = tail.groupBy("row").agg(F.count(F.lit(1)).alias("tail_known"), F.sum("log").alias("tail_logs"), F.sum(F.col("log") + F.col("weight")).alias("tail_part"))
    out = rows.drop("tail", "before").join(tail, "row", "left").fillna({"tail_known": 0, "tail_logs": 0.0, "tail_part": 0.0})
    per_token = math.log10(model.n + model.distinct + 1)
    return out.select(
        *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "n_tokens", (F.col("known") + F.col("tail_known")).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("tail_logs") - F.col("n_tokens") * per_token).alias("base_score"), (F.col("part") + F.col("tail_part")).alias("score"),
    )
