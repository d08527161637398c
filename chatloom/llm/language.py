"""Language identification as a mixture: which languages a text is written in, and in which shares.

Training counts the hashed letter trigrams of every labelled text by language, one table of fixed size a language. A
text is then a bag of words, each drawn from one of the languages: the trigrams of a word give its likelihood in each,
and expectation-maximisation finds the languages' shares of the words. Sets of languages are tried from all the learned ones
downwards: the language whose loss costs the least likelihood goes, and the shares of those left are estimated anew,
until one is left; the likeliest single language is tried too. The set with the best likelihood after a penalty for each
language in it is chosen, so that a few odd words don't add one. The answer is the language with the largest share in that set.

Trigrams are over bytes of the words in lower case (A-Z only), with one blank on either side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.llm import arrays

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
SMOOTHING = 0.5
#: Rounds of expectation-maximisation over all languages, and over each smaller set from the shares before.
ROUNDS, MORE_ROUNDS = 12, 6
#: The penalty for one more language is this many times the logarithm of the number of words.
PENALTY = 1.5
#: Trigrams of a word overlap, so their likelihoods count in part.
TEMPER = 0.5
#: Stands for likelihoods and shares that have come down to nothing.
TINY = 1e-12
PARTS = 16
UNDETERMINED = "und"

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def held_out(key: Column, folds: int, fold: int = 2) -> Column:
    """Whether the key's fold is the one kept from training; a null key's is not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def trigrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(buckets, starts, ends, bounds)``: a trigram bucket for each byte of a text with a blank after each row, BUCKETS
    outside words; words as spans of those; row r has words ``bounds[r]:bounds[r + 1]``."""
    n = len(offsets) - 1
    low = arrays.lowered(raw)
    spaced = np.full(len(raw) + n + 2, 32, np.uint8)
    real = np.ones(len(spaced), bool)
    real[offsets[1:] + np.arange(n) + 1] = False
    real[[0, -1]] = False
    spaced[real] = np.where(_INSIDE[low], low, 32)
    inside = spaced != 32
    wide = spaced.astype(np.uint32)
    code = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:]
    buckets = ((code * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)
    buckets[~inside[1:-1]] = BUCKETS
    row_offsets = offsets + np.arange(n + 1)
    starts, ends, bounds = arrays.runs(inside[1:-1], row_offsets)
    return buckets, starts, ends, bounds


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts by language over a task's rows ``(lang, text)``."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang in batch.column(0).unique().to_pylist():
            texts = batch.column(1).filter(pa.compute.equal(batch.column(0), lang))
            for _, _, raw, offsets in arrays.pieces(texts):
                buckets = trigrams(raw, offsets)[0]
                own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                own += np.bincount(buckets, minlength=BUCKETS + 1)[:BUCKETS]
    for lang, own in counts.items():
        for part, some in enumerate(np.split(own, PARTS)):
            yield pa.record_batch([pa.array([lang]), pa.array([part], pa.int32()), pa.array([some], pa.list_(pa.int64()))], ["lang", "part", "counts"])


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.asarray(x.values) for x in table.column("counts"))
    return table.slice(0, 1).set_column(2, "counts", pa.array([total], pa.list_(pa.int64())))


class Model:
    """Log likelihoods of trigram buckets by language; the languages are sorted."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        table = np.array([counts[x] for x in self.languages], np.float64).reshape(len(self.languages), BUCKETS).T + SMOOTHING
        self.table = np.zeros((BUCKETS + 1, len(self.languages)), np.float32)
        if self.languages:
            self.table[:BUCKETS] = np.log(table / table.sum(axis=0)) * TEMPER

    def word_likelihoods(self, buckets: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of each word in each language, relative to the likeliest one."""
        sums = np.add.reduceat(self.table[buckets], starts, axis=0)
        return np.exp(sums - sums.max(axis=1, keepdims=True)).astype(np.float64) + TINY

    def predict(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(language number or -1, share, number of languages)`` of each row."""
        n, k = len(offsets) - 1, len(self.languages)
        best, score, size = np.full(n, -1), np.zeros(n), np.zeros(n, np.int64)
        buckets, starts, _, bounds = trigrams(raw, offsets)
        if not len(starts) or not k:
            return best, score, size
        like = self.word_likelihoods(buckets, starts)
        count = np.diff(bounds)
        rows = np.flatnonzero(count)
        of, first = np.repeat(np.arange(len(rows)), count[rows]), bounds[rows]
        n_words = count[rows].astype(np.float64)
        every = np.arange(len(rows))
        shares, kept = np.full((len(rows), k), 1 / k), np.ones((len(rows), k), bool)
        worth, chosen, answer = np.full(len(rows), -np.inf), np.ones(len(rows), np.int64), np.zeros((len(rows), k))

        def offer(likelihood: np.ndarray, m: int, own: np.ndarray) -> None:
            total = likelihood - PENALTY * m * np.log(n_words + 1)
            better = total > worth
            worth[better], chosen[better], answer[better] = total[better], m, own[better]

        alone = np.add.reduceat(np.log(like), first, axis=0)
        likeliest = alone.argmax(axis=1)
        offer(alone[every, likeliest], 1, np.eye(k)[likeliest])
        for m in range(k, 1, -1):
            for _ in range(ROUNDS if m == k else MORE_ROUNDS):
                part = like * shares[of]
                part /= part.sum(axis=1, keepdims=True)
                shares = np.add.reduceat(part, first, axis=0) / n_words[:, None]
            part = like * shares[of]
            mass = part.sum(axis=1, keepdims=True)
            offer(np.add.reduceat(np.log(mass[:, 0]), first), m, shares)
            if m == 2:
                break
            rest = np.maximum(1 - shares, TINY)
            left = np.add.reduceat(np.log(np.maximum(mass - part, TINY)), first, axis=0) - n_words[:, None] * np.log(rest)
            gone = np.where(kept, left, -np.inf).argmax(axis=1)
            kept[every, gone] = False
            shares = np.where(kept, np.maximum(shares, TINY), 0)
            shares /= shares.sum(axis=1, keepdims=True)
        best[rows], size[rows] = answer.argmax(axis=1), chosen
        score[rows] = np.clip(answer.max(axis=1), 0, 1)
        return best, score, size


def trained(df: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model from all rows whose language and text are given; the driver gets a table of fixed size for each language."""
    rows = df.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    schema = "lang string, part int, counts array<bigint>"
    summed = rows.mapInArrow(_count, schema).groupBy("lang", "part").applyInArrow(_added, schema).collect()
    counts: dict[str, np.ndarray] = {}
    for row in summed:
        own = counts.setdefault(row["lang"], np.zeros((PARTS, BUCKETS // PARTS), np.int64))
        own[row["part"]] = row["counts"]
    return Model({x: c.ravel() for x, c in counts.items()})


def identified(df: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, lang_pred, score, n_languages`` for every row: the main language, its share of the words among the languages
    chosen, and how many those are.

    Null texts and those without a letter are ``und`` with score 0, and so is everything if no language was learned. Null
    and repeated keys are rows like others; no rows, no result. Other columns don't matter, whatever their names.
    """
    held = df.sparkSession.sparkContext.broadcast(model)
    names = [*model.languages, None]
    piece = max(1 << 14, 4 * arrays.PIECE_BYTES // max(4, len(model.languages)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, raw, offsets in arrays.pieces(batch.column(1), piece):
                best, score, size = held.value.predict(raw, offsets)
                n = last - first
                yield pa.record_batch([batch.column(0).slice(first, n), batch.column(2).slice(first, n), pa.array([names[b] for b in best], pa.string()), pa.array(score), pa.array(size)], ["key", "letters", "lang_pred", "score", "n_languages"])

    kind = df.select(F.col(key)).schema[0].dataType.simpleString()
    letters = F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False)).alias("letters")
    found = df.select(F.col(key).alias("key"), F.col(text).alias("text"), letters).mapInArrow(task, f"key {kind}, letters boolean, lang_pred string, score double, n_languages bigint")
    known = F.col("letters") & F.col("lang_pred").isNotNull()
    return found.select(
        F.col("key").alias(key), F.when(known, F.col("lang_pred")).otherwise(UNDETERMINED).alias("lang_pred"), F.when(known, F.col("score")).otherwise(0.0).alias("score"),
        F.when(known, F.col("n_languages")).otherwise(0).alias("n_languages"),
    )
