"""Words and word shingles of Arrow string batches as numpy arrays.

Whole batches are worked on at once: no Python loop over words. A word is a maximal run of bytes other than
space and ``\\t``..``\\r``; those are all below 0x80, so bytes of longer UTF-8 characters never split a word.
Hashes are 64 bits, made from fixed random numbers, so that every worker gets the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text is handled in pieces of about this many bytes (one longer text is a piece of its own).
PIECE_BYTES = 1 << 20

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = _RANDOM.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """Each 64-bit value through a one-to-one mixing function."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, PIECE_BYTES + 1)
        for name, step in (("up", _STEP), ("down", _STEP_BACK)):
            all_steps = np.full(size, step, np.uint64)
            all_steps[0] = 1
            _powers[name] = np.cumprod(all_steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)``: row r's UTF-8 text is ``bytes[offsets[r]:offsets[r + 1]]``; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(texts: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, row after the last, bytes, offsets)`` of stretches of rows of about ``most`` bytes."""
    raw, offsets = text_bytes(texts)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        last = min(last, n)
        yield first, last, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[raw]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, bounds)`` of the maximal runs of True in each row; row r has runs ``bounds[r]:bounds[r + 1]``."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | cut[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:n]
    at = np.flatnonzero(starts)
    return at, np.flatnonzero(ends) + 1, np.searchsorted(at, offsets)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    up, down = powers(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64, out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, bounds)`` of the words of each row, in order."""
    starts, ends, bounds = runs(~SPACES[raw], offsets)
    return span_hashes(raw, starts, ends), bounds


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, bounds)`` of every run of ``width`` words of a row; of a row with fewer words, one run of them all."""
    n = len(hashes)
    count = np.diff(bounds)
    full = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        full += hashes[k : n - width + 1 + k] * _PLACE[k] if n >= width else 0
    whole = np.ones(n, bool)
    for k in range(1, width):  # a run that starts so near a row's end would reach into the next row
        near = bounds[1:] - k
        whole[near[near >= bounds[:-1]]] = False
    out = np.zeros(n, np.uint64)
    out[: len(full)] = full
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        for k in range(width - 1):
            has = short[count[short] > k]
            out[bounds[has]] = (out[bounds[has]] if k else 0) + hashes[bounds[has] + k] * _PLACE[k + 8]
        out[bounds[short]] += count[short].astype(np.uint64)
        whole[bounds[short]] = True
    ends = np.concatenate([[0], np.cumsum(whole)]).astype(np.int64)
    return mixed(out[whole]), ends[bounds]


def sets(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order."""
    out = hashes.copy()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        out[a:b].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[bounds[:-1][bounds[:-1] < len(out)]] = True
    upto = np.concatenate([[0], np.cumsum(fresh)]).astype(np.int64)
    return out[fresh], upto[bounds]


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of each row's values, modulo 2**64 for unsigned ones; 0 for an empty row."""
    upto = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return upto[bounds[1:]] - upto[bounds[:-1]]
