"""Token counts of a byte-level BPE tokenizer by finite-state transducers.

The tokenizer is compiled once, on the driver, into two tables of fixed size that all tasks get:

* A deterministic transducer over character classes that cuts a text into the pieces that are merged separately. Its
  transitions are annotated with the cuts they emit: before the character just read, or before the one before it.
* The merges, as a hash table from pairs of tokens to their rank and result. From it a task derives the lexicon's
  transducer as it goes: one transition per piece, annotated with the number of tokens the piece emits.

A batch of texts is one long row of symbols (an end symbol after each text brings every state back to the start),
cut into chunks of equal length. All chunks are run in step, from every state at once, which gives each chunk's map
from its first to its last state; the maps are composed by a parallel prefix scan, and a second run from the now
known first states collects the cuts. So the work on one very long text is as parallel as that on many short ones.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm import arrays

# Character classes. Letters that can stand in 's 't 'm 'd 're 've 'll have classes of their own.
SPACE, BLANK, LETTER, NUMBER, OTHER, QUOTE, ONE, RE, E, VE, EL, END = range(12)
# States: what the text read so far ends in.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, ONE_SPACE, BLANKS_SPACE, BLANKS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L, SHORT_FORM = range(12)
CUT_HERE, CUT_BEFORE = 1, 2
CHUNK = 256
LETTERS = (LETTER, ONE, RE, E, VE, EL)
#: Places of a task's lexicon. A piece that loses its place to another is derived anew.
LEXICON_BITS = 20
LONG_PIECE = 64


def _fresh_state(c: int) -> int:
    """The state after a first character of class c."""
    return {SPACE: ONE_SPACE, BLANK: BLANKS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, QUOTE: QUOTED, END: START}.get(c, IN_LETTERS)


def cutter() -> tuple[np.ndarray, np.ndarray]:
    """``(next state, cuts)`` by state and class, for the pieces ``'s 't 're 've 'm 'll 'd``, a letter run, a number run
    or another run, each with one space before it, and blanks, of which the last before a piece stands alone or joins it."""
    to, cuts = np.zeros((12, 12), np.uint8), np.zeros((12, 12), np.uint8)

    def rule(state: int, classes, then: int | None, cut: int) -> None:
        for c in classes:
            to[state, c], cuts[state, c] = (_fresh_state(c) if then is None else then), cut

    every = range(12)
    solid = (*LETTERS, NUMBER, OTHER, QUOTE)
    for s in (START, SHORT_FORM, IN_LETTERS, IN_NUMBERS, IN_OTHERS, QUOTED):
        rule(s, every, None, CUT_HERE)
    rule(IN_LETTERS, LETTERS, IN_LETTERS, 0)
    rule(IN_NUMBERS, (NUMBER,), IN_NUMBERS, 0)
    for s in (IN_OTHERS, QUOTED):
        rule(s, (OTHER, QUOTE), IN_OTHERS, 0)
    rule(QUOTED, (ONE,), SHORT_FORM, 0)
    for c, s in ((RE, QUOTED_R), (VE, QUOTED_V), (EL, QUOTED_L)):
        rule(QUOTED, (c,), s, 0)
    for s, last in ((QUOTED_R, E), (QUOTED_V, E), (QUOTED_L, EL)):  # else the letter began a run of letters
        rule(s, every, None, CUT_HERE | CUT_BEFORE)
        rule(s, LETTERS, IN_LETTERS, CUT_BEFORE)
        rule(s, (last,), SHORT_FORM, 0)
    for s, cut in ((ONE_SPACE, 0), (BLANKS_SPACE, CUT_BEFORE)):
        rule(s, LETTERS, IN_LETTERS, cut)
        rule(s, (NUMBER,), IN_NUMBERS, cut)
        rule(s, (OTHER, QUOTE), IN_OTHERS, cut)
    rule(BLANKS, solid, None, CUT_HERE | CUT_BEFORE)
    for s in (ONE_SPACE, BLANKS_SPACE, BLANKS):
        rule(s, (SPACE,), BLANKS_SPACE, 0)
        rule(s, (BLANK,), BLANKS, 0)
        rule(s, (END,), START, 0)
    for s in (QUOTED_R, QUOTED_V, QUOTED_L):
        rule(s, (END,), START, CUT_BEFORE)
    return to, cuts


_classes: list[np.ndarray] = []


def character_classes() -> np.ndarray:
    """The class of every code point."""
    if not _classes:
        major = np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)).encode(), np.uint8)
        table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        table[major == ord("L")] = LETTER
        table[major == ord("N")] = NUMBER
        # the characters with the White_Space property
        table[[*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
        for c, own in ((" ", SPACE), ("'", QUOTE), ("s", ONE), ("t", ONE), ("m", ONE), ("d", ONE), ("r", RE), ("e", E), ("v", VE), ("l", EL)):
            table[ord(c)] = own
        _classes.append(table)
    return _classes[0]


def run_cutter(symbols: np.ndarray, to: np.ndarray, cuts: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Where pieces begin in a row of symbols: chunk maps, their prefix scan, then the cuts."""
    n = len(symbols)
    columns = max(1, -(-n // chunk))
    padded = np.full(columns * chunk, END, np.uint8)
    padded[:n] = symbols
    steps = np.ascontiguousarray(padded.reshape(columns, chunk).T)
    to_flat, cuts_flat, width = to.ravel(), cuts.ravel(), np.uint8(to.shape[1])

    maps = np.repeat(np.arange(len(to), dtype=np.uint8)[:, None], columns, axis=1)
    for k in range(chunk):
        maps = to_flat[maps * width + steps[k]]
        if k % 16 == 15 and len(maps) > 1 and (maps == maps[0]).all():
            maps = maps[:1]  # whatever the first state, every chunk is in one state by now
    maps = np.ascontiguousarray(np.broadcast_to(maps, (len(to), columns)))
    gap = 1
    while gap < columns:
        later = np.take_along_axis(maps[:, gap:], maps[:, :-gap], axis=0)
        maps = np.concatenate([maps[:, :gap], later], axis=1)
        gap *= 2
    state = np.append(np.uint8(START), maps[START, :-1])

    emitted = np.empty((chunk, columns), np.uint8)
    for k in range(chunk):
        at = state * width + steps[k]
        emitted[k], state = cuts_flat[at], to_flat[at]
    emitted = np.ascontiguousarray(emitted.T).ravel()[:n]
    begins = (emitted & CUT_HERE) > 0
    begins[:-1] |= (emitted[1:] & CUT_BEFORE) > 0
    return begins & (symbols != END)


@dataclass
class Merges:
    """A byte-level BPE vocabulary: a hash table from ``left << 32 | right`` to rank and merged token."""

    byte_token: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    results: np.ndarray
    specials: tuple[bytes, ...]

    NONE = np.int32(2**31 - 1)

    def look_up(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(rank, merged token)`` of each pair; rank NONE if they don't merge."""
        mask = len(self.keys) - 1
        at = (arrays.mixed(pairs.view(np.uint64)) & np.uint64(mask)).astype(np.int64)
        open_ = np.flatnonzero((self.keys[at] != pairs) & (self.keys[at] != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            open_ = open_[(self.keys[at[open_]] != pairs[open_]) & (self.keys[at[open_]] != -1)]
        hit = self.keys[at] == pairs
        return np.where(hit, self.ranks[at], self.NONE), self.results[at]

    def counts(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of tokens of each span of bytes, all spans of like length merged in step."""
        out = np.zeros(len(starts), np.int64)
        lengths = ends - starts
        for top in (4, 8, 16, LONG_PIECE):
            rows = np.flatnonzero((lengths > top // 2 if top > 4 else lengths > 0) & (lengths <= top) if top < LONG_PIECE else (lengths > 16) & (lengths <= top))
            for some in np.array_split(rows, max(1, len(rows) * top >> 18)):
                if len(some):
                    out[some] = self._in_step(raw, starts[some], lengths[some], top)
        for i in np.flatnonzero(lengths > LONG_PIECE):
            out[i] = self._one(raw[starts[i] : ends[i]])
        return out

    def _in_step(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
        columns = np.arange(width)
        at = np.minimum(starts[:, None] + columns, len(raw) - 1)
        tokens = np.where(columns < lengths[:, None], self.byte_token[raw[at]], -1).astype(np.int64)
        left, alive = lengths.copy(), np.arange(len(lengths))
        while len(alive):
            a, b = tokens[:, :-1], tokens[:, 1:]
            real = b >= 0
            ranks = np.full(a.shape, self.NONE, np.int32)
            results = np.zeros(a.shape, np.int64)
            ranks[real], results[real] = self.look_up((a[real] << 32) | b[real])
            best = ranks.argmin(axis=1)
            row = np.arange(len(tokens))
            go = ranks[row, best] != self.NONE
            row, best, alive, tokens = row[go], best[go], alive[go], tokens[go]
            if not len(alive):
                break
            joined = results[row, best]
            order = np.minimum(columns[None, :] + (columns[None, :] > best[:, None]), width - 1)
            last = columns[None, :] + (columns[None, :] > best[:, None]) >= width
            tokens = np.take_along_axis(tokens, order, axis=1)
            tokens[last] = -1
            tokens[np.arange(len(alive)), best] = joined
            left[alive] -= 1
        return left

    def _one(self, span: np.ndarray) -> int:
        """A long span: all pairs of the lowest rank at once, left to right, until none merges.

        Merging every occurrence of the lowest pair before any other is what the rules ask for: a pair made by it ranks
        later than the pair itself.
        """
        tokens = self.byte_token[span].astype(np.int64)
        while len(tokens) > 1:
            ranks, results = self.look_up((tokens[:-1] << 32) | tokens[1:])
            low = ranks.min()
            if low == self.NONE:
                break
            hit = np.flatnonzero(ranks == low)
            if tokens[hit[0]] == tokens[hit[0] + 1]:  # equal halves overlap in a run: every other one counts
                first = np.append(True, np.diff(hit) > 1)
                run = np.cumsum(first) - 1
                hit = hit[(hit - hit[first][run]) % 2 == 0]
            tokens[hit] = results[hit[0]]
            tokens = np.delete(tokens, hit + 1)
        return len(tokens)


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 bytes stand for themselves, the
    others follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def compiled(path: str) -> Merges:
    """The merges of a ``tokenizers`` file with a byte-level BPE model and its usual splitting."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec["pre_tokenizer"] or {}, spec["model"]
    if model.get("type", "BPE") not in ("BPE", 3) or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"]:
        raise ValueError(f"{path}: only byte-level BPE without a normalizer or prefix space can be compiled")
    vocab = model["vocab"]
    byte_token = np.zeros(256, np.int64)
    for c, b in byte_characters().items():
        byte_token[b] = vocab[c]
    size = 1 << (4 * len(model["merges"])).bit_length()
    keys, ranks, results = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int64)
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    wanted = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
    place = (arrays.mixed(wanted.view(np.uint64)) & np.uint64(size - 1)).astype(np.int64)
    for rank, ((a, b), key, at) in enumerate(zip(pairs, wanted.tolist(), place.tolist(), strict=True)):
        while keys[at] not in (-1, key):
            at = (at + 1) & (size - 1)
        if keys[at] == -1:
            keys[at], ranks[at], results[at] = key, rank, vocab[a + b]
    specials = tuple(t["content"].encode() for t in spec["added_tokens"])
    return Merges(byte_token, keys, ranks, results, specials)


class Counter:
    """A task's counter: the compiled tables and the part of the lexicon seen so far."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.to, self.cuts = cutter()
        self.known = np.zeros(1 << LEXICON_BITS, np.uint64)
        self.emits = np.zeros(1 << LEXICON_BITS, np.int64)

    def piece_counts(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        names = arrays.span_hashes(raw, starts, ends) | np.uint64(1)
        at = (names >> np.uint64(64 - LEXICON_BITS)).astype(np.int64)
        new = np.flatnonzero(self.known[at] != names)
        out = self.emits[at]
        if len(new):
            found, first, back = np.unique(names[new], return_index=True, return_inverse=True)
            counts = self.merges.counts(raw, starts[new[first]], ends[new[first]])
            out[new] = counts[back]
            place = at[new[first]]
            self.known[place], self.emits[place] = found, counts
        return out

    def tokens(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of tokens of each row."""
        extra = np.zeros(len(offsets) - 1, np.int64)
        whole = raw.tobytes()
        if any(s in whole for s in self.merges.specials):
            return self._with_specials(whole, offsets)
        return extra + self._plain(raw, offsets)

    def _with_specials(self, whole: bytes, offsets: np.ndarray) -> np.ndarray:
        """Each special string is one token, and the texts beside it are cut apart from each other."""
        parts, of = [], []
        out = np.zeros(len(offsets) - 1, np.int64)
        for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            own = [whole[a:b]]
            for s in self.merges.specials:
                split = [x.split(s) for x in own]
                out[row] += sum(len(x) - 1 for x in split)
                own = [y for x in split for y in x]
            parts += own
            of += [row] * len(own)
        ends = np.cumsum([0, *map(len, parts)])
        np.add.at(out, of, self._plain(np.frombuffer(b"".join(parts), np.uint8), ends))
        return out

    def _plain(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        leads = np.flatnonzero((raw & 0xC0) != 0x80)
        chars = np.searchsorted(leads, offsets)
        symbols = np.full(len(codes) + n, END, np.uint8)
        real = np.ones(len(symbols), bool)
        real[chars[1:] + np.arange(n)] = False
        symbols[real] = character_classes()[codes]
        begins = run_cutter(symbols, self.to, self.cuts)[real]
        starts = leads[np.flatnonzero(begins)]
        ends = np.append(starts[1:], len(raw))
        counts = self.piece_counts(raw, starts, ends)
        return arrays.row_sums(counts, np.searchsorted(starts, offsets))


def token_counts(df: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", limit: int = 512) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` for every row of ``df``.

    ``tokenizer`` is the path of its file on the driver. Null text counts as empty: no bytes, no tokens. Null and
    repeated keys are rows like others; no rows, no result. Other columns don't matter, whatever their names.
    """
    merges = df.sparkSession.sparkContext.broadcast(compiled(tokenizer))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(merges.value)
        for batch in batches:
            for first, last, raw, offsets in arrays.pieces(batch.column(1)):
                tokens = counter.tokens(raw, offsets)
                yield pa.record_batch([batch.column(0).slice(first, last - first), pa.array(np.diff(offsets)), pa.array(tokens)], ["key", "n_bytes", "n_tokens"])

    kind = df.select(F.col(key)).schema[0].dataType.simpleString()
    counted = df.select(F.col(key), F.col(text)).mapInArrow(task, f"key {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
