"""Conversations as training texts, with the span of every turn and a loss mask, for templates known only by what they render.

A template is a black box: a list of (role, text) goes in, a text comes out. Successive prefixes of a conversation are rendered and
consecutive outputs compared: what an output adds to the one before is the turn's span. An output that does not begin with the one before
shows a template that rewrites history (one that moves the system turn, or drops earlier reasoning): the conversation is flagged
with the first turn that did so, and its spans are those of the last output as far as they can be told. Where a turn's own text lies
within its span is found in the same way, by rendering the prefix with a probe in place of the last text.

Prefixes cost the square of their length, so a conversation is rendered in segments of ``SEGMENT`` turns. A segment starts from the
``CONTEXT`` turns before it, whose own output is cut off. That a segment so rendered is what the whole conversation would hold is tested, not
assumed: the first turn of a segment is rendered after one and after ``CONTEXT`` earlier turns, and where the two differ the conversation is
flagged as well. A conversation of any length is thus many small rows; only its hashes run over it in order, from a running state.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm import turns

SEGMENT, CONTEXT = 32, 2
#: About how many characters of output a task holds before it hands them on.
HELD = 1 << 20
#: The role whose texts are learned.
LEARNED = "assistant"
#: What may stand in for a text, a character that templates neither trim nor escape; the first one that the role doesn't hold.
PROBES = [chr(0xE000 + i) for i in range(64)]

Turn = tuple[str, str]


class Template(Protocol):
    """What a conversation becomes. ``read`` is the way back from the output of ``render`` (or of a part between turns)."""

    def render(self, conversation: list[Turn]) -> str: ...

    def read(self, output: str) -> list[Turn]: ...

    def unescape(self, text: str) -> str: ...


class Instruct:
    """``[INST] text [/INST]`` for the user, ``text</s>`` for the assistant, ``[ROLE]name[TEXT]text[/ROLE]`` for any other role.

    Every turn begins with ``<s>``. Control strings inside roles and texts get a backslash after their first character and backslashes are
    doubled, which no output of ``escape`` can be mistaken for: a backslash stands before another one, or behind a control
    string's first character.
    """

    controls = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[TEXT]", "[/ROLE]")
    _special = re.compile("|".join(re.escape(c) for c in ("\\", *controls)))
    _quoted = re.compile(r"\\(\\?)")
    _turn = re.compile(r"<s>(?:\[INST\] (?P<user>.*?) \[/INST\]|\[ROLE\](?P<role>.*?)\[TEXT\](?P<other>.*?)\[/ROLE\]|(?P<assistant>.*?)</s>)", re.DOTALL)

    def escape(self, text: str) -> str:
        return self._special.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)

    def unescape(self, text: str) -> str:
        return self._quoted.sub(r"\1", text)

    def render(self, conversation: list[Turn]) -> str:
        out = []
        for role, text in conversation:
            body = self.escape(text)
            out.append(f"<s>[INST] {body} [/INST]" if role == "user" else f"<s>{body}</s>" if role == "assistant" else f"<s>[ROLE]{self.escape(role)}[TEXT]{body}[/ROLE]")
        return "".join(out)

    def read(self, output: str) -> list[Turn]:
        found, at = [], 0
        while at < len(output):
            m = self._turn.match(output, at)
            if not m:
                raise ValueError(f"no turn at character {at}")
            role = self.unescape(m["role"]) if m.lastgroup == "other" else m.lastgroup
            found.append((role, self.unescape(m[m.lastgroup])))
            at = m.end()
        return found


def _common(a: str, b: str) -> int:
    """How many first characters agree, by halving."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


def spans(template: Template, conversation: list[Turn], skip: int = 0) -> tuple[str, list[tuple[int, int, int, int]], int | None]:
    """The output from turn ``skip`` on, for each of its turns (start, end, start and end of its own text), and the first turn that rewrote earlier output.

    Places count code points from the output's beginning. A template that rewrites leaves each turn what its output adds to the longest
    common beginning; those places may then be off, which is why the turn is told.
    """
    before, rewrote, found = template.render(conversation[:skip]) if skip else "", None, []
    base = len(before)
    for k in range(skip, len(conversation)):
        role, text = conversation[k]
        now = template.render(conversation[: k + 1])
        start = len(before)
        if not now.startswith(before):
            start = _common(before, now)
            rewrote = k if rewrote is None else rewrote
        probe = next((c for c in PROBES if c not in role), PROBES[0])
        probed = template.render([*conversation[:k], (role, probe)])
        at = probed.find(probe, min(start, len(probed)))
        if at >= 0 and now.startswith(probed[:at]) and now.endswith(probed[at + 1 :]):
            own = at, len(now) - (len(probed) - at - 1)
        else:  # the frame hangs on the text: what it shares with the empty turn is frame, the rest is text
            bare = template.render([*conversation[:k], (role, "")])
            head = _common(bare, now)
            own = head, len(now) - _common(bare[head:][::-1], now[head:][::-1])
        found.append((start - base, len(now) - base, own[0] - base, own[1] - base))
        before = now
    return before[base:], found, rewrote


_PLACES = ("start", "stop", "text_start", "text_stop")
SPANS = "array<struct<turn: bigint, role: string, start: bigint, stop: bigint, text_start: bigint, text_stop: bigint, learned: boolean>>"


def _rendered(template: Template, learned: str) -> Callable:
    kinds = (pa.int64(), pa.string(), pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), *((c, pa.int64()) for c in _PLACES), ("learned", pa.bool_())])), pa.int64())

    def one(segment: int, own: list[dict]) -> tuple:
        conversation = [(t["role"], t["text"]) for t in own]
        skip = sum(t["place"] <= segment * SEGMENT for t in own)
        text, found, rewrote = spans(template, conversation, skip)
        if rewrote is None and skip > 1:
            near, after = (template.render(conversation[skip - 1 : k]) for k in (skip, skip + 1))
            if after[len(near) :] != text[: found[0][1]]:
                rewrote = skip
        mask = [{"turn": t["place"], "role": t["role"], **dict(zip(_PLACES, s, strict=True)), "learned": t["role"] == learned} for t, s in zip(own[skip:], found, strict=True)]
        return segment, text, mask, None if rewrote is None else own[rewrote]["place"]

    def batch(convs: list[pa.Array], rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(convs), *columns], names=["conv_id", "segment", "text", "turns", "rewritten_at"])

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            convs, rows, held = [], [], 0
            for i in range(b.num_rows):  # a segment at a time, as texts may be long
                convs.append(b.column("conv_id").slice(i, 1))
                rows.append(one(b.column("segment")[i].as_py(), b.column("turns")[i].as_py()))
                held += len(rows[-1][1])
                if held > HELD:
                    yield batch(convs, rows)
                    convs, rows, held = [], [], 0
            if rows:
                yield batch(convs, rows)

    return render


def formatted(conversations: DataFrame, template: Template, learned: str = LEARNED) -> DataFrame:
    """One row for each segment of a conversation: ``conv_id, segment, text, turns, rewritten_at``.

    The texts of a conversation's segments, in order, make its whole text; ``turns`` has for each turn its place, its span in the segment's
    text, the span of its own words and whether they are learned (the loss mask); ``rewritten_at`` is the place of the first turn whose
    rendering changed earlier output or hangs on turns further back than the one before, null if none did.
    Turns are ordered by ``turn``, null first, then by a digest of role and text; repeated rows are turns of their own; null roles and texts
    are empty; rows without ``conv_id`` make a conversation of their own; other columns are ignored; no rows, no result.
    """
    own = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = turns.placed(own.withColumn("digest", turns.digest()), "format-turns").select("conv_id", "place", "role", "text")
    at = F.floor((F.col("place") - 1) / SEGMENT)
    # the last turns of a segment come again as context of the next one
    ahead = F.when((F.col("place") - 1) % SEGMENT >= SEGMENT - CONTEXT, 1).otherwise(0)
    rows = own.withColumn("segment", F.explode(F.sequence(at, at + ahead)))
    parts = rows.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))  # SEGMENT + CONTEXT at most
    parts = parts.where(F.exists("turns", lambda t: t["place"] > F.col("segment") * SEGMENT))
    kind = conversations.schema["conv_id"].dataType.simpleString()
    return parts.select("conv_id", "segment", "turns").mapInArrow(_rendered(template, learned), f"conv_id {kind}, segment bigint, text string, turns {SPANS}, rewritten_at bigint")


def _read_back(template: Template) -> Callable:
    """Digests of conversations from their texts and masks, over rows sorted by conversation and segment; the state of one goes on from batch to batch."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        for b in batches:
            out = []
            for i in range(b.num_rows):
                conv, segment = b.column("conv_id")[i].as_py(), b.column("segment")[i].as_py()
                if segment == 0:
                    out += [_closed(state)] if state else []
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, None]
                text = b.column("text")[i].as_py()
                for role, own in template.read(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{own}\n".encode(errors="surrogatepass"))
                for t in b.column("turns")[i].as_py():
                    if t["learned"]:
                        own = template.unescape(text[t["text_start"] : t["text_stop"]])
                        state[3] += len(own)
                        state[4].update(own.encode(errors="surrogatepass"))
                state[5] += len(text)
                rewritten = b.column("rewritten_at")[i].as_py()
                state[6] = rewritten if state[6] is None else state[6]
            yield _as_batch(b.column("conv_id").type, out)
        if state:
            yield _as_batch(b.column("conv_id").type, [_closed(state)])

    return read


def _closed(state: list) -> tuple:
    return state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5], state[6]


def _as_batch(conv: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    kinds = (conv, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    columns = zip(*rows, strict=True) if rows else ((),) * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=DIGESTS)


DIGESTS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewritten_at"]


def read_back(segments: DataFrame, template: Template) -> DataFrame:
    """What a reader of the formatted texts finds of each conversation: ``DIGESTS``, from texts and masks alone.

    ``turns_sha256`` hashes role, newline, text, newline of every turn; ``loss_chars`` and ``loss_sha256`` are those of all learned text, unescaped.
    """
    kind = segments.schema["conv_id"].dataType.simpleString()
    rows = segments.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return rows.mapInArrow(_read_back(template), f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, rewritten_at bigint")
