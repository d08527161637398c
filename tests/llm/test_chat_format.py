"""Chat formatting: exact round trips, spans and masks, and templates that rewrite history."""

import hashlib
import random
from pathlib import Path

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chatloom.llm import chat_format as op
from chatloom.llm import registry

SCHEMA = "conv_id bigint, turn bigint, role string, text string, place string, segment int, digest string, turns int"
MARKS = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[TEXT]", "[/ROLE]", "\\", "[", "]", "<", "/", "s>", "INST]", " ", "é", "🙂", "\n", "a", *op.PROBES[:2]]
spoken = st.lists(st.sampled_from(MARKS), max_size=8).map("".join)


class Merged:
    """Moves the system turn into the first user turn."""

    def render(self, conversation):
        system = "".join(t for r, t in conversation if r == "system")
        out = []
        for r, t in conversation:
            if r == "user":
                out.append(f"<u>{system}{t}")
                system = ""
            elif r == "assistant":
                out.append(f"<a>{t}<e>")
        return "".join(out) or f"<sys>{system}"


class Forgetful:
    """Drops the reasoning of all assistant turns but the last one."""

    def render(self, conversation):
        out = []
        for i, (r, t) in enumerate(conversation):
            out.append(f"<{r}>{t if i == len(conversation) - 1 else t.split('|')[-1]}")
        return "".join(out)


class Trimmed:
    """Strips texts and ends every turn with a mark; nothing earlier changes."""

    def render(self, conversation):
        return "".join(f"<{r}>\n{t.strip()}<end>\n" for r, t in conversation)


class Distant:
    """Each turn tells the length of the turn two before it."""

    def render(self, conversation):
        return "".join(f"<{r}{len(conversation[i - 2][1]) if i > 1 else 0}>{t}" for i, (r, t) in enumerate(conversation))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), spoken), spoken), max_size=5))
def test_round_trip_and_spans(conversation):
    template = op.Instruct()
    whole = template.render(conversation)
    assert template.read(whole) == conversation
    text, found, rewrote = op.spans(template, conversation)
    assert text == whole and rewrote is None
    end = 0
    for (_, own), (start, stop, a, b) in zip(conversation, found, strict=True):
        assert start == end and start <= a <= b <= stop
        assert template.unescape(whole[a:b]) == own
        end = stop
    assert end == len(whole)


def test_templates_that_rewrite_history():
    talk = [("system", "be kind"), ("user", "hi"), ("assistant", "why|yes"), ("user", "and"), ("assistant", "so|no")]
    assert op.spans(Merged(), talk)[2] == 1 and op.spans(Merged(), talk[1:])[2] is None
    assert op.spans(Forgetful(), talk)[2] == 3
    assert op.spans(Forgetful(), [(r, t.replace("|", "")) for r, t in talk])[2] is None
    text, found, rewrote = op.spans(Trimmed(), [("user", "  a  "), ("assistant", " b c\n"), ("user", "")])
    assert rewrote is None and [text[a:b] for _, _, a, b in found] == ["a", "b c", ""]


def plain(rows, template):
    own = {}
    for conv, turn, role, text in rows:
        own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in own.items():
        turns.sort(key=lambda t: (t[:2], hashlib.sha256(f"{len(t[2])}:{t[2]}{t[3]}".encode()).hexdigest()))
        talk = [t[2:] for t in turns]
        said = "".join(t for r, t in talk if r == "assistant")
        out.append((conv, len(talk), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in talk).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(template.render(talk)), None))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool]", None]), "".join(rng.choices(MARKS, k=rng.randrange(12)))) for c in range(60) for t in range(rng.choice([1, 2, 8, 31, 32, 33, 65]))]
    rows += [(None, 1, "user", "of nobody"), (None, 2, "assistant", "to no one"), (7, None, "assistant", None), (7, None, "", "x"), (9, 1, "user", "same"), (9, 1, "user", "same"), (99, 3, "assistant", "long " * 100000)]
    return rows


def test_against_one_render(spark, rows):
    """Segments of long conversations come out as the whole conversation would in one rendering."""
    template = op.Instruct()
    segments = op.formatted(table(spark, rows), template)
    assert sorted(map(tuple, op.read_back(segments, template).collect()), key=repr) == plain(rows, template)
    got = {}
    for r in segments.orderBy("conv_id", "segment").collect():
        got.setdefault(r.conv_id, []).append(r)
    assert max(map(len, got.values())) == 3
    for parts in got.values():
        assert [t.turn for p in parts for t in p.turns] == list(range(1, sum(len(p.turns) for p in parts) + 1))
        assert all(t.learned == (t.role == "assistant") for p in parts for t in p.turns)


def test_rewriting_is_told(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"think {c}|say {t}" if c == 1 else f"say {t}") for c in (1, 2) for t in range(70)]
    told = {(r.conv_id, r.segment): r.rewritten_at for r in op.formatted(table(spark, rows), Forgetful()).collect()}
    assert told == {(1, 0): 2, (1, 1): 33, (1, 2): 65, (2, 0): None, (2, 1): None, (2, 2): None}
    rows = [(1, t, "user", "x" * t) for t in range(40)]
    told = {r.segment: r.rewritten_at for r in op.formatted(table(spark, rows), Distant()).collect()}
    assert told == {0: None, 1: 33}


def test_no_rows(spark):
    template = op.Instruct()
    assert op.read_back(op.formatted(table(spark, []), template), template).collect() == []


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = registry.QUERIES["op11_chat_format"](spark, sf)
    want = con.sql(registry.ORACLE_SQL["op11_chat_format"])
    assert df.columns == want.columns
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())
