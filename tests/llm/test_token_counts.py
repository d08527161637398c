import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chatloom.llm import arrays, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = token_counts.Counter(token_counts.compiled(PATH))
EDGES = [
    "", " ", "  a", "it's they're we'll I'd 've 'r 'rx 'l 'll 'v", "''s", "x''s 's \n's", "a\n\n b\t c  ", "\n", "a<|endoftext|> b", "<|endoftext|><|endoftext|>", "1234 5 x1y2", "🙂🙂 ok", "=" * 300, "a" * 1000,
    " " * 200 + "x", "'re're'rE 'RE", "\x1c\x1d a\x85b", "é" * 90, "abc'", "abc'v", "\r\n\r\nfoo", "½ ² ٣ Ⅷ", "漢字かな 漢字", "a" * 63 + " " + "b" * 65, "ab" * 400,
]


def counted(texts, piece=1 << 20):
    return [n for _, _, raw, offsets in arrays.pieces(pa.array(texts, pa.string()), piece) for n in COUNTER.tokens(raw, offsets).tolist()]


def library(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_edges():
    assert counted(EDGES + [None]) == library(EDGES + [None])
    assert counted(EDGES, 16) == library(EDGES)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab srtevmld'' \n\t1é½—🙂=") | st.characters(codec="utf-8"), max_size=60), max_size=6))
def test_any_text(texts):
    assert counted(texts) == library(texts)


def test_a_long_text_is_chunked():
    text = "They'll say it's 5,000 words.  " * 4000
    assert counted([text]) == library([text])


def test_table(spark, awkward, nothing):
    rows = token_counts.token_counts(awkward, PATH).collect()
    given_rows = awkward.collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), n, n > 512) for r, n in zip(given_rows, library([r.text for r in given_rows]), strict=True))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == want
    assert token_counts.token_counts(nothing, PATH).count() == 0


def test_other_models_are_refused(tmp_path):
    with pytest.raises(ValueError):
        token_counts.compiled(public_tokenizers.path("word_bpe_49k.json"))
