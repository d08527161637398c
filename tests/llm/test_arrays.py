import numpy as np
import pyarrow as pa

from chatloom.llm import arrays

TEXTS = ["", None, "a", "  two  words\n", "x y z u v w x y z u v w", "Ä b c", "one two three four five"]


def test_words_and_shingles_against_plain_python():
    seen = {}
    for first, last, raw, offsets in arrays.pieces(pa.array(TEXTS), 7):
        hashes, bounds = arrays.words(raw, offsets)
        shingles, ends = arrays.shingles(hashes, bounds)
        for r in range(last - first):
            words = (TEXTS[first + r] or "").encode().split()
            assert bounds[r + 1] - bounds[r] == len(words)
            for w, h in zip(words, hashes[bounds[r] : bounds[r + 1]], strict=True):
                assert seen.setdefault(w, h) == h
            runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] if words else []
            own = shingles[ends[r] : ends[r + 1]]
            assert len(own) == len(runs)
            for x, h in zip(runs, own, strict=True):
                assert seen.setdefault(x, h) == h
    assert len(set(map(int, seen.values()))) == len(seen)


def test_slices_and_sums():
    texts = pa.array(["skip", "b c", None, "d"]).slice(1)
    _, _, raw, offsets = next(arrays.pieces(texts))
    assert raw.tobytes() == b"b cd" and offsets.tolist() == [0, 3, 3, 4]
    assert arrays.row_sums(np.array([1, 2, 3]), np.array([0, 2, 2, 3])).tolist() == [3, 0, 3]
