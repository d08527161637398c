import random

import pytest

CLASHING = ("dropped", "repeated", "places", "k", "_words", "_lines", "_hashes", "own", "class", "bucket", "times")
SYLLABLES = "an er in th on re ti es or ou nd en".split()


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls in any column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
    base = [word() for _ in range(120)]
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (None, "some words of a text without an id " * 3, "de", "b"), (5, "one", "fr", "b"), (6, "one two three four", "fr", "b"), (7, "ONE two Three four", "fr", None)]
    rows += [(8, " ".join(base), "en", "a"), (8, " ".join(base), "en", "a"), (9, " ".join(base), "en", "c")]
    for i in range(30):
        words = list(base)
        for _ in range(i // 6):
            words[rng.randrange(120)] = word()
        rows.append((100 + i, " ".join(words), "en", "c"))
    rows.append((200, " ".join(word() for _ in range(30000)), "es", "a"))
    rows += [(300 + i, "\n".join(" ".join(word() for _ in range(12)) for _ in range(6)), "es", "b") for i in range(30)]
    rows += [(400, "über Größe ½ — 漢字 🙂 É" * 5, "de", "é"), (401, "1234 5678 !!!", "en", "\U0001f600")]
    wide = [(*r, len(r[1] or ""), "x", 1, 2, *"abcdefghijk") for r in rows]
    return spark.createDataFrame(wide, "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, size int, row int, " + ", ".join(f"{n} string" for n in CLASHING)).repartition(5)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")
