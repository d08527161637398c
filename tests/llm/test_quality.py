import collections
import re

from chatloom.llm import quality


def figures(text):
    text = text or ""
    words, seen, dup = re.findall(r"[^\x20\x09-\x0D]+", text), set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    runs = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {p for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_figures_against_plain_python(spark, awkward):
    extra = spark.createDataFrame([(900, "a b c d e a b c d e f a a a a a a a"), (901, "x\nx\n \n \nx # & <>"), (902, "a a a a a a")], "doc_id bigint, text string")
    docs = awkward.select("doc_id", "text").union(extra)
    rows = quality.judged(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == figures(r.text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_estimate_finds_the_bad_kind():
    patterns = {(1, 1, 1): 900, (-1, 1, 1): 5, (1, -1, -1): 60, (1, -1, 0): 30, (0, 1, 1): 5}
    trust = quality.estimate(patterns, 3)
    assert trust.log_odds((1, 1, 1)) > 0 > trust.log_odds((1, -1, -1))
    assert trust.on_bad[1] > 0.8 > 0.2 > 1 - trust.good


def test_estimates_are_held_by_the_prior_alone():
    never_wrong = quality.estimate({(1, 1): 10**9}, 2)
    assert all(0.9998 < x < 1 for x in never_wrong.on_good) and never_wrong.log_odds((1, 1)) > 0
    mostly_bad = quality.estimate({(1, 1, 1): 1000, (-1, -1, 1): 6000, (1, -1, -1): 2000, (-1, 0, -1): 1000}, 3)
    assert mostly_bad.log_odds((1, 1, 1)) > 0 > max(mostly_bad.log_odds(p) for p in [(-1, -1, 1), (1, -1, -1), (-1, 0, -1)])
    assert mostly_bad.good < 0.2 and all(x < 0.8 for x in mostly_bad.on_bad[2:])
    small, large = (quality.estimate({(1, 1, 1): 900 * n, (-1, 1, 1): 5 * n, (1, -1, -1): 60 * n, (1, -1, 0): 30 * n}, 3) for n in (100, 100000))
    assert all(abs(a - b) < 0.01 for a, b in zip(small.on_good + small.on_bad, large.on_good + large.on_bad, strict=True))
    assert quality.estimate({}, 2).on_bad == (0.3, 0.3)


def test_empty_table_and_pipeline_form(awkward, nothing):
    assert quality.judged(nothing).count() == 0
    kept = quality.kept_documents(awkward)
    assert kept.columns == awkward.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} & {1, 2, 3, 5, 6} == set()
    assert kept.where("doc_id = 300").count() == 1
