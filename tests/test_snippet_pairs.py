"""Equal questions and texts are scored once, however many pairs name them."""

from chatloom.operators import snippet


def test_distinct_pairs_are_scored_once(spark):
    texts = ["1/2/2024, 9:05 - Ann: the budget meeting\n1/2/2024, 9:06 - Bob: lunch", "no stamps\nbudget", None]
    asked = ["budget meeting", "lunch", None]
    rows = [(i, asked[i % 3], texts[i // 3 % 3]) for i in range(180)]
    pairs = spark.createDataFrame(rows, "k int, question string, text string").repartition(5)
    named, questions, cut = snippet._named(pairs, ["k"], "question", "text", None)
    assert snippet._scored(named, questions, cut).count() == 6
    by_ids = pairs.select("k", snippet.question_id(pairs["question"]).alias("question_id"), snippet.text_id(pairs["text"]).alias("text_id"))
    for how in (snippet.scored_messages, snippet.snippets):
        whole, named = how(pairs, ["k"]).collect(), how(by_ids, ["k"], parts=(pairs, pairs)).collect()
        assert sorted(map(repr, whole)) == sorted(map(repr, named))
    found = {r.k: (r.focused_snippet, r.no_strong_passage) for r in snippet.snippets(pairs, ["k"]).collect()}
    assert len(found) == 180 and found[0] == ("1/2/2024, 9:05 - Ann: the budget meeting", False) and found[2] == found[8] == (None, True) and found[7] == (None, True)
    assert all(found[k] == found[k % 9] for k in found)
