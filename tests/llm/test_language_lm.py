import collections
import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chatloom.llm import arrays, language, lm_scores

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held", language.held_out(F.col("doc_id"), 4))
    model = language.trained(docs.where("NOT held"))
    rows = language.identified(docs, model).join(docs.select("doc_id", "lang", "held"), "doc_id").where("held").collect()
    assert len(rows) > 200 and sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_mixtures_and_odd_texts(spark, awkward, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.trained(docs)
    one = {r.lang: r.text for r in docs.groupBy("lang").agg(F.max_by("text", F.length("text")).alias("text")).collect()}
    both = one["en"][:1500] + "\n" + one["fr"][:600]
    rows = [(1, both), (2, None), (3, "123 !!"), (4, one["de"]), (5, "— ½ 🙂")]
    got = {r.doc_id: r for r in language.identified(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    assert got[1].lang_pred == "en" and got[1].n_languages == 2 and 0.5 < got[1].score < 0.9
    assert got[4].lang_pred == "de" and got[4].n_languages == 1
    assert {got[k].lang_pred for k in (2, 3, 5)} == {"und"} and got[2].score == 0
    assert language.identified(awkward, model).count() == awkward.count()
    assert language.identified(nothing, language.trained(nothing)).count() == 0
    assert {r.lang_pred for r in language.identified(awkward, language.trained(nothing)).collect()} == {"und"}


def test_a_text_in_more_than_four_languages(spark):
    own = {"a": "abca baca cab", "b": "defd feed def", "c": "ghig hiig ghi", "d": "jklj klkj jkl", "e": "mnom nomo mno", "f": "pqrp qrqp pqr"}
    model = language.trained(spark.createDataFrame([(k, v + (" " + v) * 50) for k, v in own.items()], "lang string, text string"))
    rows = [(n, " ".join((v + " ") * 30 for v in list(own.values())[:n])) for n in range(1, 7)]
    got = {r.doc_id: r for r in language.identified(spark.createDataFrame(rows, "doc_id bigint, text string"), model).collect()}
    assert {n: r.n_languages for n, r in got.items()} == {n: n for n in range(1, 7)}
    assert all(abs(r.score - 1 / n) < 0.01 for n, r in got.items())


def plain_trigrams(word):
    spaced = b" " + word + b" "
    codes = (int.from_bytes(spaced[i : i + 3], "big") for i in range(len(word)))
    return [(c * 2654435761 & 0xFFFFFFFF) >> 32 - language.BUCKET_BITS for c in codes]


def plain_words(text):
    return re.findall(rb"[a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))


def plain_shares(like, own, rounds=300):
    """Shares of the languages ``own`` and the log likelihood, by expectation-maximisation word by word."""
    shares = dict.fromkeys(own, 1 / len(own))
    for _ in range(rounds):
        sums = dict.fromkeys(own, 0.0)
        for word in like:
            mass = sum(shares[x] * word[x] for x in own)
            for x in own:
                sums[x] += shares[x] * word[x] / mass
        shares = {x: v / len(like) for x, v in sums.items()}
    return shares, sum(math.log(sum(shares[x] * word[x] for x in own)) for word in like)


def test_language_sets_against_every_set_in_plain_python(spark):
    """Tables, words, likelihoods and shares anew, and every set of the learned languages instead of one falling row of sets."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("held", language.held_out(F.col("doc_id"), 4))
    learned = docs.where("NOT held AND lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").collect()
    counts = collections.defaultdict(collections.Counter)
    for r in learned:
        for word in plain_words(r.text):
            counts[r.lang].update(plain_trigrams(word))
    totals = {x: sum(c.values()) + language.SMOOTHING * language.BUCKETS for x, c in counts.items()}

    def plain(text):
        like = []
        for word in plain_words(text):
            logs = {x: language.TEMPER * sum(math.log((counts[x][b] + language.SMOOTHING) / totals[x]) for b in plain_trigrams(word)) for x in counts}
            like.append({x: math.exp(v - max(logs.values())) + language.TINY for x, v in logs.items()})
        tried = []
        for m in range(1, len(counts) + 1):
            for own in itertools.combinations(sorted(counts), m):
                shares, total = plain_shares(like, own)
                tried.append((total - language.PENALTY * m * math.log(len(like) + 1), m, shares))
        return max(tried, key=lambda x: x[0]), sorted(x[0] for x in tried)[-2]

    held = {r.doc_id: r for r in docs.where("held AND length(text) > 40 AND length(text) < 1200").collect()}
    by_lang = collections.defaultdict(list)
    for r in sorted(held.values(), key=lambda r: r.doc_id):
        by_lang[r.lang].append(" ".join(r.text.split()[:60]))
    texts = [some[i] for some in by_lang.values() for i in range(min(4, len(some)))]
    for (a, x), (b, y) in itertools.permutations(by_lang.items(), 2):
        texts += [f"{' '.join(x[0].split()[:40])} {' '.join(y[1].split()[:n])}" for n in (3, 12, 35)]
    texts.append(" ".join(" ".join(x[2].split()[:25]) for x in by_lang.values()))
    got = language.identified(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), language.trained(docs.where("NOT held")))
    clear = several = 0
    for r in got.collect():
        (worth, m, shares), second = plain(texts[r.doc_id])
        ranked = sorted(shares.values())
        if worth - second < 0.05 or len(ranked) > 1 and ranked[-1] - ranked[-2] < 0.02:
            continue
        clear, several = clear + 1, several + (m > 1)
        assert (r.lang_pred, r.n_languages) == (max(shares, key=shares.get), m)
        assert abs(r.score - max(shares.values())) < 0.02
    assert clear > 0.8 * len(texts) and several > 10


def test_chosen_set_decides_the_language():
    """A language that leads while all take part, but is not needed once its share is given to those left, is not the answer."""
    rng = np.random.default_rng(5)
    changed = 0
    for _ in range(300):
        model = language.Model({x: np.zeros(language.BUCKETS, np.int64) for x in "abcd"})
        model.table[: language.BUCKETS] = rng.normal(0, 0.6, (language.BUCKETS, 4))
        raw = np.frombuffer(b" ".join(rng.bytes(2).hex().translate(str.maketrans("0123456789", "ghijklmnop")).encode() for _ in range(60)), np.uint8)
        best, score, size = model.predict(raw, np.array([0, len(raw)]))
        buckets, starts, _, _ = language.trigrams(raw, np.array([0, len(raw)]))
        like, shares = model.word_likelihoods(buckets, starts), np.full(4, 0.25)
        for _ in range(language.ROUNDS):
            shares = (like * shares / (like @ shares)[:, None]).mean(axis=0)
        assert 1 <= size[0] <= 4 and 1 / size[0] - 1e-9 <= score[0] <= 1
        changed += best[0] != shares.argmax()
    assert changed > 0


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def test_lm_base_score_against_plain_python(awkward, nothing):
    held = language.held_out(F.col("doc_id"), 7)
    model, counts = lm_scores.trained(awkward.where(~held))
    rows = lm_scores.scored(awkward, model, counts, keep=("doc_id", "text")).collect()
    c = collections.Counter()
    for r in awkward.where(~held).collect():
        c.update(tokens(r.text))
    n, v = sum(c.values()), len(c)
    assert len(rows) == awkward.count()
    for r in rows:
        own = tokens(r.text)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(c[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9, abs_tol=1e-6)
        assert r.score < 0
    assert lm_scores.scored(nothing, model, counts).count() == 0
    empty, none = lm_scores.trained(nothing)
    assert lm_scores.scored(awkward, empty, none).where("n_known <> 0 OR train_tokens <> 0").count() == 0


def plain_weight(n, seen, share, normaliser):
    """The root of the penalised likelihood's derivative, by halving."""
    lo, hi = -60.0, 60.0
    for _ in range(100):
        w = (lo + hi) / 2
        lo, hi = (w, hi) if n - seen * share * math.exp(w) / normaliser - lm_scores.PENALTY * w > 0 else (lo, w)
    return lo


def test_lm_score_against_plain_python(awkward):
    """Everything but the class softmax anew, token by token: pairs, weights by halving, normalisers, sums."""
    model, table = lm_scores.trained(awkward)
    raw = {r.text or "" for r in awkward.collect()}
    place = {}  # text -> (token, bucket before, two before, class) by the model's own hashing
    for t in raw:
        names, tails, bounds = lm_scores.tokens(*arrays.text_bytes(pa.array([t])))
        contexts = model.top.contexts(names, tails, bounds)
        place[t] = list(zip(names.tolist(), (contexts % lm_scores.BUCKETS).tolist(), contexts.tolist(), model.top.classes(names, tails).tolist(), strict=True))
    tokens_, pairs, seen, size = collections.Counter(), collections.Counter(), collections.Counter(), collections.Counter()
    class_of = {}
    for r in awkward.collect():
        for w, b, _, c in place[r.text or ""]:
            tokens_[w] += 1
            pairs[w, b] += 1
            seen[b, c] += 1
            class_of[w] = c
    for w, n in tokens_.items():
        size[class_of[w]] += n + 1
    size = {c: n + (c >= lm_scores.OWN_CLASSES) for c, n in size.items()}
    share = {w: (n + 1) / size[class_of[w]] for w, n in tokens_.items()}
    z = dict.fromkeys(seen, 1.0)
    for _ in range(lm_scores.INSIDE_ROUNDS + 1):
        weights = {(w, b): plain_weight(n, seen[b, class_of[w]], share[w], z[b, class_of[w]]) if class_of[w] >= lm_scores.OWN_CLASSES else 0.0 for (w, b), n in pairs.items()}
        z = dict.fromkeys(seen, 1.0)
        for (w, b), x in weights.items():
            z[b, class_of[w]] += share[w] * math.expm1(x)
    for b, c in seen:  # a distribution: all tokens of the class and the unseen one
        if c >= lm_scores.OWN_CLASSES:
            whole = sum(share[w] * math.exp(weights.get((w, b), 0)) for w in tokens_ if class_of[w] == c) + 1 / size[c]
            assert math.isclose(whole / z[b, c], 1, rel_tol=1e-9)
    want = {t: sum(float(model.classes[k * lm_scores.CLASSES + c]) + math.log10(share[w]) + weights[w, b] * math.log10(math.e) - math.log10(z[b, c]) for w, b, k, c in x) for t, x in place.items()}
    for most in (1 << 20, 300):
        model.head = lm_scores._head(table, most)
        for r in lm_scores.scored(awkward, model, table, keep=("doc_id", "text")).collect():
            assert math.isclose(r.score, want[r.text or ""], rel_tol=1e-5, abs_tol=1e-4)


def test_lm_tail_tokens_count_like_head_ones(awkward):
    model, weights = lm_scores.trained(awkward)
    results = []
    for most in (1 << 20, 300, 0):
        model.head = lm_scores._head(weights, most)
        results.append(sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4), round(r.score, 4)) for r in lm_scores.scored(awkward, model, weights).collect()))
    assert results[0] == results[1] == results[2]


def test_lm_weights_grow_with_the_corpus_and_lists_are_bounded(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j * j) % (50 + i)}x" for j in range(80))) for i in range(60)], "doc_id bigint, text string")
    few, many = (lm_scores.trained(docs.where(f"doc_id < {n}"))[1].agg(F.sum(F.size("weights")).alias("n"), F.max(F.size("weights")).alias("most")).first() for n in (20, 60))
    assert many.n > 1.2 * few.n and many.most <= lm_scores.BUCKETS


def test_lm_is_a_distribution_over_classes_and_beats_the_base(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = language.held_out(F.col("doc_id"), 7)
    model, weights = lm_scores.trained(docs.where(~held))
    total = 10 ** model.classes.reshape(lm_scores.CONTEXTS, lm_scores.CLASSES).astype(float)
    assert abs(total.sum(axis=1) - 1).max() < 1e-4
    r = lm_scores.scored(docs.where(held), model, weights).agg(F.sum("score").alias("m"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    print("held-out log10 a token", r.m / r.n, r.b / r.n)
    assert r.m / r.n > r.b / r.n + 0.05
