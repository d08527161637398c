import random

import pytest

from chatloom.llm import ngram_join
from chatloom.llm.components import components


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def brute(rows):
    """Component of each row by comparing all pairs."""
    sets, parent = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 80 * (len(a) + len(sets[j]) - both) and sets[j]:
                parent[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in groups.items()}
    return sorted((str(d), len(s), str(least[root(i)] if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngram_join.near_duplicates(df).collect())
    assert got == brute(rows)


def test_awkward_table(awkward, nothing):
    check(awkward)
    assert ngram_join.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_of_near_copies_and_shared_passages(spark, seed):
    """Groups larger than a short column, with links that stars around one document miss."""
    rng = random.Random(seed)
    word = lambda: str(rng.randrange(5000))
    passage = [word() for _ in range(30)]
    rows, number = [], 0
    for _ in range(3):
        text = passage + [word() for _ in range(40)]
        for _ in range(60):
            text = list(text)
            text[rng.randrange(len(text))] = word()
            rows.append((number, " ".join(text)))
            number += 1
    rows += [(number + i, " ".join(passage[:20] + [word() for _ in range(5)])) for i in range(40)]
    check(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4))


def test_one_of_each_group_stays(awkward):
    kept = ngram_join.kept_one_of_each(awkward)
    ids = sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None)
    assert kept.columns == awkward.columns and len(ids) == len(set(ids))
    assert 8 in ids and 9 not in ids and {1, 2, 3} <= set(ids) and 7 not in ids
    assert kept.where("doc_id IS NULL").count() == 1


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_keys_that_are_no_numbers(awkward, spark):
    """The same components, named by the least key, when keys are texts; equal texts of null and repeated keys too."""
    from pyspark.sql import functions as F

    from chatloom.llm import ngram_join

    text_key = F.lpad(F.col("doc_id").cast("string"), 6, "0").alias("name")
    docs = awkward.select("doc_id", "text", text_key)
    want = {(r.doc_id and f"{r.doc_id:06d}", r.n_shingles, r.component_id and f"{r.component_id:06d}") for r in ngram_join.near_duplicates(docs).collect()}
    got = ngram_join.near_duplicates(docs.drop("doc_id"), key="name")
    assert {tuple(r) for r in got.collect()} == want and got.columns == ["name", "n_shingles", "component_id"]
    kept = ngram_join.kept_one_of_each(docs.drop("doc_id"), key="name")
    assert kept.columns == ["text", "name"] and kept.count() == ngram_join.kept_one_of_each(docs).count()


@pytest.mark.parametrize("copies", [2, 5, 30])
def test_links_near_the_bound(spark, copies):
    """Similarities of 0.7 to 0.9 on either side of the bound, in short and in long columns, of unequal sizes too."""
    rng = random.Random(copies)
    word = lambda: str(rng.randrange(10**6))
    rows = []
    for _ in range(90 // copies):
        text = [word() for _ in range(rng.randrange(30, 150))]
        for _ in range(copies):
            cut, grown = rng.randrange(len(text) // 6), rng.randrange(len(text) // 8)
            rows.append((len(rows), " ".join(text[cut:] + [word() for _ in range(grown)])))
    check(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))


def test_overlaps_discard_no_link_and_most_others(spark):
    """The bound on added-up overlaps against whole sets: links stay, most pairs that share a passage only go."""
    rng = random.Random(7)
    passage, base, pool = [f"p{i}" for i in range(12)], [f"b{i}" for i in range(60)], [f"q{i}" for i in range(70)]
    sets = [frozenset([f"x{n // 2}-{i}" for i in range(3)] + rng.sample(pool, 47)) for n in range(12)]
    sets += [frozenset(base[: 60 - rng.randrange(8)] + passage[: rng.randrange(3)] + [f"y{n}-{i}" for i in range(rng.randrange(6))]) for n in range(30)]
    count = {v: sum(v in s for s in sets) for v in set().union(*sets)}
    ordered = [sorted(s, key=lambda v: (count[v], v))[: len(s) - -(-4 * len(s) // 5) + 1] for s in sets]
    columns = {}
    for n, own in enumerate(ordered):
        for v in own:
            columns.setdefault(v, []).append(n)
    pairs, n_long = [], {}
    for members in columns.values():
        if len(members) > ngram_join.SHORT:
            for n in members:
                n_long[n] = n_long.get(n, 0) + 1
            pairs += [(a, len(sets[a]), b, len(sets[b]), 0) for a in members for b in members if a < b]
        else:
            pairs += [(a, len(sets[a]), b, len(sets[b]), 1) for a in members for b in members if a < b]
    assert n_long and any(p[4] for p in pairs)
    given = spark.createDataFrame(pairs, "a bigint, a_size int, b bigint, b_size int, overlap int")
    counts = spark.createDataFrame(list(n_long.items()), "class bigint, n_long bigint")
    left = {(r.a, r.b) for r in ngram_join._reaching(given, counts).collect()}
    tried = {(p[0], p[2]) for p in pairs}
    linked = {(a, b) for a, b in tried if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    apart = {(a, b) for a, b in tried - linked if b < 12}
    assert linked and linked <= left and len(apart) > 20 and len(apart & left) < 0.5 * len(apart)
