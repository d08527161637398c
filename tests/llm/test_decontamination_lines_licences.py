import collections
import math
import random
import re
import textwrap
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatloom.llm import decontamination, licenses, line_dedup


def sentence(rng, n, size=4000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def test_contamination_exact_near_and_clean(spark, awkward, nothing):
    rng = random.Random(3)
    items = [sentence(rng, n) for n in (3, 9, 30, 45, 80, 300)]
    bench = [(i, " ".join(x)) for i, x in enumerate(items)] + [(90, None), (91, "  "), (92, "!!!")]
    rows, want = [], set()
    for d in range(60):
        words = sentence(rng, 200)
        if d % 3 == 0:
            i = rng.randrange(1, len(items))
            copy = list(items[i])
            if d % 2 and len(copy) >= 80:  # of a shorter item too little would be left
                copy[len(copy) // 2] = "changed"
            at = rng.randrange(150)
            words[at:at] = [w.upper() + "," for w in copy]
            want.add((d, i))
        elif d % 3 == 1:
            half = items[3][:20]
            words[50:50] = half
        rows.append((d, " ".join(words)))
    rows += [(100, " ".join(items[0])), (101, None), (102, "")]
    want.add((100, 0))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    benchmark = spark.createDataFrame(bench, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, benchmark).collect()}
    assert got == want
    kept = decontamination.clean_documents(docs, benchmark)
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {d for d, _ in want}
    assert decontamination.contaminated(docs, benchmark.where("false")).count() == 0
    assert decontamination.contaminated(nothing, benchmark).count() == 0
    assert decontamination.clean_documents(awkward, benchmark).columns == awkward.columns


def test_slices_of_the_benchmark_find_the_same(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, decontamination.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "SLICE_BYTES", 3000)
    assert whole and sorted(map(tuple, decontamination.contaminated(docs, bench).collect())) == whole


def test_hamming_search_misses_nothing_within_the_radius():
    import numpy as np

    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**63, 50, dtype=np.uint64)
    index = decontamination.Width(prints, np.arange(50), np.zeros(50, int)).index()
    probes = np.array([p ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for p in prints for k in range(11)], np.uint64)
    found = set(zip(*(x.tolist() for x in index.search(probes)), strict=True))
    assert found == {(i, j) for i, p in enumerate(probes) for j, q in enumerate(prints) if int(p ^ q).bit_count() <= decontamination.RADIUS}


def test_lines(spark, awkward, nothing):
    rng = random.Random(4)
    long = sentence(rng, 300)
    near = list(long)
    near[150] = "other"
    rows = [
        (1, "A first line, of some words\nshort\n" + " ".join(long)), (2, "a FIRST line of some: words\nshort\nanother line that nobody else has here"), (3, " ".join(near) + "\na first line of some words"),
        (4, None), (5, ""), (5, "a first line of some words"), (None, "a first line of some words"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.place): (r.kept_doc_id, r.kept_place) for r in line_dedup.repeated_lines(docs).collect()}
    assert got == {(1, 0): (None, 0), (2, 0): (None, 0), (3, 1): (None, 0), (5, 0): (None, 0), (3, 0): (1, 2)}
    clean = {(r.doc_id, r.text) for r in line_dedup.without_repeated_lines(docs).collect()}
    assert (2, "short\nanother line that nobody else has here") in clean and (4, None) in clean and (3, "") in clean
    assert line_dedup.repeated_lines(nothing).count() == 0
    assert line_dedup.line_report(awkward).count() == awkward.select("doc_id").distinct().count()


def edits(a, b):
    """Plain edit distance, by anti-diagonals: it shares nothing with the operator."""
    row = np.arange(len(b) + 1)
    y = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    for i, x in enumerate(np.frombuffer(a.encode("utf-32-le"), np.uint32), 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (y != x))
        new = np.concatenate([[i], new])
        # an insertion follows the least value to its left
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row[-1])


@pytest.mark.parametrize("common", ["", "international organisation recommendations concerning"])
def test_recall_against_an_independent_edit_distance(spark, common):
    """Words and letters changed by 5, 10 and 15 %, lines of 5 to 400 words, with and without a common opening of long words."""
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(max(2, round(rng.gauss(6, 2.5)))))
    words, rows, want = [word() for _ in range(5000)], [], {}
    for kind in ("words", "letters"):
        for percent in (5, 10, 15):
            for low, high, n in ((5, 11, 25), (12, 30, 40), (60, 90, 10), (400, 400, 3)):
                for _ in range(n):
                    line = common.split() + [rng.choice(words) for _ in range(rng.randint(low, high))]
                    near = list(line)
                    if kind == "words":
                        for j in rng.sample(range(len(line)), max(1, len(line) * percent // 100)):
                            near[j] = rng.choice(words)
                    else:
                        spots = list(" ".join(line))
                        for j in rng.sample([i for i, c in enumerate(spots) if c != " "], len("".join(line)) * percent // 100):
                            spots[j] = rng.choice(letters)
                        near = "".join(spots).split()
                    x, y = " ".join(line), " ".join(near)
                    if x != y and edits(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9:
                        want[len(rows)] = (kind, percent)
                    rows += [(len(rows), x), (len(rows) + 1, y)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.kept_doc_id for r in line_dedup.repeated_lines(docs).collect()}
    assert {k for k, v in got.items() if v != k - 1 or k % 2 == 0} == set()  # nothing else is linked
    found = collections.Counter(kind for i, kind in want.items() if got.get(i + 1) == i)
    every = collections.Counter(want.values())
    recall = {kind: found[kind] / n for kind, n in every.items()}
    assert all(recall[kind] >= (0.65 if kind == ("letters", 15) else 0.9) for kind in every), str(recall)  # the README has the figures
    assert sum(found.values()) >= 0.9 * sum(every.values()), str(recall)


def test_no_switch_at_a_length(spark):
    """The same share of letters changed is found just below and just above a thousand characters, and far above."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    for size in (950, 1050, 4000):
        rows = []
        for _ in range(20):
            line = " ".join(rng.choice(words) for _ in range(size))[:size].strip()
            spots = list(line)
            for j in rng.sample([i for i, c in enumerate(spots) if c != " "], size * 6 // 100):
                spots[j] = rng.choice("abcdefghijklmnopqrstuvwxyz")
            rows += [(len(rows), line), (len(rows) + 1, "".join(spots))]
        got = line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).count()
        assert got >= 19, (size, got)


def test_edit_similarity_against_plain_python(spark):
    rng = random.Random(8)

    rows = []
    for n in (5, 9, 20, 60, 400):
        for k in range(12):
            line = sentence(rng, n, 300)
            near = list(line)
            for j in sorted(rng.sample(range(n), max(1, n * k // 20)), reverse=True):
                near[j : j + 1] = rng.choice([[], [near[j], "added"], ["other"], [near[j][:-1] + "x"]])
            rows.append((len(rows), " ".join(line), " ".join(near)))
    df = spark.createDataFrame(rows, "k int, a string, b string")
    met = df
    for side in "ab":
        met = met.join(line_dedup._compared(df.select(F.col("k").alias("h"), F.col(side).alias("norm")), side).withColumnRenamed(side, f"{side}_k"), F.col("k") == F.col(f"{side}_k"))
    got = {r.k: r.same for r in met.select("k", line_dedup._similar("a_text", "b_text").alias("same")).collect()}
    for k, a, b in rows:
        assert got[k] == (edits(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9), (a, b)


@pytest.mark.parametrize("tile", [line_dedup.TILE, 16])
def test_like_lines_of_a_large_bucket_whose_simhashes_differ(spark, tile, monkeypatch):
    """A phrase common to all, each other word of a copy with one letter changed: only a meeting of all lines of the bucket finds these."""
    monkeypatch.setattr(line_dedup, "TILE", tile)
    rng = random.Random(10)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(60):
        words = ["".join(rng.choice(letters) for _ in range(8)) for _ in range(10)]
        rows.append((2 * k, "international organisation " + " ".join(words)))
        if k % 6 == 0:
            near = [w[: (at := rng.randrange(8))] + ("z" if w[at] != "z" else "y") + w[at + 1 :] for w in words]
            rows.append((2 * k + 1, "international organisation " + " ".join(near)))
    got = {r.doc_id: r.kept_doc_id for r in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {k: k - 1 for k, _ in rows if k % 2}


def test_a_common_phrase_at_places_that_fit(spark):
    """A phrase that stands anywhere in all lines and is all that like ones share: these are found, and only where places fit are lines compared."""
    rng = random.Random(11)
    rows = []
    for k in range(60):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(16)]
        at = rng.randrange(16)
        rows.append((2 * k, " ".join([*words[:at], "international organisation", *words[at:]])))
        if k % 4 == 0:
            near = [w[: (i := rng.randrange(8))] + ("z" if w[i] != "z" else "y") + w[i + 1 :] for w in words]
            near[rng.randrange(16)] += "xyz"
            rows.append((2 * k + 1, " ".join([*near[:at], "international organisation", *near[at:]])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    spots = docs.select("doc_id", F.expr("locate('international', text) - 1").alias("spot"), F.length("text").alias("size"))
    a, b = (spots.select(*(F.col(c).alias(f"{s}_{c}") for c in spots.columns)) for s in "ab")
    fit = {(r.a_doc_id, r.b_doc_id) for r in a.join(b, (F.col("a_doc_id") < F.col("b_doc_id")) & line_dedup._beside(("a_spot", "a_size"), ("b_spot", "b_size"))).collect()}
    assert {(k - 1, k) for k, _ in rows if k % 2} <= fit and len(fit) < len(rows) * (len(rows) - 1) / 2 / 3
    got = {r.doc_id: r.kept_doc_id for r in line_dedup.repeated_lines(docs).collect()}
    assert got == {k: k - 1 for k, _ in rows if k % 2}


@pytest.mark.parametrize("others", [0, 60])
def test_a_common_phrase_at_places_that_do_not_fit(spark, others):
    """Like lines whose only shared words stand at the beginning of one and at the end of the other; the counterparts have a letter changed there."""
    rng = random.Random(13)
    letters = "abcdefghijklmnopqrstuvwxyz"
    draw = lambda: ["".join(rng.choice(letters) for _ in range(8)) for _ in range(14)]
    rows, want = [], {}
    for k in range(8):
        words = draw()
        near = [w[: (at := rng.randrange(8))] + ("z" if w[at] != "z" else "y") + w[at + 1 :] for w in words]
        x = " ".join(["international organisation", *words, "internatioqal orgaqisation"])
        y = " ".join(["internatiojal orgajisation", *near, "international organisation"])
        assert edits(x, y) <= 0.2 * len(x)
        rows += [(2 * k, x), (2 * k + 1, y)]
        want[2 * k + 1] = 2 * k
    rows += [(1000 + k, " ".join(["international organisation", *draw(), *draw()[:2]])) for k in range(others)]
    got = {r.doc_id: r.kept_doc_id for r in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want


def test_counts_of_letters_rule_out_no_line_alike(spark):
    """The bound by counts is never above the plain distance, with letters that aren't counted and more than 127 of one as well."""
    rng = random.Random(14)
    rows = []
    for k in range(300):
        line = sentence(rng, rng.choice([5, 12, 60, 300]), 300) + rng.choice([[], ["été", "größe"], ["e" * 200]])
        near = list(line)
        for j in rng.sample(range(len(line)), rng.randint(0, max(1, len(line) // 3))):
            near[j] = rng.choice(["other", near[j][:-1], near[j] + "x", "e" * 9, "漢字"])
        rows.append((k, " ".join(line), " ".join(near)))
    met = spark.createDataFrame(rows, "h int, a string, b string")
    for side in "ab":
        texts = met.select("h", F.col(side).alias("norm"), F.length(side).alias("size"))
        met = met.join(line_dedup._compared(line_dedup._letters(texts), f"{side}_").withColumnsRenamed({f"{side}__{c}": f"{side}_{c}" for c in ("size", *line_dedup._counts())}), F.col("h") == F.col(f"{side}_"))
    fits = {r.h: r.fits for r in met.select("h", line_dedup._letters_fit("a", "b").alias("fits")).collect()}
    alike = {k for k, a, b in rows if edits(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9}
    assert 50 < len(alike) < 290 and all(fits[k] for k in alike) and not all(fits.values())


def test_pieces_of_long_lines_never_link_more(spark):
    """A long line with a passage put in and words changed: what pieces accept is alike by the plain distance, and most of such lines are accepted."""
    rng = random.Random(12)
    rows = []
    for k in range(24):
        line = sentence(rng, 250, 300)
        near = list(line)
        for j in rng.sample(range(250), k):
            near[j] = "other"
        at = rng.randrange(250)
        near[at:at] = sentence(rng, 4 * (k % 12), 300)
        rows.append((k, *rng.sample([" ".join(line), " ".join(near)], 2)))
    df = spark.createDataFrame(rows, "k int, a string, b string")
    got = {r.k: r.pieces for r in df.select("k", line_dedup._alike_by_pieces("a", "b").alias("pieces")).collect()}
    alike = {k: edits(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9 for k, a, b in rows}
    assert not [k for k in got if got[k] and not alike[k]] and sum(got.values()) >= 8, (got, alike)


def test_lines_of_many_thousand_words(spark):
    rng = random.Random(9)
    long = sentence(rng, 20000)
    near = list(long)
    for j in rng.sample(range(20000), 300):
        near[j] = "changed"
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(sentence(rng, 20000)))]
    got = [tuple(r) for r in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert got == [(2, 0, 1, 0)]


def test_clashing_names(spark):
    names = ["k", "places", "key", "h", "own", "line", "norm"]
    rows = [(1, "the same line of words", *names), (2, "other\nthe same line of words", *names)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"{n} string" for n in names))
    out = line_dedup.without_repeated_lines(docs)
    assert out.columns == docs.columns and {(r.doc_id, r.text, r.k) for r in out.collect()} == {(1, "the same line of words", "k"), (2, "other", "k")}


def test_short_lines_repeat_exactly_only(spark):
    docs = spark.createDataFrame([(1, "All rights reserved\nword"), (2, "all rights, reserved.\nword"), (3, "all rights reservec")], "doc_id bigint, text string")
    assert [tuple(r) for r in line_dedup.repeated_lines(docs).collect()] == [(2, 0, 1, 0)]


def test_licences(spark, awkward, nothing):
    rows = [
        (1, "a/LICENSE", "Licensed under CC BY-NC 4.0."), (2, "a/x.py", "some text\nReleased under the MIT License.\nmore text"), (3, "a/b/c/y.py", "plain words only"), (4, "a/b/LICENSE.txt", "nothing of that kind"),
        (5, "a/b/d/COPYING", "This work is licensed under the GNU General Public License, version 3."), (6, "a/b/d/z/q.py", None), (7, "c/w.py", "we talk about a license here"), (8, None, "Licensed under the Apache License, Version 2.0."), (9, "top.py", ""),
    ]
    got = {r.doc_id: (r.licence, r.how) for r in licenses.licensed(spark.createDataFrame(rows, "doc_id bigint, path string, text string")).collect()}
    assert got == {
        1: ("CC-BY-NC-4.0", "file"), 2: ("MIT", "header"), 3: ("CC-BY-NC-4.0", "inherited"), 4: ("CC-BY-NC-4.0", "inherited"), 5: ("GPL-3.0", "file"), 6: ("GPL-3.0", "inherited"), 7: (None, None), 8: ("Apache-2.0", "header"), 9: (None, None),
    }
    assert licenses.licensed(nothing.selectExpr("doc_id", "text", "source AS path")).count() == 0
    assert licenses.licensed(awkward.selectExpr("doc_id", "text", "source AS path")).count() == awkward.count()


def test_wrapped_headers_and_licence_files(spark):
    """Every template wrapped as a comment inside other text is found, and so is a changed copy as a licence file; plain text isn't."""
    rng = random.Random(11)
    rows, want = [], {}
    for i, (name, text) in enumerate(licenses.TEMPLATES):
        lines = ["# " + x for x in textwrap.wrap(text, 72)]
        before, after = ([" ".join(sentence(rng, 12)) for _ in range(30)] for _ in range(2))
        rows.append((i, f"d{i}/x.py", "\n".join([*before, *lines, *after])))
        changed = text.split()
        for _ in range(len(changed) // 20):
            changed[rng.randrange(len(changed))] = f"w{rng.randrange(4000)}"
        rows.append((100 + i, f"d{i}/LICENSE", "Copyright 2020 Some One\n" + " ".join(changed)))
        want[i] = want[100 + i] = name
    rows += [(200 + i, "e/y.py", "we hold that the use of this software is without limitation\n" + " ".join(sentence(rng, 80))) for i in range(20)]
    got = {r.doc_id: r for r in licenses.licensed(spark.createDataFrame(rows, "doc_id bigint, path string, text string")).collect()}
    assert {k: got[k].licence for k in want} == want
    assert {got[k].how for k in want if k < 100} == {"header"} and all(got[200 + i].licence is None for i in range(20))


def test_own_licences_against_plain_python(spark):
    """The best cosine of any window, with document frequencies of all words, computed plainly."""
    rng = random.Random(12)
    pool = "licensed under the mit license apache version 2 0 cc by nc 4 released this work is we use it".split()
    rows = [(i, "\n".join(" ".join(rng.choices(pool, k=rng.randint(1, 6))) for _ in range(rng.randint(0, 5)))) for i in range(200)]
    texts = [t.split("\n") for _, t in rows]
    n = len(texts)
    df = collections.Counter(w for t in texts for w in {w for line in t for w in line.split()})
    split = lambda t: re.findall("[a-z0-9]+", t.lower())
    vector = lambda ws: {w: c * (math.log((n + 1) / (df[w] + 1)) + 1) for w, c in collections.Counter(ws).items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    templates = [vector(split(t)) for _, t in licenses.TEMPLATES]
    numbers = [set(split(name.rpartition("-")[2])) if name.rpartition("-")[2][:1].isdigit() else set() for name, _ in licenses.TEMPLATES]
    want = {}
    for (d, _), lines in zip(rows, texts, strict=True):
        units = [split(" ".join(lines[a : a + k])) for k in licenses.WINDOWS for a in range(len(lines) - k + 1)]
        want[d] = 0.0
        for v in map(vector, filter(None, units)):
            scores = [sum(x * t.get(w, 0) for w, x in v.items()) / size(v) / size(t) if all(w in v for w in t if w in versions) else 0 for t, versions in zip(templates, numbers, strict=True)]
            best = max(range(len(scores)), key=lambda j: scores[j])
            other = max((x for x, (name, _) in zip(scores, licenses.TEMPLATES, strict=True) if name != licenses.TEMPLATES[best][0]), default=0)
            if scores[best] >= licenses.THRESHOLD and scores[best] - other >= licenses.MARGIN:
                want[d] = max(want[d], scores[best])
    df_ = spark.createDataFrame([(d, None, t) for d, t in rows], "doc_id bigint, path string, text string").repartition(3)
    got = {r.doc_id: r.score for r in licenses.own_licences(df_).collect()}
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-6 for d in want) and sum(x > 0 for x in want.values()) > 10


WHOLE = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not WHOLE.exists(), reason="no public licence texts on this machine")
def test_whole_licence_texts_are_named_rightly_or_not_at_all(spark):
    """Whole texts as licence files, also without their first lines, and texts whose licence is none of the known ones."""
    names = {"GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "Apache-2.0": "Apache-2.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "BSD": "BSD-3-Clause", "Artistic": None}
    rows, right = [], {}
    for i, (file, name) in enumerate((f, n) for f, n in names.items() if (WHOLE / f).exists()):
        text = (WHOLE / file).read_text(errors="replace")
        rows += [(i, f"{file}/LICENSE", text), (100 + i, f"{file}/part/LICENSE", "\n".join(text.split("\n")[12:]))]
        right[i] = name
    got = {r.doc_id: r.licence for r in licenses.own_licences(spark.createDataFrame(rows, "doc_id bigint, path string, text string")).collect()}
    assert {i: got[i] for i in right} == right
    assert all(got[100 + i] in (None, name) for i, name in right.items())


def test_near_misses(spark):
    """Titles, versions and wordings that are nearly those of a known licence name none."""
    rows = [
        (1, "a/LICENSE", "GNU LESSER PUBLIC LICENSE Version 9, June 1991\n" + "other words " * 40), (2, "b/x.c", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version."),
        (3, "c/x.c", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
        (4, "d/LICENSE", "Some Other Licence\n" + "you may look at this but not touch it nor take it home with you at all " * 8 + "\nTHE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED"), (5, "e/x.c", "Licensed under the Apache License, Version 1.1."),
    ]
    got = {r.doc_id: r.licence for r in licenses.own_licences(spark.createDataFrame(rows, "doc_id bigint, path string, text string")).collect()}
    assert got == {1: None, 2: None, 3: "GPL-2.0", 4: None, 5: None}
