"""Edge cases of the message operators, by example."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatloom.functions import phone
from chatloom.operators import collection, embed, normalize, rag, search, snippet, sync
from chatloom.scratch import new_folder
from chatloom.sources.events import read_events, read_export_lines


def test_event_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"account_id": "a", "chat_id": "c", "message_id": "1", "message_type": "document", "text": "see", "timestamp": "2024-05-01T10:00:00+05:30",\n "attachment": {"file_id": "f", "mime_type": "Application/PDF; x=y", "file_size": 5}, "is_edited": false, "is_deleted": false}')
    (tmp_path / "b.json").write_text('{"_comment": "nothing here"}')
    (tmp_path / "c.json").write_text("{broken")
    (tmp_path / "d.json").write_text('{"account_id": "a", "chat_id": "c", "message_id": "2", "message_type": "photo", "text": "http://x", "timestamp": "2024-05-01T10:00:00Z", "sender_name": " "}')
    (tmp_path / "e.json").write_text('{"account_id": "a", "chat_id": "c", "message_id": "3", "message_type": "text", "text": "gone", "timestamp": "2024-05-01T10:00:00", "is_deleted": true}')
    (tmp_path / "f.json").write_text('{"account_id": "a", "chat_id": "c", "message_id": "4", "message_type": "text", "timestamp": "2024-05-01T10:00:00"}')
    events = read_events(spark, str(tmp_path))
    assert events.count() == 4
    got = {(r.source_message_id, r.content_type, r.text, str(r.ts)) for r in normalize.normalize(events).collect()}
    assert got == {
        ("1", "text", "see", "2024-05-01 04:30:00"), ("1:attachment", "pdf", None, "2024-05-01 04:30:00"), ("2", "image", "http://x", "2024-05-01 10:00:00"), ("3", "system", None, "2024-05-01 10:00:00"),
    }


def test_filters():
    for bad in ({"nope": 1}, {"token_count": "x"}, {"contains_images": 1}, {"source_chat": {"$gt": "a"}}, {"chunk_index": {"$gt": 1, "$lt": 3}}, {"chunk_index": {"$in": [1]}}):
        with pytest.raises(search.FilterError):
            search.metadata_filter(bad)
    assert search.metadata_filter({}) is None and search.metadata_filter(None) is None


def test_owner_scope_cannot_be_left(spark):
    chunks = spark.createDataFrame(
        [("v1", "ann", "telegram", "same name", [1.0, 0.0], False), ("v2", "bob", "telegram", "same name", [1.0, 0.0], False), ("v3", "ann", "telegram", "same name", [1.0, 0.0], True), ("v4", "ann", "other", "same name", [0.6, 0.8], True), ("v5", "ann", "other", " ", [0.6, 0.8], False)],
        "vector_id string, owner_id string, source string, text string, embedding array<float>, is_deleted boolean")
    queries = spark.createDataFrame([(1, "ann", [1.0, 0.0], 5), (2, "eve", [1.0, 0.0], 5)], "query_id bigint, owner_id string, query_vector array<float>, top_k int")
    hits = search.knn(chunks, queries)
    assert [(r.vector_id, r.rank, r.similarity, r.low_confidence) for r in hits.orderBy("rank").collect()] == [("v1", 1, 1.0, False), ("v4", 2, 0.6, False)]
    sliced = search.knn(chunks, queries, most=1)
    assert {(r.query_id, r.vector_id) for r in sliced.collect()} == {(1, "v1"), (1, "v4")}
    assert {r.query_id: r.no_strong_match for r in search.no_strong_match(queries, hits).collect()} == {1: False, 2: True}


def test_similarity_points(spark):
    d = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (2.0,), (-1e-9,)], "d double")
    got = d.select(*(search.similarity(F.col("d"), m).alias(m) for m in ("cosine", "l2", "ip"))).collect()
    assert [r.cosine for r in got] == [1.0, 0.5, 0.0, 0.0, 1.0]
    assert [round(r.l2, 6) for r in got] == [1.0, 0.666667, 0.5, 0.333333, 1.0]
    assert [r.ip for r in got] == [0.0, 0.5, 1.0, 1.0, 0.0]


def classified_one_by_one(events):
    """An event-at-a-time form of the classification."""
    out, tomb, exists, top, done, version = [], False, False, None, {}, 1
    for kind, ts, uid, fresh in events:
        key = (kind, uid or ts or "unknown")
        if kind == "delete":
            status = "skipped" if tomb else "ok" if exists else "not_found"
            tomb = True
        elif kind == "new":
            status = "blocked" if tomb else "ignore" if exists else "created"
            exists = True
        elif tomb:
            status = "deleted"
        elif not exists and not fresh:
            status = "failed"
        elif done.get(key):
            status = "duplicate"
        else:
            late = top is not None and ts is not None and (ts < top[0] or ts == top[0] and bool(uid) and bool(top[1]) and uid < top[1])
            status = "stale" if late else "apply" if exists else "upsert"
            done.setdefault(key, not late)
            version += status == "apply"
            if ts is not None and (top is None or (ts, uid or "") > top):
                top = (ts, uid or "")
        exists = exists or kind == "edit" and fresh
        out.append(status)
    return out


def test_classification_against_a_loop(spark):
    rng, rows, want = random.Random(11), [], {}
    for m in range(300):
        pool = [(rng.choice(["edit"] * 6 + ["new", "delete"]), rng.randrange(4), f"{rng.randrange(6):02d}", rng.random() < 0.7) for _ in range(5)]
        seen = {}
        own = []
        for _ in range(rng.randrange(1, 9)):
            kind, ts, uid, fresh = rng.choice(pool)
            ts, fresh = seen.setdefault((kind, uid), (ts, fresh))
            own.append((kind, ts, uid, fresh))
        want[m] = classified_one_by_one(own)
        rows += [("a", "c", str(m), kind, ts, uid, fresh, i) for i, (kind, ts, uid, fresh) in enumerate(own)]
    df = spark.createDataFrame(rows, "account_id string, chat_id string, message_id string, kind string, edit_ts bigint, update_id string, reconstructible boolean, arrival bigint")
    df = df.withColumn("edit_ts", F.timestamp_seconds("edit_ts")).repartition(7)
    got = {}
    for r in sync.classify_updates(df).orderBy("arrival").collect():
        got.setdefault(int(r.message_id), []).append(r.status)
    assert got == want


STAMPED = "1/2/2024, 9:05 AM - Ann: the budget meeting is on friday\nwith all papers\n1/2/2024, 9:06 AM - Bob: I bring the papers\n1/2/2024, 9:07 AM - Messages are encrypted\n1/2/2024, 10:00 - Cleo: lunch?"


def test_segments_and_times(spark):
    df = spark.createDataFrame([(1, STAMPED), (2, "no stamps\n\nat all"), (3, ""), (4, None), (5, "begins late\n1/2/2024, 10:00 - x: y")], "k int, text string")
    got = {}
    for r in normalize.segment(df, "k").orderBy("k", "message_no").collect():
        got.setdefault(r.k, []).append((r.message, r.fallback_split))
    assert [m.count("\n") for m, _ in got[1]] == [1, 0, 0, 0] and not got[1][0][1]
    assert got[2] == [("no stamps", True), ("at all", True)] and 3 not in got and 4 not in got
    assert [m for m, _ in got[5]] == ["begins late", "1/2/2024, 10:00 - x: y"]
    line = spark.createDataFrame([("1/2/2024, 9:05 PM",), ("13/1/2024, 9:05",), ("1/2/24, 9:05",)], "s string")
    assert [str(r[0]) for r in line.select(normalize.chat_time(F.col("s"))).collect()] == ["2024-01-02 21:05:00", "None", "None"]


def loop_snippet(question, text):
    """Message by message: which are picked."""
    messages = [m for m in re.split(r"\n(?=\d+/\d+/\d+, \d+:\d+)", text)]
    terms = [w for w in re.findall(r"\b\w+\b", question.lower()) if w not in snippet.STOP_WORDS and len(w) > 1]
    exact = [sum(len(re.findall(rf"\b{t}\b", m.lower())) for t in terms) for m in messages]
    partial = [sum(t in m.lower() and not re.search(rf"\b{t}\b", m.lower()) for t in terms) for m in messages]
    score = [10 * e + 2 * p for e, p in zip(exact, partial, strict=True)]
    if not terms or max(score) == 0:
        return None
    body = [set(re.findall(r"\b[a-z]{3,}\b", m.split(": ", 1)[-1].lower())) - set(snippet.STOP_WORDS) for m in messages]
    taken = {i for i, s in enumerate(score) if s} | {j for i, s in enumerate(score) if s for j in (i - 1, i + 1) if 0 <= j < len(messages) and not score[j] and body[i] & body[j]}
    picked, used = [], 0
    for i in sorted(taken, key=lambda i: (-score[i], i)):
        n = messages[i].count("\n") + 1
        if used + n <= 8 or used == 0:
            picked.append(i)
            used += n
    return "\n".join("\n".join(messages[i] for i in sorted(picked)).split("\n")[:8])


def test_snippets_against_a_loop(spark):
    rng = random.Random(2)
    vocabulary = "budget papers meeting friday lunch größe the on budgets paper train".split()
    rows = []
    for k in range(120):
        lines = []
        for i in range(rng.randrange(1, 9)):
            body = "\n".join(" ".join(rng.choices(vocabulary, k=rng.randrange(1, 5))) for _ in range(rng.choice([1, 1, 1, 3, 9])))
            lines.append(f"1/2/2024, 9:{10 + i} - S{i}: {body}")
        rows.append((k, " ".join(rng.choices(vocabulary, k=2)), "\n".join(lines)))
    rows += [(900, "the on", STAMPED), (901, "budget", " "), (902, "zebra", STAMPED), (903, "budget", None)]
    df = spark.createDataFrame(rows, "k int, question string, text string")
    got = {r.k: r for r in snippet.snippets(df, ["k"]).collect()}
    assert len(got) == len(rows)
    for k, question, text in rows[:120]:
        assert got[k].focused_snippet == loop_snippet(question, text), k
        assert got[k].no_strong_passage == (got[k].focused_snippet is None)
    assert all(got[k].no_strong_passage and got[k].focused_snippet is None for k in (900, 901, 902, 903))


def test_reasons(spark):
    df = spark.createDataFrame([(1, "papers friday", STAMPED), (2, "paper", STAMPED)], "k int, question string, text string")
    got = {r.k: r for r in snippet.snippets(df, ["k"]).collect()}
    assert got[1].relevance_reason == "Matched keyword: 'papers' (3 occurrences); also matched: 'friday'" and got[1].matched_messages == "0,1"
    assert got[2].relevance_reason == "Substring match (2 occurrences)"


def test_preprocess(spark):
    df = spark.createDataFrame([("  a\n\nb\t c ",), ("é",), (" \n",)], "q string")
    assert [r[0] for r in df.select(snippet.preprocess(F.col("q"))).collect()] == ["a b c", "é", None]


def test_insert_rules(spark):
    old = spark.createDataFrame([("c", "1"), ("c", "2")], "collection string, vector_id string")
    new = spark.createDataFrame([("c", "2"), ("c", "3"), ("d", "3")], "collection string, vector_id string")
    rows, summary = collection.insert_ignore(old, new)
    assert sorted(map(tuple, rows.collect())) == [("c", "3"), ("d", "3")]
    assert {r.collection: (r.received, r.inserted, r.skipped, r.final_count) for r in summary.collect()} == {"c": (2, 1, 1, 3), "d": (1, 1, 0, 1)}
    again, _ = collection.insert_ignore(old.union(rows), new)
    assert again.count() == 0
    with pytest.raises(collection.CollectionError):
        collection.insert_ignore(old, new.union(new))


def test_stored_collection(spark, tmp_path):
    rows = spark.createDataFrame([("c", "1", "ann", "x"), ("c", "2", "bob", "x"), ("d", "3", "ann", "y")], "collection string, vector_id string, owner_id string, conversation_id string")
    path = str(tmp_path / "store")
    collection.write_collection(rows, path, batch=1)
    assert {r.vector_id for r in collection.read_collection(spark, path, owner_id="ann").collect()} == {"1", "3"}
    collection.drop_collection(spark, path, "d")
    assert collection.read_collection(spark, path).count() == 2
    with pytest.raises(collection.CollectionError):
        collection.drop_collection(spark, path, "d")
    report = collection.migrate(rows.where("collection = 'd'"), collection.read_collection(spark, path).select("collection", "vector_id"), path, dry_run=False)
    assert report.first().status == "migrated" and collection.read_collection(spark, path).count() == 3


def test_embedding(spark):
    rows = spark.createDataFrame([(1, "hello world"), (2, "hello world"), (3, " "), (4, None), (5, "cached")], "k int, text string")
    cache = spark.createDataFrame([(5, "cached")], "k int, text string").select(embed.cache_key(F.col("text")).alias("key"), F.array(*[F.lit(0.5).cast("float")] * 4).alias("embedding"))
    got = {r.k: r.embedding for r in embed.embed(rows, lambda: embed.hashing_embedder(4), 4, cache=cache).collect()}
    assert got[1] == got[2] and abs(np.linalg.norm(got[1]) - 1) < 1e-6
    assert got[3] == got[4] == [0.0] * 4 and got[5] == [0.5] * 4
    bad = spark.createDataFrame([(None,), ([],), ([float("nan")],), ([float("inf")],), ([0.0, 0.0],), ([1.0],), ([1.0, 0.0],)], "v array<float>")
    assert [r[0] for r in bad.select(embed.vector_problem(F.col("v"), 2)).collect()] == ["missing", "empty", "not finite", "not finite", "zero", "wrong dimension", None]


def test_context_budget(spark):
    hits = spark.createDataFrame([(1, r, f"v{r}", 0.5, None, 0, "x" * 100) for r in (1, 2, 3)] + [(2, 1, "w", 0.9, "C", 1, "y" * 5000)], "query_id int, rank int, vector_id string, similarity double, conversation_title string, chunk_index int, text string")
    size = len("[Document 1]\nSimilarity : 0.5000\nID         : v1\nSource     : Unknown\nTimestamp  : N/A\nChunk      : 0\n\n") + 100
    got = {r.query_id: r for r in rag.context(hits, budget_tokens=(2 * size + 3) // 4).collect()}
    assert got[1].n_documents == 2 and got[1].chars == 2 * size and got[1].context.count("[Document") == 2
    assert got[2].n_documents == 0 and got[2].context is None and got[2].error


def test_phone(spark):
    cases = {"+91 98765-43210": "+91 ******3210", "+1 (415) 555-2671": "+1 ******2671", "+442071838750": "+44 ******8750", "+1234567": "+12 ******"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert [r[0] for r in df.select(phone.masked(phone.normalized(F.col("p")))).collect()] == list(cases.values())
    bad = {"": "empty_input", " - ": "empty_after_strip", "123": "missing_plus_prefix", "+": "no_digits", "+12a": "contains_non_digits", "+123456": "too_short", "+1234567890123456": "too_long"}
    df = spark.createDataFrame([(k,) for k in bad], "p string")
    assert [r[0] for r in df.select(phone.problem(F.col("p"))).collect()] == list(bad.values())


def test_reconcile_twice(spark):
    schema = "account_id string, chat_id string, message_id string, is_edited boolean, is_deleted boolean, processing_status string"
    messages = spark.createDataFrame([("a", "c", "1", False, True, "completed"), ("a", "c", "2", True, False, "processing")], schema)
    chunks = spark.createDataFrame([("a", "c", "1", "v1", True)], "account_id string, chat_id string, message_id string, vector_id string, is_active boolean")
    operations = spark.createDataFrame([("k1", "processing", "2024-01-01 00:00:00"), ("k2", "processing", "2024-01-01 00:59:00")], "idempotency_key string, status string, started_at string").withColumn("started_at", F.col("started_at").cast("timestamp"))
    now, none = F.lit("2024-01-01 01:00:00").cast("timestamp"), messages.where("false").select(*sync.MESSAGE)
    found = sync.reconcile(messages, chunks, operations, none, now)
    assert sorted((r.rule, r.subject) for r in found.collect()) == [(1, "k1"), (2, "a:c:1"), (4, "a:c:2")]
    repaired = sync.reconcile(messages.withColumn("is_edited", F.lit(False)), sync.apply_deletes(chunks, messages.where("is_deleted")), operations.where("idempotency_key <> 'k1'"), none, now)
    assert repaired.count() == 0


def test_equal_vectors_go_by_the_smaller_id(spark):
    chunks = spark.createDataFrame([(f"v{i}", "ann", "x", "text", [1.0, 0.0], False) for i in range(99, 49, -1)], "vector_id string, owner_id string, source string, text string, embedding array<float>, is_deleted boolean").coalesce(1)
    queries = spark.createDataFrame([(1, "ann", [1.0, 0.0], 3)], "query_id bigint, owner_id string, query_vector array<float>, top_k int")
    want = ["v50", "v51", "v52"]
    assert [r.vector_id for r in search.knn(chunks, queries).orderBy("rank").collect()] == want
    assert [r.vector_id for r in search.knn_by_matrix(chunks, queries, k=3).orderBy("rank").collect()] == want


def test_top_k_is_cut_before_its_shuffle(spark):
    from chatloom.sources import tables

    sf = "/root/testdata/sf0.001"
    queries = tables.query_vectors(spark, sf).withColumn("top_k", (F.col("query_id") % 3 + 1).cast("int"))
    plan = search.knn(tables.chunks(spark, sf), queries)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("WindowGroupLimit") :]
    assert "Partial" in plan and "Exchange hashpartitioning(query_id" in below


def test_huge_exports_in_any_split(spark, tmp_path):
    """Lines of files that many tasks read give the messages of whole texts, wherever blocks begin."""
    rng = random.Random(9)
    texts = {}
    for f in range(3):
        lines = []
        for i in range(400):
            lines.append(rng.choice([f"1/{1 + i % 28}/2024, 10:{i % 60:02d} - Ann: line {i}", "  goes on", f"2/3/2024, 9:05 - Bob joined {i}", "", "more é text"]) if f else f"plain {i}" * (i % 4 > 0))
        texts[f"file{f}.txt"] = "\n".join(lines)
        (tmp_path / f"file{f}.txt").write_text(texts[f"file{f}.txt"])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
        lines = read_export_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 9
        found = normalize.segment_lines(lines, ["file"], ["block", "n"]).select(F.substring_index("file", "/", -1).alias("file"), "message_no", "message", "n_lines", "fallback_split").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = normalize.segment(spark.createDataFrame(list(texts.items()), "file string, text string"), "file").select("file", "message_no", "message", "n_lines", "fallback_split").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, want)) and len(want) > 300


def test_a_collection_that_loses_rows_fails(spark, monkeypatch):
    """The migration reads back what it wrote: a collection that lacks a row is failed, and nothing after it is moved."""
    whole = collection.write_collection
    monkeypatch.setattr(collection, "write_collection", lambda rows, path, **options: whole(rows.where("NOT (collection = 'b' AND vector_id = 'b3')"), path, **options))
    legacy = spark.createDataFrame([(c, f"{c}{i}", "o", "chat") for c in "abc" for i in range(5)], "collection string, vector_id string, owner_id string, conversation_id string")
    report = collection.migrate(legacy, legacy.where("false"), new_folder(spark, "migrated"), dry_run=False)
    assert [(r.collection, r.status) for r in report.collect()] == [("a", "migrated"), ("b", "failed")]
    totals = collection.migration_totals(report).first()
    assert (totals.failed, totals.verdict) == (1, "FAIL")


def test_repeated_requests_stay(spark):
    chats = spark.createDataFrame([("o1", "c1", False), ("o2", "c1", False), ("o2", "c2", True)], "owner_id string, chat_id string, is_deleted boolean")
    asks = spark.createDataFrame([(1, "o1", "c1"), (2, "o1", "c1"), (3, "o1", "c2"), (4, None, "c1"), (5, "o1", None)], "n int, owner_id string, chat_id string")
    assert {r.n: r.reason for r in search.ownership(asks, chats).collect()} == {1: "ok", 2: "ok", 3: "deleted", 4: "not_owned", 5: "not_found"}


def test_long_phone_numbers_keep_their_digits(spark):
    number = "+" + "1" * 3000
    row = spark.createDataFrame([(number,)], "p string").select(phone.problem(F.col("p")).alias("why"), phone.masked(F.col("p")).alias("shown")).first()
    assert row.why == "too_long" and row.shown.endswith("1111")


def test_texts_to_embed_are_not_held_as_objects(spark):
    """Batches stay Arrow; the model is given a few texts at once, and keys keep their vectors over several of its calls."""
    rows = spark.createDataFrame([(i, f"word{i} x" if i % 4 else None) for i in range(50)], "id int, text string")

    def load():
        model = embed.hashing_embedder(8)

        def few(texts):
            assert len(texts) <= 3
            return model(texts)

        return few

    out = embed.embed(rows, load, 8, batch=3)
    assert "MapInArrow" in out._jdf.queryExecution().toString()
    model = embed.hashing_embedder(8)
    for r in out.collect():
        want = model([r.text])[0] if r.text else [0.0] * 8
        assert all(abs(a - b) < 1e-6 for a, b in zip(r.embedding, want, strict=True))
