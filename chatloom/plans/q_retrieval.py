"""Search: scope, nearest neighbours, filters, sources, citations, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatloom.operators import embed, rag, search, snippet, vector_index
from chatloom.plans.q_text import _SEGMENTS, snippet_sql
from chatloom.plans.sql_tables import with_tables
from chatloom.scratch import new_folder
from chatloom.sources import tables

SYSTEM = "Answer from the context only."
_PLAIN = ("query_id", "owner_id", "query_vector", "top_k")


def _hits(spark, sf_dir, columns=(), metric="cosine", **options):
    queries = tables.query_vectors(spark, sf_dir).select(*_PLAIN, *columns)
    return queries, search.knn(tables.chunks(spark, sf_dir), queries, metric, **options)


def _thin(hits):
    return hits.select("query_id", "vector_id", "rank", "similarity", "low_confidence")


def knn_cosine_topk(spark, sf_dir):
    return _thin(_hits(spark, sf_dir)[1])


def knn_l2(spark, sf_dir):
    return _thin(_hits(spark, sf_dir, metric="l2")[1])


def knn_ip(spark, sf_dir):
    return _thin(_hits(spark, sf_dir, metric="ip", threshold=0.2)[1])


def scoped_knn(spark, sf_dir):
    return _thin(_hits(spark, sf_dir, ("source",))[1])


def time_window_knn(spark, sf_dir):
    return _thin(_hits(spark, sf_dir, ("time_from", "time_to"))[1])


def time_postfilter_knn(spark, sf_dir):
    return _thin(_hits(spark, sf_dir, ("time_from", "time_to"), time_mode="post")[1])


def knn_matrix(spark, sf_dir):
    return search.knn_by_matrix(tables.chunks(spark, sf_dir), tables.query_vectors(spark, sf_dir))


def knn_lsh(spark, sf_dir):
    return search.knn_lsh(tables.chunks(spark, sf_dir), tables.query_vectors(spark, sf_dir))


def knn_ivf(spark, sf_dir):
    """All queries against the inverted-file index, whose quantisers are fitted and whose rows are written first."""
    index = vector_index.build(tables.chunks(spark, sf_dir), new_folder(spark, "vector-index"))
    return vector_index.search(index, tables.query_vectors(spark, sf_dir).select(*_PLAIN))


def metadata_filter(spark, sf_dir):
    keep = search.metadata_filter({"token_count": {"$gte": 100}, "chunk_index": {"$lt": 3}, "contains_images": False, "message_count": {"$ne": 2}})
    return tables.chunks(spark, sf_dir).where(keep).select("vector_id", "token_count", "chunk_index", "message_count")


def _conditions(spark, sf_dir):
    """Three conditions for each document: fields, operators and values' kinds in turn, most of them with a mistake."""
    d, at = F.col("doc_id"), F.col("at")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    rows = tables.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("at"))
    return rows.select(F.concat(F.lit("r"), d).alias("request_id"), pick(_CONDITION_FIELDS, d + at * F.floor(d / 7) % 5).alias("field"), pick(_CONDITION_OPERATORS, d + at * 2).alias("operator"), pick(_CONDITION_KINDS, F.floor(d / 3) + at).alias("kind"))


_CONDITION_FIELDS = ("chunk_index", "source_chat", "contains_images", "token_count", "colour", "end_timestamp", "message_count")
_CONDITION_OPERATORS = ("$eq", "$gte", "$in", "$ne", "$lt")
_CONDITION_KINDS = ("number", "string", "boolean")


def condition_errors(spark, sf_dir):
    return search.validate_conditions(_conditions(spark, sf_dir)).select("request_id", "field", "operator", "kind", "error")


def condition_counts(spark, sf_dir):
    return search.condition_counts(search.validate_conditions(_conditions(spark, sf_dir)))


def visible_chunks(spark, sf_dir):
    return tables.chunks(spark, sf_dir).where(search.not_deleted()).groupBy("source", "is_deleted").agg(F.count(F.lit(1)).alias("n"))


def _requests(spark, sf_dir):
    chats = tables.chats(spark, sf_dir)
    n = F.substring("chat_id", 6, 20).cast("long")
    asked = F.when(n % 4 == 3, F.concat(F.lit("owner_"), (n + 1) % 5)).otherwise(F.col("owner_id"))
    return chats.select(asked.alias("owner_id"), F.when(n % 6 == 5, F.concat(F.lit("gone_"), n)).otherwise(F.col("chat_id")).alias("chat_id"))


def ownership_reason(spark, sf_dir):
    return search.ownership(_requests(spark, sf_dir), tables.chats(spark, sf_dir))


def request_errors(spark, sf_dir):
    n = F.substring("chat_id", 6, 20).cast("long")
    asks = tables.chats(spark, sf_dir).select(
        F.col("chat_id").alias("request_id"), F.when(n % 9 == 0, F.lit(" ")).otherwise(F.lit("telegram")).alias("source"), F.when(n % 2 == 0, F.col("chat_id")).alias("conversation_id"),
        F.when(n % 4 == 0, F.array("chat_id")).alias("conversation_ids"), F.element_at(F.array(F.lit("pdf"), F.lit("text"), F.lit("spreadsheet")), (n % 3 + 1).cast("int")).alias("content_type"),
        F.when(n % 5 == 0, F.lit("yesterday")).otherwise(F.lit("2024-01-05T00:00:00Z")).alias("from_time"))
    return search.validate_requests(asks).select("request_id", "error")


def no_strong_match(spark, sf_dir):
    queries, hits = _hits(spark, sf_dir, ("time_from", "time_to"))
    return search.no_strong_match(queries, hits)


def chat_sources(spark, sf_dir):
    queries = tables.query_vectors(spark, sf_dir).select("query_id", "owner_id", "query_vector", F.lit(40).alias("top_k"))
    hits = search.knn(tables.chunks(spark, sf_dir), queries).withColumn("content_type", F.lit("text"))
    return rag.sources(hits)


def citations(spark, sf_dir):
    hits = _hits(spark, sf_dir)[1]
    at = lambda minutes: F.date_format(F.timestamp_seconds(F.unix_timestamp("ts") + minutes * 60), "yyyy-MM-dd HH:mm:ss")
    times = {"start_timestamp": F.when(F.col("chunk_index") != 1, at(F.lit(0))), "end_timestamp": F.when(F.col("chunk_index") % 2 == 0, F.concat(at(F.col("chunk_index")), F.lit(" ")))}
    return rag.citations(hits.withColumns(times))


def context_budget(spark, sf_dir):
    contexts = rag.context(_hits(spark, sf_dir)[1], budget_tokens=1500)
    return contexts.select("query_id", "n_documents", "chars", F.md5(F.coalesce("context", F.lit(""))).alias("context_md5"), "error")


def confidence(spark, sf_dir):
    return rag.confidence(*_hits(spark, sf_dir))


def prompt_rows(spark, sf_dir):
    queries = tables.query_vectors(spark, sf_dir)
    made = rag.prompts(queries, rag.context(_hits(spark, sf_dir)[1]), SYSTEM)
    return made.select("query_id", "system", F.md5("user").alias("user_md5"))


def answer_bundle(spark, sf_dir):
    """Retrieval end to end: scope, time, search, confidence, sources."""
    queries, hits = _hits(spark, sf_dir, ("source", "time_from", "time_to"))
    strong = search.no_strong_match(queries, hits)
    srcs = rag.sources(hits).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_sources"), F.min_by("vector_id", "position").alias("first_source"))
    return strong.join(rag.confidence(queries, hits), "query_id").join(srcs, "query_id", "left").fillna({"n_sources": 0})


DIM = 64


def _embedded(spark, sf_dir):
    """Chunks and questions, both embedded by the stand-in model, and the chunks without vectors."""
    model = lambda: embed.hashing_embedder(DIM)
    texts = tables.chunks(spark, sf_dir).drop("embedding")
    chunks = embed.embed(texts, model, DIM)
    asked = tables.query_vectors(spark, sf_dir).select("query_id", "owner_id", "top_k", "question")
    ready = asked.withColumn("prepared", snippet.preprocess(F.col("question")))
    return chunks, embed.embed(ready, model, DIM, text="prepared").withColumnRenamed("embedding", "query_vector").drop("prepared"), texts


def question_search(spark, sf_dir):
    """From a question to its hits: preparation, embedding, search."""
    chunks, queries, texts = _embedded(spark, sf_dir)
    return _thin(search.knn(chunks, queries, texts=texts))


def question_sources(spark, sf_dir):
    """The whole way: question, embedding, search, the snippet of each hit, and the sources that show it."""
    chunks, queries, texts = _embedded(spark, sf_dir)
    hits = search.knn(chunks, queries, texts=texts)
    keys = ["query_id", "vector_id"]
    cut = snippet.snippets(hits.join(queries.select("query_id", "question"), "query_id").select(*keys, "question", "text"), keys).select(*keys, "focused_snippet")
    return rag.sources(hits.join(cut, keys, "left"))


def retrieval_report(spark, sf_dir):
    from chatloom.operators import views

    return views.retrieval_report(*_hits(spark, sf_dir, ("source", "time_from", "time_to")))


QUERIES = {q.__name__: q for q in (
    knn_cosine_topk, knn_l2, knn_ip, scoped_knn, time_window_knn, time_postfilter_knn, knn_matrix, knn_lsh, knn_ivf, metadata_filter, condition_errors, condition_counts, visible_chunks, ownership_reason,
    request_errors, no_strong_match, chat_sources, citations, context_budget, confidence, prompt_rows, answer_bundle, question_search, question_sources, retrieval_report)}

_IN_TIME = "(q.time_from IS NULL OR c.ts >= q.time_from) AND (q.time_to IS NULL OR c.ts <= q.time_to)"
_IN_SOURCE = "(q.source IS NULL OR c.source = q.source)"
_DISTANCE = {
    "cosine": "1.0 - list_dot_product(c.embedding::DOUBLE[], q.query_vector::DOUBLE[]) / (sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])) * sqrt(list_dot_product(q.query_vector::DOUBLE[], q.query_vector::DOUBLE[])))",
    "l2": "list_distance(c.embedding::DOUBLE[], q.query_vector::DOUBLE[])", "ip": "list_dot_product(c.embedding::DOUBLE[], q.query_vector::DOUBLE[])",
}
_SIMILARITY = {"cosine": "1.0 - distance", "l2": "1.0 / (1.0 + distance)", "ip": "distance"}


def _hits_sql(metric="cosine", scope="true", k="top_k", post="true", threshold=0.0):
    """Expressions that end in ``hits``."""
    order = "distance DESC" if metric == "ip" else "distance"
    return f"""scored AS (
  SELECT q.query_id, q.top_k, q.time_from, q.time_to, c.*, round({_DISTANCE[metric]}, 9) AS distance
  FROM chunks c JOIN query_vectors q ON c.owner_id = q.owner_id AND NOT (c.source = 'telegram' AND c.is_deleted) AND {scope}
), placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}, vector_id) AS place FROM scored QUALIFY place <= {k}),
kept AS (
  SELECT *, round(greatest(0.0, least(1.0, {_SIMILARITY[metric]})), 6) AS similarity FROM placed
  WHERE {post} AND round(greatest(0.0, least(1.0, {_SIMILARITY[metric]})), 6) >= {threshold} AND trim(coalesce(text, '')) <> ''
), hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank, similarity < 0.4 AS low_confidence FROM kept QUALIFY rank <= top_k
)"""


def _knn_sql(**options):
    return with_tables("chunks", "query_vectors", more=_hits_sql(**options)) + "SELECT query_id, vector_id, rank, similarity, low_confidence FROM hits"


def _over_hits(select, *, more="", **options):
    return with_tables("chunks", "query_vectors", more=_hits_sql(**options) + (", " + more if more else "")) + select


def _vectors_sql(name, table, key, text):
    return rf"""{name}_n AS (SELECT {key}, CAST('0x' || md5(w)[1:8] AS BIGINT) % {DIM} AS d, count(*) AS n FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[^\x20\x09-\x0D]+')) AS w FROM {table}) GROUP BY 1, 2),
{name}_l AS (SELECT {key}, sqrt(CAST(sum(n * n) AS DOUBLE)) AS len FROM {name}_n GROUP BY 1), {name}_v AS (SELECT {key}, list(CAST(coalesce(n, 0) / len AS FLOAT) ORDER BY d) AS vector FROM {name}_l CROSS JOIN (SELECT unnest(range({DIM})) AS d) LEFT JOIN {name}_n USING ({key}, d) GROUP BY 1),
{name}_e AS (SELECT t.* EXCLUDE (__V__), coalesce(vector, list_transform(range({DIM}), lambda x: CAST(0 AS FLOAT))) AS __V__ FROM {table} t LEFT JOIN {name}_v USING ({key}))"""


_QUESTIONS = _vectors_sql("c", "chunks", "vector_id", "text").replace("__V__", "embedding") + ",\n" + _vectors_sql("q", "query_vectors", "query_id", "question").replace("__V__", "query_vector") + ",\n"
_POST = "(time_from IS NULL OR ts >= time_from) AND (time_to IS NULL OR ts <= time_to)"
_BLOCK = """'[Document ' || rank || ']' || chr(10) || 'Similarity : ' || format('{:.4f}', similarity) || chr(10) || 'ID         : ' || vector_id || chr(10)
  || 'Source     : ' || coalesce(nullif(trim(conversation_title), ''), 'Unknown') || chr(10) || 'Timestamp  : N/A' || chr(10) || 'Chunk      : ' || chunk_index || chr(10) || chr(10) || text"""


def _context_sql(budget, select):
    return _over_hits(select, more=f"""blocks AS (SELECT query_id, rank, {_BLOCK} AS block FROM hits),
summed AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM blocks),
contexts AS (SELECT query_id, count(*) FILTER (used <= {budget}) AS n_documents, CAST(coalesce(max(used) FILTER (used <= {budget}), 0) AS BIGINT) AS chars,
  string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) FILTER (used <= {budget}) AS context FROM summed GROUP BY query_id)""")


_CONFIDENCE = "SELECT q.query_id, round(coalesce(avg(similarity), 0), 6) AS confidence FROM query_vectors q LEFT JOIN hits h USING (query_id) GROUP BY q.query_id"
_STRONG = "SELECT q.query_id, count(h.query_id) AS n_hits, coalesce(bool_and(low_confidence), true) AS no_strong_match FROM query_vectors q LEFT JOIN hits h USING (query_id) GROUP BY q.query_id"


def _sources_sql(content_type="'text'"):
    return f"""choices AS (SELECT *, account_id || ':' || conversation_id || ':' || source_message_id || ':' || {content_type} AS source_key FROM hits),
chosen AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_key ORDER BY similarity DESC, rank) AS choice, min(rank) OVER (PARTITION BY query_id, source_key) AS first_rank FROM choices QUALIFY choice = 1),
sources AS (SELECT query_id, vector_id, row_number() OVER (PARTITION BY query_id ORDER BY first_rank) AS position, conversation_id, source_message_id AS message_id, {content_type} AS content_type, similarity AS score FROM chosen)"""


_QUESTION_HITS = _QUESTIONS + _hits_sql().replace("FROM chunks c JOIN query_vectors q", "FROM c_e c JOIN q_e q").replace("1.0 - list_dot_product", "CASE WHEN list_sum(c.embedding) = 0 OR list_sum(q.query_vector) = 0 THEN 1.0 ELSE 1.0 - list_dot_product").replace("q.query_vector::DOUBLE[])))", "q.query_vector::DOUBLE[]))) END")
#: Messages of the chunks that were hit, and the snippet of each hit.
_HIT_SNIPPETS = "hit_texts AS (SELECT DISTINCT vector_id, text FROM hits),\n" + _SEGMENTS.replace("chat_lines", "hit_texts").replace("conv_id", "vector_id") + ",\nasked AS (SELECT h.query_id, h.vector_id AS key, q.question FROM hits h JOIN query_vectors q USING (query_id)),\n" + snippet_sql("parsed", "asked", "s.vector_id = t.key")

_REQUESTS = """requests AS (SELECT CASE WHEN n % 4 = 3 THEN 'owner_' || (n + 1) % 5 ELSE owner_id END AS owner_id, CASE WHEN n % 6 = 5 THEN 'gone_' || n ELSE chat_id END AS chat_id
FROM (SELECT *, CAST(substr(chat_id, 6) AS BIGINT) AS n FROM chats))"""

_LIST = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
_CONDITIONS = f"""WITH rows AS (SELECT doc_id, unnest([0, 1, 2]) AS nth FROM documents), conditions AS (SELECT 'r' || doc_id AS request_id, {_LIST(_CONDITION_FIELDS)}[CAST((doc_id + nth * (doc_id // 7) % 5) % 7 + 1 AS INT)] AS field,
  {_LIST(_CONDITION_OPERATORS)}[CAST((doc_id + nth * 2) % 5 + 1 AS INT)] AS operator, {_LIST(_CONDITION_KINDS)}[CAST((doc_id // 3 + nth) % 3 + 1 AS INT)] AS kind FROM rows),
wanted AS (SELECT *, CASE WHEN field IN ('source_chat', 'end_timestamp') THEN 'string' WHEN field = 'contains_images' THEN 'boolean' WHEN field <> 'colour' THEN 'number' END AS want, count(*) OVER (PARTITION BY request_id, field) AS n FROM conditions),
judged AS (SELECT request_id, field, operator, kind, CASE WHEN want IS NULL THEN 'unknown field' WHEN n > 1 THEN 'more than one operator' WHEN operator = '$in' THEN 'unknown operator' WHEN want <> kind THEN 'wrong kind of value'
  WHEN operator IN ('$gte', '$lt') AND want <> 'number' THEN 'ordered comparison of what isn''t a number' END AS error FROM wanted)
"""

ORACLE_SQL = {
    "condition_errors": _CONDITIONS + "SELECT * FROM judged",
    "condition_counts": _CONDITIONS + "SELECT request_id, count(*) AS n_conditions, bool_and(error IS NULL) AS usable FROM judged GROUP BY 1",
    "knn_cosine_topk": _knn_sql(),
    "knn_l2": _knn_sql(metric="l2"),
    "knn_ip": _knn_sql(metric="ip", threshold=0.2),
    "scoped_knn": _knn_sql(scope=_IN_SOURCE),
    "time_window_knn": _knn_sql(scope=_IN_TIME),
    "time_postfilter_knn": _knn_sql(k="least(greatest(4 * top_k, 20), 200)", post=_POST),
    "knn_matrix": _over_hits("SELECT query_id, vector_id, similarity, rank FROM hits"),
    "question_search": with_tables("chunks", "query_vectors", more=_QUESTION_HITS) + "SELECT query_id, vector_id, rank, similarity, low_confidence FROM hits",
    "question_sources": with_tables("chunks", "query_vectors", more=_QUESTION_HITS + ",\n" + _HIT_SNIPPETS + ",\n" + _sources_sql("content_type")) + """SELECT s.*, substr(coalesce(nullif(o.focused_snippet, ''), c.text, ''), 1, 200) AS snippet
      FROM sources s JOIN chunks c USING (vector_id) LEFT JOIN cut_out o ON o.query_id = s.query_id AND o.key = s.vector_id""",
    "metadata_filter": with_tables("chunks") + "SELECT vector_id, token_count, chunk_index, message_count FROM chunks WHERE token_count >= 100 AND chunk_index < 3 AND NOT contains_images AND message_count <> 2",
    "visible_chunks": with_tables("chunks") + "SELECT source, is_deleted, count(*) AS n FROM chunks WHERE NOT (source = 'telegram' AND is_deleted) GROUP BY ALL",
    "ownership_reason": with_tables("chats", more=_REQUESTS) + """SELECT r.owner_id, r.chat_id, CASE WHEN c.chat_id IS NULL THEN 'not_found' WHEN c.is_deleted THEN 'deleted' WHEN c.owner_id <> r.owner_id THEN 'not_owned' ELSE 'ok' END AS reason,
      reason = 'ok' AS allowed FROM (SELECT DISTINCT * FROM requests) r LEFT JOIN chats c ON r.chat_id = c.chat_id""",
    "request_errors": with_tables("chats") + """SELECT chat_id AS request_id, CASE WHEN n % 9 = 0 THEN 'blank source' WHEN n % 4 = 0 THEN 'both conversation_id and conversation_ids' WHEN n % 3 = 2 THEN 'unknown content_type'
      WHEN n % 5 = 0 THEN 'bad from_time' END AS error FROM (SELECT *, CAST(substr(chat_id, 6) AS BIGINT) AS n FROM chats)""",
    "no_strong_match": _over_hits(_STRONG, scope=_IN_TIME),
    "chat_sources": with_tables("chunks", "query_vectors", more=_hits_sql(k="40").replace("rank <= top_k", "rank <= 40") + ", " + _sources_sql()) + "SELECT s.*, substr(coalesce(text, ''), 1, 200) AS snippet FROM sources s JOIN chunks USING (vector_id)",
    "citations": _over_hits("SELECT query_id, rank, vector_id, similarity, coalesce(nullif(trim(conversation_title), ''), 'Unknown') AS source_chat, greatest(CAST(chunk_index AS INT), 0) AS chunk_index, CASE WHEN chunk_index <> 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE '' END AS start_timestamp, CASE WHEN chunk_index % 2 = 0 THEN strftime(ts + to_minutes(CAST(chunk_index AS BIGINT)), '%Y-%m-%d %H:%M:%S') ELSE '' END AS end_timestamp FROM hits"),
    "context_budget": _context_sql(6000, "SELECT query_id, n_documents, chars, md5(coalesce(context, '')) AS context_md5, CASE WHEN n_documents = 0 THEN 'the context budget is too small for the first document' END AS error FROM contexts"),
    "confidence": _over_hits(_CONFIDENCE),
    "prompt_rows": _context_sql(12000, f"SELECT query_id, '{SYSTEM}' AS system, md5('Context:' || chr(10) || context || chr(10) || chr(10) || 'Question:' || chr(10) || question) AS user_md5 FROM contexts JOIN query_vectors USING (query_id) WHERE n_documents > 0"),
    "answer_bundle": _over_hits(
        "SELECT s.*, confidence, coalesce(n_sources, 0) AS n_sources, first_source FROM strong s JOIN confidences USING (query_id) LEFT JOIN counted USING (query_id)", scope=f"{_IN_SOURCE} AND {_IN_TIME}",
        more=_sources_sql("content_type") + f", strong AS ({_STRONG}), confidences AS ({_CONFIDENCE}), counted AS (SELECT query_id, count(*) AS n_sources, min_by(vector_id, position) AS first_source FROM sources GROUP BY query_id)"),
    "retrieval_report": _over_hits("SELECT count(*) AS queries, count(*) FILTER (n > 0) AS with_hits, CAST(sum(n) AS BIGINT) AS hits FROM (SELECT q.query_id, count(h.query_id) AS n FROM query_vectors q LEFT JOIN hits h USING (query_id) GROUP BY 1)", scope=f"{_IN_SOURCE} AND {_IN_TIME}"),
}
