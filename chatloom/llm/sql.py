"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

op5_mix_sources = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS mix_order
  FROM documents
), sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
n_slots AS (SELECT greatest(262144, CAST(pow(2, ceil(log2(8 * count(*)))) AS BIGINT)) AS slots FROM sizes),
numbered AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS source_no FROM sizes),
weighed AS (
  SELECT *, CAST([5, 2, 1][(source_no - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * CAST(3 AS DOUBLE) AS cap FROM numbered
), levels AS (
  SELECT *, ((SELECT sum(source_size) FROM weighed) - coalesce(sum(cap) OVER before, 0))
          / ((SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_no, source_size, coalesce(least(cap, (SELECT max(level) FROM levels WHERE level * weight <= cap) * weight), cap) AS target
  FROM levels
), wanted AS (SELECT *, CAST(floor(target + 1e-6) AS BIGINT) AS words FROM targets
), widths AS (
  SELECT source_no, words, CAST(floor(greatest(words / sum(words) OVER (), least(CAST(64 AS DOUBLE) / (SELECT slots FROM n_slots), CAST(0.5 AS DOUBLE) / count(*) OVER ())) * 536870912) AS BIGINT) AS part
  FROM wanted WHERE words > 0
), cumulated AS (SELECT source_no, words, CAST(sum(part) OVER (ORDER BY source_no) AS BIGINT) AS upto, CAST(sum(part) OVER () AS BIGINT) AS parts FROM widths
), edges AS (
  SELECT source_no, words, upto * 4294967296 // parts AS hi, coalesce(lag(upto) OVER (ORDER BY source_no), 0) * 4294967296 // parts AS lo FROM cumulated
), points AS (
  SELECT slot, slot * 2654435769 % 4294967296 AS point FROM (SELECT unnest(range(slots)) AS slot FROM n_slots)
), takes AS (
  SELECT slot, source_no, row_number() OVER (PARTITION BY source_no ORDER BY slot) - 1 AS block, count(*) OVER (PARTITION BY source_no) AS slots_of
  FROM points JOIN edges ON point >= lo AND point < hi
), block_sizes AS (
  SELECT DISTINCT source_no, CAST(ceil(words / slots_of) AS BIGINT) AS width FROM takes JOIN edges USING (source_no)
), placed AS (
  SELECT d.*, w.source_no, w.source_size, w.target, w.words, row_number() OVER () AS row_no,
         CAST(sum(size) OVER (PARTITION BY w.source_no ORDER BY mix_order, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start
  FROM docs d JOIN wanted w ON d.source IS NOT DISTINCT FROM w.source
), rounds AS (
  SELECT p.*, coalesce(width, 1) AS width, start + r * source_size AS pos FROM placed p LEFT JOIN block_sizes USING (source_no), (SELECT unnest([0, 1, 2]) AS r)
), parts AS (
  SELECT *, unnest(range(pos // width, (pos + greatest(size, 1) - 1) // width + 1)) AS block FROM rounds
)
SELECT doc_id, size, source_size, target,
       CAST(sum(CASE WHEN slot IS NULL THEN 0 ELSE greatest(least(pos + size, (block + 1) * width, words) - greatest(pos, block * width), 0) END) AS BIGINT) AS taken, source,
       CAST(count(slot) FILTER (pos // width = block AND pos < words) AS BIGINT) AS starts, min(slot) FILTER (pos // width = block AND pos < words) AS first_slot
FROM parts LEFT JOIN takes USING (source_no, block)
GROUP BY row_no, doc_id, size, source_size, target, source
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
op2_ngram_jaccard_join = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, row_number() OVER () AS row_no, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT row_no, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT row_no, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT row_no, count(*) AS n FROM shingles GROUP BY row_no),
met AS (SELECT a.row_no AS a, b.row_no AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.row_no < b.row_no GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN sizes x ON x.row_no = a JOIN sizes y ON y.row_no = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT row_no, row_no AS other FROM words UNION SELECT r.row_no, l.b FROM reached r JOIN both_ways l ON r.other = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(o.doc_id) AS component_id
FROM words d LEFT JOIN sizes s USING (row_no) JOIN reached r USING (row_no) JOIN words o ON o.row_no = r.other GROUP BY d.row_no, d.doc_id, n
"""


def _quality_sql() -> str:
    """The figures, then as many rounds of expectation-maximisation as the operator makes, then the posterior."""
    from chatloom.llm import quality as q

    rules, k = q.RULES, range(1, len(q.RULES) + 1)
    votes = ", ".join(f"CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END" for r in rules)
    odds = "ln(good / (1 - good)) + " + " + ".join(f"CASE v[{i}] WHEN 1 THEN ln(og[{i}] / (1 - ob[{i}])) WHEN -1 THEN ln((1 - og[{i}]) / ob[{i}]) ELSE 0 END" for i in k)
    start_good, start_bad = q.START_ACCURACY
    rate = lambda p, right, start: [f"(sum(CASE WHEN v[{i}] = {right} THEN n * {p} ELSE 0 END) + {start} * w) / (sum(CASE WHEN v[{i}] <> 0 THEN n * {p} ELSE 0 END) + w)" for i in k]
    doubles = lambda x: f"[{', '.join(f'CAST({x} AS DOUBLE)' for _ in k)}]"
    return rf"""
WITH RECURSIVE texts AS (SELECT doc_id, row_number() OVER () AS row_no, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts),
runs AS (SELECT row_no, i, array_to_string(w[i : i + 4], ' ') AS run FROM (SELECT row_no, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM words)),
twice AS (SELECT row_no, i FROM runs QUALIFY count(*) OVER (PARTITION BY row_no, run) > 1),
covered AS (SELECT row_no, CAST(sum(c) AS BIGINT) AS n_repeat_words FROM (SELECT row_no, least(5, coalesce(lead(i) OVER (PARTITION BY row_no ORDER BY i) - i, 5)) AS c FROM twice) GROUP BY row_no),
figures AS (
  SELECT doc_id, row_no, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines, len(list_distinct(w)) AS n_distinct_words, coalesce(n_repeat_words, 0) AS n_repeat_words,
    length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS n_letters FROM words LEFT JOIN covered USING (row_no)
), voted AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, [{votes}] AS v FROM figures),
patterns AS (SELECT v, count(*) AS n FROM voted WHERE NOT base_failed GROUP BY v),
prior AS (SELECT {q.START_WEIGHT} + {q.PRIOR_SHARE} * CAST(coalesce(sum(n), 0) AS DOUBLE) AS w FROM patterns),
em AS (
  SELECT 0 AS round, CAST({q.START_GOOD} AS DOUBLE) AS good, {doubles(start_good)} AS og, {doubles(start_bad)} AS ob
  UNION ALL
  SELECT round + 1, (sum(n * p) + {q.START_GOOD} * w) / (sum(n) + w), [{', '.join(rate('p', 1, start_good))}], [{', '.join(rate('(1 - p)', -1, start_bad))}]
  FROM (SELECT round, v, n, w, 1 / (1 + exp(-({odds}))) AS p FROM em, patterns, prior WHERE round < {q.ROUNDS}) GROUP BY round, w
), judged AS (SELECT voted.*, 1 / (1 + exp(-({odds}))) AS quality FROM voted, em WHERE round = {q.ROUNDS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND quality >= {q.KEEP_FROM} AS kept, round(quality, 6) AS quality FROM judged
"""


op1_quality_rules = _quality_sql()

op13_hard_negatives = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS alike, list_inner_product(a.e, r.e)::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT s.alike AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY rank <= 3
"""

op12_prefix_trie = r"""
WITH own AS (
  SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS dg, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, dg) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, max(place) AS n, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda a, c:
           list_reduce(list_prepend(xor(a, c), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT) % 4 AS h
  FROM own GROUP BY conv_id
), openings AS (
  SELECT c.conv_id, o.place AS depth, o.dg, o.words FROM convs c JOIN own o ON o.conv_id = c.base AND o.place <= c.h
), befores AS (SELECT conv_id, count(*) AS before FROM openings GROUP BY conv_id),
seqs AS (
  SELECT * FROM openings
  UNION ALL
  SELECT o.conv_id, coalesce(b.before, 0) + o.place - c.h, o.dg, o.words FROM own o JOIN convs c USING (conv_id) LEFT JOIN befores b USING (conv_id) WHERE o.place > c.h
), keyed AS (
  SELECT conv_id, depth, words, string_agg(dg, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS k FROM seqs
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), paths AS (
  SELECT conv_id, depth, words, min(conv_id) OVER (PARTITION BY depth, k) AS node, max(depth) OVER (PARTITION BY conv_id) AS length FROM keyed
), above AS (
  SELECT p.*, q.node AS parent FROM paths p LEFT JOIN paths q ON q.conv_id = p.conv_id AND q.depth = p.depth - 1
), nodes AS (
  SELECT node, depth, any_value(parent) AS parent, count(*) AS n_convs, (count(*) - 1) * max(words) AS tokens,
         sha256(coalesce(string_agg(CASE WHEN depth = length THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM above GROUP BY node, depth
), children AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
filled AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (node, depth)),
totals AS (
  SELECT p.node, p.depth, count(*) FILTER (v.n_children = 0) AS n_leaves, sum(v.tokens) AS saved_tokens
  FROM filled v JOIN paths p ON p.conv_id = v.node AND p.depth <= v.depth GROUP BY 1, 2
)
SELECT node AS conv_id, CAST(depth AS BIGINT) AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM filled JOIN totals USING (node, depth)
"""

op11_chat_format = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, n, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r)
), sized AS (
  SELECT *, sha256(length(role) || ':' || role || text) AS dg,
         length(text) + len(regexp_extract_all(text, '\\|</?s>|\[/?INST\]|\[/?ROLE\]|\[TEXT\]')) AS body,
         length(role) + len(regexp_extract_all(role, '\\|</?s>|\[/?INST\]|\[/?ROLE\]|\[TEXT\]')) AS name
  FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, dg)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, dg) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(body + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 7 ELSE 22 + name END) AS BIGINT) AS formatted_chars, CAST(NULL AS BIGINT) AS rewritten_at
FROM sized GROUP BY conv_id
"""
