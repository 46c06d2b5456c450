"""SQL twins of the operators that SQL can express, for whole tables of modest size."""

from __future__ import annotations

from parlance.llm import mixing, warc

_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REACH = """reach AS (
  SELECT a AS id, a AS c FROM links UNION SELECT b, b FROM links
  UNION
  SELECT e.b, r.c FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) e ON e.a = r.id
),
parts AS (SELECT id, min(c) AS component FROM reach GROUP BY id)"""

SUFFIX = """
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
places AS (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM bytes),
strings AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM places),
least AS (SELECT s, min(doc_id) AS lo FROM strings GROUP BY s),
hits AS (SELECT doc_id, i FROM strings JOIN least USING (s) WHERE lo < doc_id),
marked AS (
  SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS opens FROM hits
),
numbered AS (SELECT doc_id, i, count(*) FILTER (opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs
),
cut AS (
  SELECT g.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS tail,
    string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM gaps g JOIN bytes USING (doc_id) GROUP BY g.doc_id
)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head || substr(x, 2 * tail + 1), x))) AS kept_sha256
FROM bytes LEFT JOIN cut USING (doc_id)
"""

WINDOWS = f"""
WITH texts AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
places AS (SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS i FROM texts),
windows AS (SELECT doc_id, i, array_to_string(ws[i + 1 : i + 50], ' ') AS w FROM places),
least AS (SELECT w, min(doc_id) AS lo FROM windows GROUP BY w),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM windows JOIN least USING (w) WHERE lo < doc_id
),
lists AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(len(js), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN js IS NULL THEN ws
    ELSE list_filter(ws, lambda x, k: NOT list_contains(js, k - 1)) END, ' ')) AS kept_sha256
FROM texts LEFT JOIN lists USING (doc_id)
"""

MINHASH = f"""
WITH RECURSIVE texts AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) >= 5
      THEN list_distinct(list_transform(range(0, len(ws) - 4), lambda i: array_to_string(ws[i + 1 : i + 5], ' ')))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s
  FROM texts
),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y ON x.t = y.t AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
),
{_REACH}
SELECT doc_id, len(s) AS n_shingles, coalesce(component, doc_id) AS component_id,
  coalesce(component, doc_id) = doc_id AS kept
FROM sets LEFT JOIN parts ON id = doc_id
"""

VECTORS = f"""
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.label = y.label AND x.vec_id < y.vec_id
  WHERE len(x.v) = len(y.v) AND list_dot_product(x.v, y.v)
    / sqrt(list_dot_product(x.v, x.v)) / sqrt(list_dot_product(y.v, y.v)) >= 0.98
),
counts AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) GROUP BY id),
{_REACH}
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id,
  coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN parts p ON p.id = vec_id LEFT JOIN counts k ON k.id = vec_id
"""

SEARCH = f"""
WITH found AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws
  FROM documents
),
known AS (SELECT doc_id, r, len(ws)::BIGINT AS n, ws FROM found WHERE len(ws) > 0),
sizes AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM known),
counts AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM known) GROUP BY r, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), sizes
),
norms AS (SELECT doc_id, r, 50 + (50 * n * docs) // total AS m FROM known, sizes),
impacts AS (
  SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * m)) AS x FROM counts JOIN norms USING (r) JOIN weights USING (term)
),
items AS (SELECT item_id, text, row_number() OVER () AS q FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (SELECT DISTINCT item_id, q, unnest(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM items),
scores AS (SELECT item_id, q, r, doc_id, sum(x)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY item_id, q, r, doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

REPAIR = r"""
WITH RECURSIVE bits AS (SELECT range AS b, range AS c, 0 AS k FROM range(256)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS x
  FROM conversations
),
kinds AS (
  SELECT n.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2),
      lambda i: (16 * (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) + instr('0123456789ABCDEF', x[2 * i + 2]) - 1)::BIGINT)),
    lambda c, d: xor(c >> 8, t[(xor(c, d) & 255) + 1])), 4294967295) % 20 AS kind
  FROM named n, crc
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0
),
places AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
    rtrim(text, E' \t\n\x0b\x0c\r') AS t, left(role, 1) AS initial
  FROM damaged
),
faults AS (
  SELECT *, CASE WHEN t = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
    WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM places
),
totals AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faults GROUP BY conv_id
),
jumps(a, ins, b) AS (VALUES (0, '', 0), (0, 'I', 2), (0, 'II', 3), (1, '', 1), (1, 'I', 2), (1, 'II', 3),
  (2, '', 2), (2, 'I', 3), (2, 'II', 2), (3, '', 3), (3, 'I', 2), (3, 'II', 3)),
steps(b, letter, z) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
best(conv_id, i, state, price) AS (
  SELECT conv_id, 0::BIGINT, 0, '00000000' FROM totals
  UNION ALL
  SELECT conv_id, i, state, min(price) FROM (
    SELECT w.conv_id, w.i + 1 AS i, m.z AS state, printf('%08d', substr(price, 1, 8)::BIGINT + m.cost
      + CASE WHEN m.edit <> 'D' AND f.fault = 't' THEN 5 ELSE 0 END) || substr(price, 9) || m.ins || m.edit AS price
    FROM best w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
    JOIN (
      SELECT a, '' AS ins, 'D' AS edit, a AS z, 2 AS cost, NULL AS letter FROM jumps WHERE ins = ''
      UNION ALL SELECT a, ins, 'K', z, 5 * length(ins), letter FROM jumps JOIN steps USING (b)
      UNION ALL SELECT a, ins, 'R', z, 5 * length(ins) + 1, letter FROM jumps JOIN steps USING (b) WHERE letter <> 's'
    ) m ON m.a = w.state
    WHERE m.edit = 'D' OR (f.fault NOT IN ('b', 'd') AND (m.edit = 'K') = (m.letter = f.initial))
  ) GROUP BY conv_id, i, state
),
ends AS (
  SELECT w.conv_id, min(printf('%08d', substr(price, 1, 8)::BIGINT + 5 * length(ins)) || substr(price, 9) || ins) AS price
  FROM best w JOIN totals t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.n = w.i
  JOIN jumps ON a = state AND b IN (0, 3) GROUP BY w.conv_id
),
audits AS (SELECT conv_id, substr(price, 1, 8)::BIGINT AS cost, substr(price, 9) AS audit FROM ends),
edits AS (
  SELECT conv_id, p, audit[p] AS edit, length(translate(audit[1:p], 'I', '')) AS i, length(translate(audit[1:p], 'D', '')) AS j,
    length(translate(audit, 'D', '')) % 2 AS odd
  FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS p FROM audits)
),
repaired AS (
  SELECT e.conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (j - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, E'\n' ORDER BY p) AS lines
  FROM edits e LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i WHERE edit <> 'D' GROUP BY e.conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN totals t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""

ORACLE = {
    "op1_suffix_array_dedup": SUFFIX,
    "op4_embedding_near_dedup": VECTORS,
    "op6_minhash_near_dedup": MINHASH,
    "op8_warc_revisits": warc.ORACLE,
    "op9_substring_dedup": WINDOWS,
    "op10_mix_sources": mixing.ORACLE,
    "op11_lexical_search": SEARCH,
    "op12_conversation_repair": REPAIR,
}
