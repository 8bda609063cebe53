"""SQL (DuckDB) for the results of the queries that SQL can express."""

from __future__ import annotations

import string

from loomspark.llm import chat, suffix

_LOWER = f"translate({{}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def _escaped(x: str) -> str:
    return rf"regexp_replace({x}, '([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>|\|[a-z_]+\|>)', '\1\\\2\3', 'g')"


def chat_sql(budget: int = chat.BUDGET) -> str:
    order = "PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha"
    return rf"""WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT *, sha256(text) AS sha, '{chat.OPEN}' || {_escaped("role")} || '{chat.MIDDLE}' || {_escaped("text")} || '{chat.CLOSE}' AS piece FROM t),
n AS (SELECT *, (octet_length(encode(piece)) + 3) // 4 AS tokens, length(piece) AS chars FROM s),
o AS (SELECT *, row_number() OVER ({order}) - 1 AS pos, coalesce(sum(tokens) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n),
y AS (SELECT conv_id, min(pos) AS pos, arg_min(tokens, pos) AS tokens, arg_min(chars, pos) AS chars FROM o WHERE role = 'system' GROUP BY conv_id),
r AS (SELECT o.*, y.pos AS sys_pos, y.tokens AS sys_tokens, y.chars AS sys_chars,
  CASE WHEN {budget} - y.tokens >= {max(budget // 4, 1)} THEN least({budget} - y.tokens, {budget // 2}) ELSE {budget // 2} END AS room
  FROM o LEFT JOIN y ON o.conv_id IS NOT DISTINCT FROM y.conv_id),
c AS (SELECT *, (before + tokens - 1) // room AS cell, before // room <> (before + tokens - 1) // room AS across FROM r),
i AS (SELECT *, across AND tokens + coalesce(sum(tokens) FILTER (NOT across) OVER (PARTITION BY conv_id, cell), 0) > room AS apart FROM c),
h AS (SELECT *, lag(tokens, 1) OVER w AS t1, lag(role = 'system', 1) OVER w AS y1, lag(chars, 1) OVER w AS c1, lag(tokens, 2) OVER w AS t2, lag(role = 'system', 2) OVER w AS y2, lag(chars, 2) OVER w AS c2
  FROM i WINDOW w AS ({order})),
spans AS (SELECT conv_id, sum(chars) AS chars, {budget} - sum(tokens) AS free, arg_min(struct_pack(pos := pos, sys_pos := sys_pos, sys_tokens := sys_tokens, sys_chars := sys_chars, t1 := t1, y1 := y1, c1 := c1, t2 := t2, y2 := y2, c2 := c2), pos) AS l
  FROM h GROUP BY conv_id, cell, apart),
w AS (SELECT *, coalesce(l.sys_pos < l.pos AND l.sys_tokens <= free, false) AS with_system FROM spans),
b AS (SELECT *, least({budget // 4}, free - CASE WHEN with_system THEN l.sys_tokens ELSE 0 END) AS back FROM w),
k1 AS (SELECT *, coalesce(NOT l.y1 AND l.t1 <= back, false) AS take1 FROM b),
k2 AS (SELECT *, coalesce(NOT l.y2 AND (l.y1 OR take1) AND l.t2 + CASE WHEN take1 THEN l.t1 ELSE 0 END <= back, false) AS take2 FROM k1),
f AS (SELECT conv_id, count(*) AS n_windows, sum(chars + CASE WHEN with_system THEN l.sys_chars ELSE 0 END + CASE WHEN take1 THEN l.c1 ELSE 0 END + CASE WHEN take2 THEN l.c2 ELSE 0 END) AS formatted_chars FROM k2 GROUP BY conv_id),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS said, coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS loss FROM o GROUP BY conv_id)
SELECT g.conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars, n_windows
FROM g JOIN f ON g.conv_id IS NOT DISTINCT FROM f.conv_id"""


def decontaminate_sql(window: int = 10) -> str:
    words = rf"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    gram = "array_to_string(w[i:i+n-1], ' ')"
    return f"""WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), {window}) AS n FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
grams AS (SELECT DISTINCT item_id, n, {gram} AS gram FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
sizes AS (SELECT DISTINCT n FROM grams),
runs AS (SELECT doc_id, i, n, {gram} AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM runs JOIN grams USING (n, gram)),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS said FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(said, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""


def suffix_sql(length: int = suffix.LENGTH, block: int = 200) -> str:
    """Windows are cut out of blocks, so that no window costs the length of its text."""
    return f"""WITH t AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
windows AS (SELECT doc_id, s + k AS a, hash(substr(y, 2*k+1, {2 * length})) AS h FROM (
  SELECT doc_id, s, y, unnest(range(0, least({block}, length(y)//2 - {length - 1}))) AS k FROM (
  SELECT doc_id, s, substr(x, 2*s+1, {2 * (block + length - 1)}) AS y FROM (SELECT doc_id, x, unnest(range(0, greatest(length(x)//2 - {length - 1}, 0), {block})) AS s FROM t)))),
repeated AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
starts AS (SELECT doc_id, a, a > coalesce(lag(a) OVER (PARTITION BY doc_id ORDER BY a) + {length}, -1) AS fresh FROM windows WHERE h IN (SELECT h FROM repeated)),
gone AS (SELECT doc_id, min(a) AS a, max(a) + {length} AS b FROM (SELECT doc_id, a, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY a) AS run FROM starts) GROUP BY doc_id, run),
cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS e FROM gone),
kept AS (SELECT doc_id, sum(b - a) AS n, count(*) AS runs, max(b) AS last, string_agg(substr(x, 2*e+1, 2*(a-e)), '' ORDER BY a) AS head FROM cut JOIN t USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(kept.n, 0)::BIGINT AS n_removed, coalesce(runs, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, 2*coalesce(last, 0)+1))) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)"""


def minhash_sql(shingle: int = 5, percent: int = 75) -> str:
    words = rf"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+')"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {words} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i+{shingle - 1}], ' ')) AS h, array_to_string(w[i:i+{shingle - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {shingle - 1}, least(len(w), 1)) + 1)) AS i FROM d)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS m FROM s p JOIN s q ON p.h = q.h AND p.g = q.g AND p.doc_id <> q.doc_id GROUP BY ALL) x
  JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * m >= {percent} * (na.n + nb.n - m)),
cc(id, root) USING KEY (id) AS (
  SELECT doc_id, doc_id FROM documents UNION
  SELECT e.b, min(cc.root) FROM cc JOIN e ON cc.id = e.a JOIN recurring.cc AS o ON o.id = e.b WHERE cc.root < o.root GROUP BY e.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, cc.root AS component_id, d.doc_id = cc.root AS kept FROM d JOIN cc ON cc.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


def warc_sql() -> str:
    digit = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, 10 * (i // 8) + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31))::INT, 1)"
    return f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
f AS (SELECT h, max(page_id) AS first FROM d GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda i: {digit}), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN f USING (h)"""


ORACLES = {
    "op1_chat": chat_sql(),
    "op3_decontaminate": decontaminate_sql(),
    "op4_suffix_dedup": suffix_sql(),
    "op5_minhash": minhash_sql(),
    "op7_warc": warc_sql(),
}
