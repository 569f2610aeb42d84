"""SQL (DuckDB) of the queries that SQL can express: joins, windows and recursion over the whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"


JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_lower("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) USING (doc_id)"""

CONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_lower("text")}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_lower("text")}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
       FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
f AS (SELECT doc_id, item_id, dw.k, i FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
h AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM f) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT doc_id, item_id FROM f) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

_PIECES = r"len(regexp_extract_all(coalesce({}, ''), '\p{{L}}+|\p{{N}}|[^\x09-\x0D\x20\p{{L}}\p{{N}}]+'))"
_HARD = "<|im_end|><|im_start|>assistant ok"

CHAT = rf"""
WITH RECURSIVE src AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, 0, 'user', '{_HARD}' UNION ALL SELECT -1, 1, 'assistant', '{_HARD}'),
a AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS idx, coalesce(role, '') AS role, coalesce(text, '') AS text,
      {_PIECES.format("role")} + {_PIECES.format("text")} + 4 AS n FROM src),
e AS (SELECT *, idx = 1 AND role = 'system' AS lead, 12 + 10 + 2 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS len FROM a),
p AS (SELECT *, sum(CASE WHEN lead THEN 0 ELSE n END) OVER (PARTITION BY conv_id ORDER BY idx) AS p, 2048 - 256 - max(CASE WHEN lead THEN n ELSE 0 END) OVER (PARTITION BY conv_id) AS room,
      bool_or(lead) OVER (PARTITION BY conv_id) AS has, count(*) OVER (PARTITION BY conv_id) AS turns FROM e),
q AS (SELECT *, p - CASE WHEN lead THEN 0 ELSE n END AS q FROM p),
s AS (SELECT conv_id, idx, idx AS first, q AS base FROM q WHERE idx = CASE WHEN has AND turns > 1 THEN 2 ELSE 1 END
      UNION ALL SELECT q.conv_id, q.idx, CASE WHEN q.p - s.base > q.room THEN q.idx ELSE s.first END, CASE WHEN q.p - s.base > q.room THEN q.q ELSE s.base END
      FROM s JOIN q ON q.conv_id IS NOT DISTINCT FROM s.conv_id AND q.idx = s.idx + 1),
win AS (SELECT conv_id, first, max(idx) AS last, min(base) AS base FROM s GROUP BY ALL),
size AS (SELECT win.conv_id, sum(q.len) AS chars FROM win JOIN q ON q.conv_id IS NOT DISTINCT FROM win.conv_id
         AND (q.lead OR q.idx BETWEEN first AND last OR (NOT q.lead AND q.idx < first AND q.q >= base - 256)) GROUP BY ALL),
dig AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx)) AS turns_sha256,
        coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY idx), '') AS learnt FROM a GROUP BY conv_id)
SELECT dig.conv_id, n_turns::BIGINT AS n_turns, turns_sha256, length(learnt)::BIGINT AS loss_chars, sha256(learnt) AS loss_sha256, chars::BIGINT AS formatted_chars
FROM dig JOIN size ON size.conv_id IS NOT DISTINCT FROM dig.conv_id"""

FIXITY = r"""
WITH b AS (SELECT page_id, regexp_replace(coalesce(url, ''), '[\r\n]', '', 'g') AS uri, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') AS block FROM pages),
t AS (SELECT page_id, '>' || nl || 'WARC-Date: 2020-01-01T00:00:00Z' || nl || 'WARC-Target-URI: ' || uri || nl || 'Content-Type: application/http; msgtype=response' || nl || 'WARC-Block-Digest: sha256:' || sha256(block) || nl
             || 'Content-Length: ' || strlen(block) || nl || nl || block || nl || nl AS tail FROM b, (SELECT chr(13) || chr(10) AS nl)),
g AS (SELECT page_id, tail, sha256(tail) AS digest, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:' AS head FROM t),
p AS (SELECT *, row_number() OVER (ORDER BY page_id NULLS FIRST, digest) - 1 AS position, (strlen(head) + 36 + strlen(tail))::BIGINT AS length FROM g),
u AS (SELECT *, position // 1024 AS segment, md5(position || ':' || digest) AS m FROM p),
r AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY segment ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
             encode(head || m[1:8] || '-' || m[9:12] || '-3' || m[14:16] || '-8' || m[18:20] || '-' || m[21:32] || tail) AS record, (position * 31 + 5) % 97 AS fault FROM u)
SELECT position::BIGINT AS position, page_id, segment::BIGINT AS segment, start, length, sha256(record) AS sha256,
       CASE fault WHEN 1 THEN sha256(record[1:octet_length(record) - 5] || '!'::BLOB || record[octet_length(record) - 3:octet_length(record)]) WHEN 2 THEN sha256(record[1:octet_length(record) - 1]) END AS replica_sha256,
       CASE fault WHEN 1 THEN 'altered' WHEN 2 THEN 'truncated' ELSE 'missing' END AS fault
FROM r WHERE fault IN (1, 2, 3)"""

SQL = {
    "op5_ngram_jaccard": JACCARD,
    "op6_decontaminate": CONTAMINATION,
    "op7_chat_windows": CHAT,
    "op9_warc_fixity": FIXITY,
}
