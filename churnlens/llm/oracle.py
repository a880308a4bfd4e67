"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

import string

_WORDS = (f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

DECONTAMINATE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bi AS (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, CASE WHEN len(w) < 10 THEN w ELSE w[i:i + 9] END AS x FROM bi),
m AS (SELECT DISTINCT len(x) AS m FROM bw),
dp AS (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, m),
dw AS (SELECT rid, s, m, w[s:s + m - 1] AS x FROM dp),
h AS (SELECT rid, s, m, item FROM dw JOIN bw USING (x)),
covered AS (SELECT DISTINCT rid, unnest(range(s, s + m)) AS p FROM (SELECT DISTINCT rid, s, m FROM h)),
n AS (SELECT rid, count(*) AS n_hit FROM covered GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
       FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
       coalesce(it.items_sha256, sha256('')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN it USING (rid)
"""

#: crc32 of the decimal text of each number of ``ids(id)``: a table of one byte's remainders, then a byte a step.
_CRC = """
bits(n, k, v) AS (
    SELECT range, 0, range FROM range(256)
    UNION ALL SELECT n, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
remainders AS (SELECT n, v FROM bits WHERE k = 8),
crc_steps(id, s, v) AS (
    SELECT id, CAST(id AS VARCHAR), 4294967295 FROM ids
    UNION ALL SELECT c.id, substr(c.s, 2), xor(c.v >> 8, r.v) FROM crc_steps c JOIN remainders r ON c.s <> '' AND r.n = xor(c.v & 255, ascii(c.s))),
crc AS (SELECT id, xor(v, 4294967295) AS crc FROM crc_steps WHERE s = '')"""


def _field(x: str) -> str:
    return f"coalesce(octet_length(encode(CAST({x} AS VARCHAR))) || ':' || CAST({x} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(x) for x in ("doc_id", "source", "lang", n_chars, "text")) + ")"


#: Levels are rows (k, g, i, n, x): node i of n on level k of group g. A document's steps are its levels with more than one node.
MERKLE = f"""WITH RECURSIVE ids AS (SELECT DISTINCT doc_id AS id FROM documents WHERE doc_id IS NOT NULL),{_CRC},
leaves AS (
    SELECT doc_id, lang AS g, {_leaf("n_chars")} AS leaf, CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END AS claimed
    FROM documents LEFT JOIN crc ON id = doc_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves),
lv(k, g, i, n, x) AS (
    SELECT 0, g, i, n, leaf FROM placed
    UNION ALL SELECT k + 1, g, i // 2, (n + 1) // 2, sha256(string_agg(x, '' ORDER BY i)) FROM lv WHERE n > 1 GROUP BY k, g, i // 2, n),
subroots AS (SELECT g, x, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM lv WHERE n = 1),
top(k, i, n, x) AS (
    SELECT 1000, i, n, x FROM subroots
    UNION ALL SELECT k + 1, i // 2, (n + 1) // 2, sha256(string_agg(x, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY k, i // 2, n),
steps AS (
    SELECT p.g, p.i AS pos, a.k, a.i % 2 AS side, s.x FROM placed p JOIN lv a ON a.g IS NOT DISTINCT FROM p.g AND a.n > 1 AND a.i = p.i >> CAST(a.k AS BIGINT)
    LEFT JOIN lv s ON s.g IS NOT DISTINCT FROM a.g AND s.k = a.k AND s.i = xor(a.i, 1)
    UNION ALL
    SELECT p.g, p.i, a.k, a.i % 2, s.x FROM placed p JOIN subroots r ON r.g IS NOT DISTINCT FROM p.g JOIN top a ON a.n > 1 AND a.i = r.i >> CAST(a.k - 1000 AS BIGINT)
    LEFT JOIN top s ON s.k = a.k AND s.i = xor(a.i, 1)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY g, pos ORDER BY k) AS step FROM steps),
fold(g, pos, step, x) AS (
    SELECT g, i, CAST(0 AS BIGINT), claimed FROM placed
    UNION ALL SELECT f.g, f.pos, s.step, sha256(CASE WHEN s.side = 1 THEN coalesce(s.x, '') || f.x ELSE f.x || coalesce(s.x, '') END)
    FROM fold f JOIN numbered s ON s.g IS NOT DISTINCT FROM f.g AND s.pos = f.pos AND s.step = f.step + 1),
proofs AS (SELECT g, pos, count(*) AS steps, sha256(coalesce(string_agg(x, '' ORDER BY step), '')) AS proof FROM numbered GROUP BY g, pos)
SELECT p.doc_id, p.leaf, r.x AS subroot, t.x AS root, coalesce(q.proof, sha256('')) AS proof_sha256, f.x AS folded_root, f.x = t.x AS verified
FROM placed p JOIN subroots r ON r.g IS NOT DISTINCT FROM p.g JOIN (SELECT x FROM top WHERE n = 1) t ON TRUE
LEFT JOIN proofs q ON q.g IS NOT DISTINCT FROM p.g AND q.pos = p.i
JOIN fold f ON f.g IS NOT DISTINCT FROM p.g AND f.pos = p.i AND f.step = coalesce(q.steps, 0)"""


#: Nodes are named by the hash of their path; a node's ancestors are the shorter paths of its smallest member.
PREFIX_TRIE = f"""WITH RECURSIVE ids AS (SELECT DISTINCT conv_id AS id FROM conversations WHERE conv_id IS NOT NULL),{_CRC},
own AS (
    SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL),
heads AS (SELECT id AS c, id - id % 5 AS base, crc % 9 AS h FROM crc),
both_parts AS (
    SELECT heads.c, 0 AS part, i, role, text FROM heads JOIN own ON own.c = heads.base AND i <= h
    UNION ALL SELECT heads.c, 1, i, role, text FROM heads JOIN own ON own.c = heads.c AND i > h),
steps AS (
    SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, i) AS d, octet_length(encode(text)) AS n_bytes,
           sha256(octet_length(encode(role)) || ':' || role || text) AS x FROM both_parts),
paths AS (
    SELECT c, d, n_bytes, sha256(string_agg(x, '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING)) AS k FROM steps
    UNION ALL SELECT c, 0, 0, '' FROM heads),
members AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS up, d = max(d) OVER (PARTITION BY c) AS ends FROM paths),
nodes AS (
    SELECT k, d, min(up) AS up, min(c) AS c, count(*) AS n_convs, min(n_bytes) AS n_bytes,
           sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
    FROM members GROUP BY k, d),
inner_nodes AS (SELECT up, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
full_nodes AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN inner_nodes ON inner_nodes.up = nodes.k),
sums AS (
    SELECT a.k, SUM(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, SUM((f.n_convs - 1) * f.n_bytes) AS saved
    FROM full_nodes f JOIN members a ON a.c = f.c AND a.d <= f.d GROUP BY a.k)
SELECT f.c AS conv_id, CAST(f.d AS BIGINT) AS depth, p.c AS parent_conv_id, f.n_convs, f.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN sums s ON s.k = f.k LEFT JOIN nodes p ON p.k = f.up"""
