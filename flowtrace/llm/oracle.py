"""DuckDB SQL for those registered queries that SQL can express.

The others have no SQL: approximate neighbours (2), byte windows (4), BPE
merges (5, 10), context scores (6) and the classifier (8) are tested against
plain Python, recall or held-out labels instead.
"""

import string

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

#: Five bits a sign, twenty bits from five hex digits.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * k + 1}, 5))::BIGINT >> {s}) & 31)::BIGINT + 1, 1)"
    for k in range(8) for s in (15, 10, 5, 0))

OP1 = f"""WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, n, {_BASE32} AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f"""

OP3 = f"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM w, unnest(range(1, greatest(len(w) - 3, 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
  WHERE 100 * common >= 80 * (p.n + q.n - common)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT e.y, r.seen FROM r JOIN e ON e.x = r.doc_id WHERE r.seen < e.y)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(seen) AS component_id
FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id"""

_SPLIT = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
OP7 = f"""WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, {_SPLIT}) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER}, {_SPLIT}) AS w
      FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - 8, 2))) AS t(i) WHERE len(w) > 0),
dw AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM d, (SELECT DISTINCT k FROM bw), unnest(range(1, len(w) - k + 2)) AS t(i)),
hits AS (SELECT doc_id, i, k, item FROM dw JOIN bw USING (k, g)),
places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + k)) AS t(p) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP9 = f"""WITH d AS MATERIALIZED (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (
  SELECT doc_id, i, row_number() OVER (
           PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS occurrence
  FROM d, unnest(range(1, len(w) - 18)) AS t(i)),
gone AS (
  SELECT DISTINCT doc_id, p FROM s, unnest(range(i, i + 20)) AS t(p) WHERE occurrence > 1),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
left_over AS (
  SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.p) AS kept
  FROM (SELECT doc_id, generate_subscripts(w, 1) AS p, unnest(w) AS word FROM d) a
  ANTI JOIN gone g ON a.doc_id = g.doc_id AND a.p = g.p GROUP BY a.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN left_over USING (doc_id)"""

ORACLE_SQL = {"op1_warc": OP1, "op3_jaccard_join": OP3, "op7_decontamination": OP7,
              "op9_phrase_dedup": OP9}
