"""SQL that DuckDB answers the queries of the training-data operators with, where SQL can say what they return."""

from __future__ import annotations

import math

from folioscan.llm.decontaminate import WINDOW
from folioscan.llm.licenses import PHRASES, TEMPLATES, THRESHOLD, block_size

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _words(column: str) -> str:
    lower = f"translate(coalesce({column}, ''), '{_UPPER}', '{_UPPER.lower()}')"
    return rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _list(words: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words.split()) + "]"


DECONTAMINATE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words('text')} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_words('text')} AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least({WINDOW}, len(w)) AS n, array_to_string(w[k:k + least({WINDOW}, len(w)) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - {WINDOW} + 1) + 1)) AS k FROM b WHERE len(w) > 0) x),
places AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS k FROM d),
found AS (SELECT p.r, p.k, v.n, v.item FROM (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM places, (SELECT DISTINCT n FROM windows) t WHERE k + n - 1 <= len(w)) p JOIN windows v USING (n, s)),
hit AS (SELECT r, count(DISTINCT i) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS i FROM (SELECT DISTINCT r, k, n FROM found) y) z GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM found) q GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)"""

_PHRASES = ", ".join(f"({_list(p)}, '{label}')" for p, label in PHRASES.items())
_TEMPLATES = ", ".join(
    f"({_list(' '.join(dict.fromkeys(text.split())))}, {len(set(text.split()))}, {math.ceil(THRESHOLD * len(set(text.split())) - 1e-9)}, {block_size(text)}, '{label}')" for text, label in TEMPLATES.items()
)
LICENSES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words('text')} AS w FROM documents),
phrases(p, label) AS (VALUES {_PHRASES}), templates(tokens, n, needed, size, label) AS (VALUES {_TEMPLATES}),
places AS (SELECT r, i, label FROM (SELECT r, w, unnest(range(0, len(w))) AS i FROM d) x, phrases WHERE w[i + 1:i + len(p)] = p),
base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY r),
blocks AS (SELECT r, w[pos + 1:pos + size] AS block, size FROM (SELECT r, w, size, unnest(range(0, greatest(1, len(w) - size // 2), size // 2)) AS pos FROM d, (SELECT DISTINCT size FROM templates) s) x),
near AS (SELECT r, label, len(list_intersect(list_distinct(block), tokens)) AS shared, n, needed FROM blocks JOIN templates USING (size)),
met AS (SELECT r, label, shared / n AS share FROM near WHERE shared >= needed),
scores AS (SELECT r, max(share) AS best FROM met GROUP BY r),
every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM places UNION ALL SELECT r, label FROM met) y GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN every USING (r) LEFT JOIN scores USING (r)"""

EXACT = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""

#: Every window of 100 bytes (200 digits of hex) that is not the first of its kind covers bytes that go.
SUFFIXES = """WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, s, substr(h, 2 * s - 1, 200) AS bytes FROM (SELECT r, h, unnest(range(1, length(h) // 2 - 98)) AS s FROM d) x),
again AS (SELECT r, s FROM w QUALIFY row_number() OVER (PARTITION BY bytes ORDER BY r, s) > 1),
spans AS (SELECT r, min(s) AS lo, max(s) + 99 AS hi FROM (
  SELECT r, s, sum(fresh) OVER (PARTITION BY r ORDER BY s) AS run FROM (
    SELECT r, s, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + 100 THEN 0 ELSE 1 END AS fresh FROM again) x) y GROUP BY r, run),
parts AS (SELECT d.r, lo, substr(h, 2 * before + 1, 2 * (lo - 1 - before)) AS kept FROM (
  SELECT r, lo, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS before FROM spans) x JOIN d USING (r)),
gone AS (SELECT r, string_agg(kept, '' ORDER BY lo) AS kept FROM parts GROUP BY r),
sums AS (SELECT r, sum(hi - lo + 1) AS n_removed, count(*) AS n_spans, max(hi) AS last FROM spans GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN sums USING (r)"""

#: The table of crc32 comes from its polynomial. Near words share a word with one code point less: at the same place where both are as long, else it is one of the two.
SPELLING = r"""WITH RECURSIVE crc(tab) AS (SELECT list(list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) FROM range(256) t(i)),
runs AS (SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS w FROM documents) x WHERE length(w) >= 7 GROUP BY ALL),
digits AS (SELECT w, k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM runs),
hashed AS (SELECT w, k, xor(list_reduce([4294967295] || list_transform(range(1, length(x) // 2 + 1), lambda j: CAST('0x' || substr(x, 2 * j - 1, 2) AS BIGINT)), lambda c, b: xor(c // 256, tab[xor(c, b) % 256 + 1])), 4294967295) AS h FROM digits, crc),
results AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, k FROM hashed),
words AS (SELECT w, CAST(sum(k) AS BIGINT) AS n FROM results WHERE length(w) >= 7 GROUP BY w HAVING sum(k) >= 2),
shorter AS (SELECT w, n, i, length(w) AS l, substr(w, 1, i - 1) || substr(w, i + 1) AS s FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM words) x),
near AS (SELECT a.w, a.n, b.w AS v, b.n AS m FROM shorter a JOIN shorter b ON a.s = b.s AND a.i = b.i AND a.l = b.l AND a.w <> b.w
  UNION SELECT a.w, a.n, b.w, b.n FROM shorter a JOIN words b ON a.s = b.w UNION SELECT b.w, b.n, a.w, a.n FROM shorter a JOIN words b ON a.s = b.w),
best AS (SELECT w, n, v, m, count(*) OVER (PARTITION BY w) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY w ORDER BY m DESC, v) = 1),
formed AS (SELECT w, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * words.n THEN v END AS form, CASE WHEN m >= 10 * words.n THEN m END AS form_n FROM words LEFT JOIN best USING (w)),
steps AS (SELECT w, w AS at FROM formed UNION ALL SELECT s.w, f.form FROM steps s JOIN formed f ON s.at = f.w WHERE f.form IS NOT NULL)
SELECT f.w AS word, f.form, s.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN steps s ON s.w = f.w JOIN formed e ON e.w = s.at WHERE e.form IS NULL"""

#: Every document is scored for every item.
RANKED = r"""WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
size AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0),
postings AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) x GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS weight FROM postings, size GROUP BY term, docs),
b AS (SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
lengths AS (SELECT r, doc_id, 100 - 75 + (75 * len(w) * docs) // terms AS m FROM d, size WHERE len(w) > 0),
scores AS (SELECT q, item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM b JOIN postings USING (term) JOIN weights USING (term) JOIN lengths USING (r) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, r) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 10"""

ARCHIVED = """
SELECT page_id, octet_length(encode(html)) AS payload_bytes, digest AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM (SELECT page_id, html, digest, first_value(page_id) OVER w AS first, octet_length(encode(html)) >= 100 AND row_number() OVER w > 1 AS again
  FROM (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest FROM pages) x WINDOW w AS (PARTITION BY digest ORDER BY page_id NULLS LAST)) y"""
