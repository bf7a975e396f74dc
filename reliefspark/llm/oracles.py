"""The operators that SQL can express, in DuckDB's dialect, over whole tables."""

from __future__ import annotations

#: Fixed value: the digits of base32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
WORDS = r"'[^\x20\x09-\x0D]+'"


def low(text: str) -> str:
    """A-Z alone in lower case."""
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


OP1 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
first_ AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h),
-- five hexadecimal digits are four of base32
digest AS (SELECT h, list_aggregate(list_transform(range(0, 32), lambda k: substr('{BASE32}',
    1 + ((('0x' || substr(sha1(h), 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31), 1)), 'string_agg', '') AS d FROM first_)
SELECT page_id, octet_length(encode(p.h))::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id = first_id OR first_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM p JOIN first_ USING (h) JOIN digest USING (h)
"""

OP6 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({low("coalesce(text, '')")}, {WORDS}) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s FROM w),
e AS (SELECT doc_id, len(s)::BIGINT AS n, unnest(s) AS g FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * k >= 80 * (na + nb - k)),
both_ AS (SELECT a AS x, b AS y FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT x AS id, x AS c FROM both_ UNION SELECT both_.y, reach.c FROM reach JOIN both_ ON both_.x = reach.id),
comp AS (SELECT id, min(c) AS c FROM reach GROUP BY id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id, doc_id = coalesce(c, doc_id) AS kept FROM s LEFT JOIN comp ON id = doc_id
"""

OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, regexp_extract_all(t, {WORDS}) AS w FROM d),
win AS (SELECT k, i, w[i:i + 4] AS g FROM w, unnest(range(1, len(w) - 3)) AS u(i) WHERE len(w) >= 5),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT k, count(DISTINCT i + o) AS n_repeat_words FROM twice, range(0, 5) AS r(o) GROUP BY k),
lines AS (SELECT k, host, unnest(string_split(t, chr(10))) AS x FROM d),
lw AS (SELECT k, host, x, regexp_extract_all({low("x")}, {WORDS}) AS g FROM lines WHERE regexp_matches(x, {WORDS})),
dup AS (SELECT k, count(*) - count(DISTINCT x) AS n_dup_lines FROM lw GROUP BY k),
own AS (SELECT k, host, g, sum(len(g)) AS n FROM lw GROUP BY k, host, g),
sizes AS (SELECT host, count(*) AS docs FROM d GROUP BY host),
freq AS (SELECT host, g FROM own JOIN sizes USING (host) GROUP BY host, g, docs HAVING count(*) > 20 AND count(*) > 0.002 * docs),
gone AS (SELECT k, sum(n)::BIGINT AS gone, count(*) AS n_lines FROM own JOIN freq USING (host, g) GROUP BY k),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(gone, 0) AS gone, coalesce(n_lines, 0) AS n_frequent_lines
  FROM d JOIN w USING (k) LEFT JOIN rep USING (k) LEFT JOIN dup USING (k) LEFT JOIN gone USING (k)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_words - gone AS n_words_left FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words_left >= 3 AND n_words_left >= 0.2 * n_words AS kept, n_frequent_lines, n_words_left FROM f
"""

#: Windows of two lines, lines of 50 words, and lines with words that more than two empty ones part; all but the first of equal ones go.
OP8 = f"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, i, ls[i + 1] AS x, len(regexp_extract_all(ls[i + 1], {WORDS})) AS w FROM l, unnest(range(len(ls))) AS u(i)),
two AS (SELECT *, lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS w2 FROM lines),
worded AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM lines WHERE w > 0),
win AS (SELECT doc_id, i, 1 AS n FROM lines WHERE w >= 50
  UNION ALL SELECT doc_id, i, 2 FROM two WHERE w + w2 >= 1
  UNION ALL SELECT doc_id, i, nxt - i + 1 FROM worded WHERE nxt - i + 1 > 4),
body AS (SELECT win.doc_id, i, n, ls[i + 1 : i + n] AS body FROM win JOIN l USING (doc_id)),
again AS (SELECT doc_id, i, n FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS k FROM body) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM again, unnest(range(n)) AS u(o)),
stretch AS (SELECT doc_id, count(*) AS n, count(*) FILTER (b IS NULL OR b <> i - 1) AS chunks FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM gone) GROUP BY doc_id),
rest AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS t FROM lines ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(ls), 0)::INTEGER AS n_lines, coalesce(s.n, 0)::INTEGER AS n_removed, coalesce(chunks, 0)::INTEGER AS n_chunks,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t, '') END AS text
FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN stretch s USING (doc_id) LEFT JOIN rest USING (doc_id)
"""

#: What law op4 keeps: counts of 40 shards and their slots, and of each size of text how many documents.
SHARD_LAW = """
WITH n AS (SELECT count(*) AS n FROM documents),
s AS (SELECT unnest(range(40)) AS shard)
SELECT shard::INTEGER AS shard, (n // 40 + CASE WHEN shard < n % 40 THEN 1 ELSE 0 END)::BIGINT AS n_docs,
  0::BIGINT AS first_slot, (n // 40 + CASE WHEN shard < n % 40 THEN 1 ELSE 0 END - 1)::BIGINT AS last_slot,
  (n // 40 + CASE WHEN shard < n % 40 THEN 1 ELSE 0 END)::BIGINT AS n_slots FROM s, n
"""
