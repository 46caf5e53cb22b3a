"""SQL twins of the operators that SQL can express, for DuckDB."""

from __future__ import annotations

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE = "'[\\x20\\x09-\\x0D]+'"

WORDS = f"""w AS MATERIALIZED (SELECT doc_id, CASE WHEN trim(t, {WS}) = '' THEN [] ELSE string_split_regex(trim(t, {WS}), {SPACE}) END AS words, t FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"""

QUALITY = rf"""WITH {WORDS},
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
d AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM d) GROUP BY doc_id),
l AS MATERIALIZED (SELECT doc_id, line, k, regexp_matches(line, '[^\x20\x09-\x0D]') AS filled FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM w)),
j AS (SELECT *, filled AND (length(line) - length(replace(line, '|', '')) >= 4 OR length(regexp_replace(line, '[^#*$%&|<>]+', '', 'g')) * 20 > length(line)
  OR (length(line) - length(replace(line, '!!', ''))) / 2 >= 3 OR (upper(line) = line AND length(line) >= 20 AND lower(line) <> line)
  OR regexp_matches(line, '(?i)^\W*(?:home|menu|log ?in|sign ?(?:in|up)|next|previous|back|search|contact(?: us)?|about(?: us)?|share|read more|skip to [a-z ]+)\W*$')
  OR regexp_matches(line, '(?i)all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|uses? cookies|enable javascript|lorem ipsum|click here|subscribe to our|copyright (?:\(c\)|©|\d{{4}})|spdx-license-identifier')
  OR NOT (regexp_matches(line, '[.!?…:;"''”’»)\]。！？：；」』）】।॥؟۔؛።។៕။།ก-๛ກ-ໟ]\s*$') OR regexp_matches(line, '[.!?…؟۔।።]\s|[。！？]'))) AS fails FROM l),
s AS (SELECT doc_id, sum(length(line)) AS total, coalesce(sum(length(line)) FILTER (NOT fails), 0) AS good, count(*) FILTER (fails) AS removed,
  count(*) FILTER (filled) - count(DISTINCT line) FILTER (filled) AS dups FROM j GROUP BY doc_id),
b AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, s.dups AS n_dup_lines,
  coalesce(r.n, 0) AS n_repeat_words, CASE WHEN total = 0 THEN 1.0 ELSE 1 - good / total END AS loss, removed AS n_lines_removed FROM w JOIN s USING (doc_id) LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND loss <= 0.5 AS kept,
  n_lines_removed::BIGINT AS n_lines_removed, round(loss, 6)::DOUBLE AS loss FROM f"""

LINES = f"""WITH l AS MATERIALIZED (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
n AS MATERIALIZED (SELECT *, {LOW.format(f"trim(line, {WS})")} AS key FROM l),
c AS MATERIALIZED (SELECT key, max(doc_id) AS top FROM n WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM (SELECT n.*, coalesce(c.top <> n.doc_id, false) AS gone FROM n LEFT JOIN c USING (key)) GROUP BY doc_id"""

WARC = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages), h AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS x FROM p),
g AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(x, 5 * i + 1, 5))::BIGINT) AS v, max(page_id) OVER (PARTITION BY x) AS top FROM h)
SELECT page_id, payload_bytes, array_to_string(list_transform(v, lambda n: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> s) & 31)::INT + 1, 1)), '')), '') AS payload_digest,
CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM g"""

JACCARD = f"""WITH RECURSIVE {WORDS},
lw AS MATERIALIZED (SELECT doc_id, list_transform(words, lambda x: {LOW.format("x")}) AS words FROM w),
s AS MATERIALIZED (SELECT DISTINCT doc_id, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM lw WHERE len(words) >= 3)
  UNION SELECT doc_id, array_to_string(words, ' ') FROM lw WHERE len(words) IN (1, 2)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 90 * (na.n + nb.n - c)),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON r.id = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON d.doc_id = m.id"""

SUBSTRINGS = """WITH x AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), w AS (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 99))) AS i FROM x),
k AS (SELECT doc_id, i, md5_number(substr(h, (2 * i + 1)::INT, 200)) AS m FROM w),
f AS (SELECT doc_id, i FROM k QUALIFY row_number() OVER (PARTITION BY m ORDER BY doc_id, i) > 1),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS new FROM f)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, run),
o AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, count(*) AS n, sum(b - a) AS gone FROM s GROUP BY doc_id)
SELECT x.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
sha256(unhex(CASE WHEN n IS NULL THEN h ELSE array_to_string(list_transform(range(n + 1), lambda k: substr(h, (2 * CASE WHEN k = 0 THEN 0 ELSE b[k] END + 1)::INT, (2 * (CASE WHEN k = n THEN length(h) // 2 ELSE a[k + 1] END - CASE WHEN k = 0 THEN 0 ELSE b[k] END))::INT)), '') END)) AS kept_sha256
FROM x LEFT JOIN o USING (doc_id)"""



def _product_codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Lloyd's rounds unrolled: in each, `a` has the nearest entry of every part and `c` the entries that follow."""
    d = "list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"p AS MATERIALIZED (SELECT vec_id, label, k AS part, x[k * len(x) // {parts} + 1 : (k + 1) * len(x) // {parts}] AS x FROM v, range({parts}) t(k))",
        f"c0 AS MATERIALIZED (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e FROM p QUALIFY e < {entries})",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, label, p.part, any_value(p.x) AS x, min({d} * {entries} + e) AS m FROM p JOIN c{r} c ON p.part = c.part GROUP BY ALL)")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT part, e, list(CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END ORDER BY i) AS x
FROM (SELECT part, m % {entries} AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, len(x) + 1) t(i) GROUP BY ALL) GROUP BY ALL)""")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.part, coalesce(s.x, c.x) AS x, c.e FROM c{r} c LEFT JOIN s{r} s ON c.part = s.part AND c.e = s.e)")
    steps.append(f"b AS (SELECT sha256(string_agg(v, ',' ORDER BY part, e)) AS codebooks_sha256 FROM (SELECT part, e, array_to_string(x, ',') AS v FROM c{rounds}))")
    steps.append(f"r AS (SELECT vec_id, label, string_agg(printf('%02x', m % {entries}), '' ORDER BY part) AS code, sum(m // {entries})::BIGINT AS error FROM a{rounds} GROUP BY ALL)")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r, b"


NEGATIVES = """WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS a, r.vec_id AS r, a.label = r.label AS same, list_sum(list_transform(list_zip(a.x, r.x), lambda z: z[1] * z[2]))::BIGINT AS s FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT a, r, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, r) <= 5),
n AS (SELECT p.a AS anchor_id, p.r AS positive_id, (row_number() OVER (PARTITION BY p.a, p.r ORDER BY s.s DESC, s.r))::INT AS rank, s.r AS negative_id, p.s AS positive_score, s.s AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.s <= 100 * s.s AND s.s <= p.s)
SELECT * FROM n WHERE rank <= 5"""

SQL = {"op12_hard_negatives": NEGATIVES, "op11_vector_codes": _product_codes(), "op2_suffix_dedup": SUBSTRINGS, "op3_quality_rules": QUALITY, "op5_line_dedup": LINES, "op8_jaccard_join": JACCARD, "op10_warc": WARC}
