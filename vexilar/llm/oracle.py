"""DuckDB SQL for the queries that SQL can express.

The others have brute-force versions in the tests: sampled segmentations and classifier scores have no SQL form, the
tokenizer and XXH64 are not SQL functions, and context scores of personal data are program code.
"""

from __future__ import annotations

from vexilar.llm import license_scan, line_dedup, quality, url_filter, vector_codes

LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"list_filter(regexp_split_to_array({LOW}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _op1() -> str:
    rows = []
    for k, t in enumerate((*license_scan.BASE_TEMPLATES, *license_scan.METHOD_TEMPLATES)):
        words, key = t.phrase.split(), (t.key or t.phrase).split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        rows.append(f"({k}, '{t.label}', {k < len(license_scan.BASE_TEMPLATES)}, {_list(words)}, {_list(key)}, {at})")
    return f"""
WITH t(k, label, is_base, words, key, key_at) AS (VALUES {', '.join(rows)}),
d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d),
m AS (SELECT r, label, is_base, p - 1 - key_at AS start, len(list_filter(range(1, len(words) + 1), lambda i: p - 1 - key_at + i > 0 AND w[p - 1 - key_at + i] = words[i])) / len(words) AS share
      FROM p JOIN t ON w[p] = key[1] WHERE w[p:p + len(key) - 1] = key),
g AS (SELECT r, count(*) FILTER (is_base) AS n_base, min(start) FILTER (is_base) AS first_word, max(start) FILTER (is_base) AS last_word,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
      FROM m WHERE share >= 0.5 GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, round(coalesce(score, 0.0), 6) AS score FROM d LEFT JOIN g USING (r)"""


def _op4() -> str:
    case = lambda field: "CASE " + " ".join(
        f"WHEN (host = '{x.host}' OR ends_with(host, '.{x.host}')) AND starts_with(path, '{x.path}') THEN '{field(x)}'"
        for x in sorted(url_filter.RULES, key=lambda x: (-len(x.host + x.path), -len(x.host)))
    ) + " END"
    rule, verdict = case(lambda x: x.host + x.path), case(lambda x: x.verdict)
    parts = lambda u: (
        f"translate(coalesce(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, "
        f"coalesce(regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path"
    )
    return rf"""
WITH RECURSIVE tags AS (SELECT url, unnest([regexp_extract(regexp_extract(html, '(?is)(<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>)', 1), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
    regexp_extract(regexp_extract(html, '(?is)(<meta\b[^>]*http-equiv\s*=\s*["'']?refresh\b[^>]*>)', 1), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)]) AS target
  FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
links AS (SELECT DISTINCT a, b FROM (SELECT split_part(url, '#', 1) AS a, split_part(CASE WHEN starts_with(target, '//') THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || target
    WHEN starts_with(target, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || target WHEN contains(target, '://') THEN target END, '#', 1) AS b FROM tags WHERE target <> '')
  WHERE b IS NOT NULL AND a <> b),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
seen AS (SELECT a, {verdict} AS verdict FROM (SELECT a, {parts('b')} FROM (SELECT a, b FROM reach UNION SELECT a, a FROM reach))),
blocked AS (SELECT a FROM seen GROUP BY a HAVING bool_or(coalesce(verdict = 'block', false)) AND NOT bool_or(coalesce(verdict = 'allow', false))),
judged AS (SELECT page_id, split_part(url, '#', 1) AS u, {parts('url')} FROM pages)
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN u IN (SELECT a FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict FROM judged"""


_OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST((CAST('0x' || substr(x, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS UINTEGER) // CAST(pow(32, 3 - i % 4) AS UINTEGER)) % 32 + 1 AS BIGINT), 1)), '') AS payload_digest FROM s),
f AS (SELECT *, first(page_id) OVER w AS first_page, row_number() OVER w > 1 AS again FROM d WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_page END AS refers_to FROM f"""


def _op8() -> str:
    base = " OR ".join(f"({r.rejects})" for r in quality.BASE_RULES)
    every = " OR ".join(f"({r.rejects})" for r in (*quality.BASE_RULES, *quality.METHOD_RULES))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
cover AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
      len(regexp_extract_all(t, '\p{{L}}[^\x20\x09-\x0D]*')) AS n_letter_words, len(regexp_extract_all(t, '(?:^|\n)[\x20\x09]*[-*•]')) AS n_bullet_lines,
      len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN cover USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {base} AS base_failed, NOT ({every}) AS kept FROM m"""


_OP9 = f"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT item, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0))),
d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT r, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)"""


_OP11 = """
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
long AS (SELECT run, length(run) AS size, hex(CAST(doc_id AS VARCHAR) || ':' || run) AS x, t FROM runs, crc WHERE length(run) >= 7),
hashed AS (SELECT run, size, xor(list_reduce(range(0, length(x) // 2), lambda c, i: xor(t[(xor(c, CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)) & 255) + 1], c >> 8), 4294967295), 4294967295) AS h FROM long),
words AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % size) || substr(run, h % size + 2) ELSE run END AS word FROM hashed),
v AS MATERIALIZED (SELECT word, count(*) AS n FROM words WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
cut AS (SELECT DISTINCT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS s FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
shorter AS (SELECT DISTINCT c.word AS a, v.word AS b FROM cut c JOIN v ON c.s = v.word),
near AS (SELECT a AS word, b AS near FROM shorter UNION ALL SELECT b, a FROM shorter
  UNION ALL SELECT DISTINCT c.word, d.word FROM cut c JOIN cut d ON c.i = d.i AND c.s = d.s AND length(c.word) = length(d.word) AND c.word <> d.word),
best AS (SELECT near.word, count(*) AS n_near, min(struct_pack(less := -v.n, word := near.near)) AS b FROM near JOIN v ON near.near = v.word GROUP BY near.word),
found AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 10 * v.n THEN b.word END AS form, CASE WHEN -b.less >= 10 * v.n THEN -b.less END AS form_n FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, form AS at FROM found WHERE form IS NOT NULL UNION SELECT walk.word, found.form FROM walk JOIN found ON walk.at = found.word WHERE found.form IS NOT NULL),
ends AS (SELECT walk.word, walk.at AS root FROM walk JOIN found ON walk.at = found.word WHERE found.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM found LEFT JOIN ends USING (word)"""


def _op12() -> str:
    steps = []
    for k in range(vector_codes.ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, p, c, m % 16 AS e, m // 16 AS d FROM (SELECT r, x.p, any_value(x.c) AS c, min(16 * list_sum(list_transform(list_zip(x.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) + e) AS m FROM x JOIN b{k} b ON x.p = b.p GROUP BY r, x.p))")
        if k < vector_codes.ROUNDS:
            steps.append(f"s{k} AS (SELECT p, e, i, CAST(floor(sum(z) / count(*)) AS BIGINT) AS z FROM (SELECT p, e, unnest(c) AS z, unnest(range(len(c))) AS i FROM a{k}) GROUP BY p, e, i)")
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM b{k} b LEFT JOIN (SELECT p, e, list(z ORDER BY i) AS c FROM s{k} GROUP BY p, e) n ON b.p = n.p AND b.e = n.e)")
    last = vector_codes.ROUNDS
    return f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda z: CAST(floor({vector_codes.SCALE} * CAST(z AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0),
x AS MATERIALIZED (SELECT r, p, c[p * len(c) // 8 + 1:(p + 1) * len(c) // 8] AS c FROM (SELECT r, c, unnest(range(8)) AS p FROM v)),
b0 AS (SELECT p, r - 1 AS e, c FROM x WHERE r <= 16),
{', '.join(steps)},
books AS (SELECT sha256(string_agg(CAST(z AS VARCHAR), ',' ORDER BY p, e, i)) AS h FROM (SELECT p, e, unnest(c) AS z, unnest(range(len(c))) AS i FROM b{last})),
codes AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{last} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM v JOIN codes USING (r), books"""


_OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT r, doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM d),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= {line_dedup.LEAST_LENGTH} GROUP BY key HAVING count(DISTINCT r) >= {line_dedup.LEAST_DOCUMENTS}),
judged AS (SELECT r, i, line, keyed.key IN (SELECT key FROM shared) AND doc_id IS DISTINCT FROM last AS goes FROM keyed LEFT JOIN shared USING (key)),
kept AS (SELECT r, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT goes), '')) AS kept_sha256 FROM judged GROUP BY r)
SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM d JOIN kept USING (r)"""


def oracle_sql() -> dict[str, str]:
    found = {"op1_license_scan": _op1(), "op4_url_filter": _op4(), "op7_warc": _OP7, "op8_quality": _op8(), "op9_decontaminate": _OP9}
    return found | {"op11_spelling": _OP11, "op12_vector_codes": _op12(), "op13_line_dedup": _OP13}
