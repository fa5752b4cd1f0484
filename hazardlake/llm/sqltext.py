"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from hazardlake.llm.license import TEMPLATES

SQL: dict[str, str] = {}

SQL["op4_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

SQL["op9_url_rules"] = r"""
WITH r(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (SELECT row_number() OVER () AS rn, page_id,
       translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
       regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
m AS (SELECT u.rn, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS verdict
      FROM u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY u.rn)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (rn)
"""

_WORDS = (
    r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
SQL["op10_decontamination"] = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce({_WORDS.format(t='text')}, []) AS w FROM documents),
b AS (SELECT item_id, w, least(13, len(w)) AS l FROM (SELECT item_id, {_WORDS.format(t='text')} AS w FROM benchmark) WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - l + 2)) AS i FROM b)),
p AS (SELECT rn, l, i, array_to_string(w[i:i + l - 1], ' ') AS gram
      FROM (SELECT rn, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM g) WHERE len(w) >= l)),
h AS (SELECT rn, item_id, i, l FROM p JOIN g USING (l, gram)),
n AS (SELECT rn, count(DISTINCT pos) AS n_hit FROM (SELECT rn, unnest(range(i, i + l)) AS pos FROM h) GROUP BY rn),
s AS (SELECT rn, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rn, item_id::VARCHAR AS item_id FROM h) GROUP BY rn)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (rn) LEFT JOIN s USING (rn)
"""

# fixed values: the templates of the operator, as lists of distinct words
_TEMPLATES = ",\n".join(f"('{label}', list_distinct(string_split('{text}', ' ')))" for label, text in TEMPLATES)
SQL["op11_license_scan"] = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce({_WORDS.format(t='text')}, []) AS w FROM documents),
p(phrase, label) AS (VALUES (['mit', 'license'], 'mit'), (['apache', 'license'], 'apache'), (['general', 'public', 'license'], 'gpl')),
s AS (SELECT rn, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE list_contains(w, 'license')),
b AS (SELECT rn, i - 1 AS i, label FROM s JOIN p ON w[i:i + len(phrase) - 1] = phrase),
n AS (SELECT rn, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM b GROUP BY rn),
t(label, words) AS (VALUES {_TEMPLATES}),
c AS (SELECT rn, k * 32 AS start, list_distinct(w[k * 32 + 1:k * 32 + 64]) AS words
      FROM (SELECT rn, w, unnest(range(0, greatest(0, ceil((len(w) - 64) / 32)::BIGINT) + 1)) AS k FROM d WHERE len(w) > 0)),
m AS (SELECT rn, start, label, len(list_intersect(c.words, t.words)) AS o, len(t.words) AS n FROM c, t),
g AS (SELECT rn, max(o / n) AS best, count(DISTINCT start) AS n_blocks FROM m WHERE o >= ceil(0.9 * n - 1e-9) GROUP BY rn),
l AS (SELECT rn, string_agg(label, ',' ORDER BY label) AS labels FROM
      (SELECT rn, label FROM b UNION SELECT rn, label FROM m WHERE o >= ceil(0.9 * n - 1e-9)) GROUP BY rn),
e AS (SELECT rn, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT rn, label FROM b) GROUP BY rn)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(e.labels, '') AS base_labels,
       coalesce(l.labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score, coalesce(n_blocks, 0) AS n_blocks
FROM d LEFT JOIN n USING (rn) LEFT JOIN g USING (rn) LEFT JOIN l USING (rn) LEFT JOIN e USING (rn)
"""

# CRC-32 of the strings s of a table x: a table of 256 values by its rule, then one step per byte
_CRC = """
crc_table AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
crcs AS (SELECT s, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(hex) // 2), lambda k: ('0x' || substr(hex, 2 * k + 1, 2))::BIGINT)),
      lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1])), 4294967295) AS crc
      FROM (SELECT DISTINCT s, hex(encode(s)) AS hex FROM x), crc_table)
"""
SQL["op12_resampling"] = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce({_WORDS.format(t='text')}, []) AS w FROM documents),
b AS (SELECT coalesce({_WORDS.format(t='text')}, []) AS w FROM benchmark),
f AS (SELECT rn, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS s FROM d),
z AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS s FROM b),
x AS (SELECT s FROM f UNION SELECT s FROM z),
{_CRC},
k AS (SELECT s, crc % 10000 AS bucket FROM crcs),
sn AS (SELECT bucket, count(*) AS n FROM f JOIN k USING (s) GROUP BY bucket),
tn AS (SELECT bucket, count(*) AS n FROM z JOIN k USING (s) GROUP BY bucket),
g AS (SELECT r.bucket, floor(1000 * ln(((coalesce(tn.n, 0) + 1) * ((SELECT coalesce(sum(n), 0)::BIGINT FROM sn) + 10000))
      / ((coalesce(sn.n, 0) + 1) * ((SELECT coalesce(sum(n), 0)::BIGINT FROM tn) + 10000))))::BIGINT AS gain
      FROM range(10000) r(bucket) LEFT JOIN sn USING (bucket) LEFT JOIN tn USING (bucket)),
w AS (SELECT rn, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN k USING (s) JOIN g USING (bucket) GROUP BY rn),
r AS (SELECT d.rn, doc_id, len(d.w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
      coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM d LEFT JOIN w USING (rn)),
o AS (SELECT rn, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS total FROM r WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= total * 25 // 100 THEN rank END AS rank FROM r LEFT JOIN o USING (rn)
"""

SQL["op13_spelling"] = f"""
WITH r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
q AS (SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM r WHERE length(run) >= 7),
x AS (SELECT s FROM q),
{_CRC},
a AS (SELECT CASE WHEN crc % 31 = 0 THEN substr(run, 1, (crc % length(run))::BIGINT) || substr(run, (crc % length(run))::BIGINT + 2) ELSE run END AS word FROM q JOIN crcs USING (s)),
v AS (SELECT word, count(*) AS n FROM a WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
h AS (SELECT word, n, length(word) AS len, unnest(range(1, length(word) + 1)) AS i FROM v),
del AS (SELECT DISTINCT word, n, len, substr(word, 1, i - 1) || substr(word, i + 1) AS short FROM h),
sub AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS hole FROM h),
pair AS (SELECT x.word, y.word AS near, y.n AS near_n FROM sub x JOIN sub y USING (hole) WHERE x.word <> y.word
      UNION SELECT v.word, del.word, del.n FROM v JOIN del ON v.word = del.short
      UNION SELECT del.word, v.word, v.n FROM v JOIN del ON v.word = del.short),
u AS (SELECT word, count(*) AS n_near FROM pair GROUP BY word),
best AS (SELECT word, near, near_n, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM pair),
frm AS (SELECT v.word, v.n, coalesce(u.n_near, 0) AS n_near, CASE WHEN near_n >= 10 * v.n THEN near END AS form, CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n
      FROM v LEFT JOIN u USING (word) LEFT JOIN best ON v.word = best.word AND place = 1),
up AS (WITH RECURSIVE c AS (SELECT word, word AS root FROM frm UNION ALL SELECT c.word, frm.form FROM c JOIN frm ON c.root = frm.word WHERE frm.form IS NOT NULL)
      SELECT c.word, c.root FROM c JOIN frm ON c.root = frm.word WHERE frm.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM frm JOIN up USING (word)
"""
