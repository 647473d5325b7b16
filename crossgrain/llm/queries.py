"""The corpus queries, and SQL for those that SQL can express."""

from __future__ import annotations

from crossgrain.llm.config_packing import op11_bestfit
from crossgrain.llm.ctw import op3_ctw
from crossgrain.llm.decontaminate import op1_decontamination
from crossgrain.llm.langid import op6_langid
from crossgrain.llm.lzprint import op9_lzprint
from crossgrain.llm.packing import op10_packing
from crossgrain.llm.prefix_trie import op13_trie
from crossgrain.llm.resample import op12_resample
from crossgrain.llm.secret_scan import op2_secrets
from crossgrain.llm.simhash import op8_simhash
from crossgrain.llm.suffix_dedup import op7_suffix_dedup
from crossgrain.llm.surrogates import op4_surrogates
from crossgrain.llm.warc import op5_warc

QUERIES = {f.__name__: f for f in (op1_decontamination, op2_secrets, op3_ctw, op4_surrogates, op5_warc, op6_langid, op7_suffix_dedup, op8_simhash, op9_lzprint, op10_packing, op11_bestfit, op12_resample, op13_trie)}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: A table of one row: crc32 of each byte value, by the polynomial; and the crc32 of a text ``w`` by it.
_CRC_TABLE = "(SELECT list(list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS tbl FROM range(256) r(i))"
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), (2 * i + 1)::INT, 2))::BIGINT)), lambda c, x: xor(c >> 8, tbl[(xor(c, x) & 255) + 1])), 4294967295)"

ORACLES: dict[str, str] = {
    "op1_decontamination": f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS n, list_slice(w, k, k + 9) AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, k, n, list_slice(w, k, k + n - 1) AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d CROSS JOIN sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, k, dw.n AS n, item FROM dw JOIN iw ON dw.win = iw.win),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op7_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, length(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)),
c AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, i, sum(st) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS st FROM c)),
sp AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM g GROUP BY doc_id, span),
q AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS y FROM sp),
r AS (SELECT d.doc_id, any_value(n) AS n, coalesce(sum(z - a), 0) AS removed, count(a) AS spans, coalesce(string_agg(substr(h, 2 * y + 1, 2 * (a - y)), '' ORDER BY a), '') || substr(any_value(h), 2 * coalesce(max(z), 0) + 1) AS kept FROM d LEFT JOIN q USING (doc_id) GROUP BY d.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(removed AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM r""",
    "op12_resample": f"""
WITH c AS {_CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
dw AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(w) AS w FROM d) GROUP BY r, w),
words AS (SELECT w FROM dw UNION SELECT w FROM b),
h AS (SELECT w, {_CRC} % 10000 AS k FROM words, c),
s AS (SELECT k, sum(n) AS n FROM dw JOIN h USING (w) GROUP BY k),
t AS (SELECT k, count(*) AS n FROM b JOIN h USING (w) GROUP BY k),
z AS (SELECT (SELECT coalesce(sum(n), 0) FROM s) AS s, (SELECT coalesce(sum(n), 0) FROM t) AS t),
g AS (SELECT k, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (z.s + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * (z.t + 10000)::DOUBLE))) AS gain FROM s FULL JOIN t USING (k), z),
m AS (SELECT r, sum(n * gain) AS weight FROM dw JOIN h USING (w) JOIN g USING (k) GROUP BY r),
f AS (SELECT r, doc_id, len(w) AS n, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::UBIGINT::DOUBLE AS h FROM d LEFT JOIN m USING (r)),
q AS (SELECT r, doc_id, n::BIGINT AS n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM f),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM q WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * o.n // 100 THEN rank END AS rank FROM q LEFT JOIN o USING (r)""",
    "op13_trie": f"""
WITH x AS {_CRC_TABLE},
o AS (SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT c, l, {_CRC} % 9 AS h FROM (SELECT c, l, CAST(c AS VARCHAR) AS w FROM o), x),
r AS (SELECT h.c, list_concat(list_slice(coalesce(b.l, []), 1, h), list_slice(h.l, h + 1, len(h.l))) AS l FROM h LEFT JOIN o b ON b.c = h.c - h.c % 5),
p AS (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM r),
m AS (SELECT c, d, list_slice(l, 1, d) AS k, d = len(l) AS ends FROM p),
n AS (SELECT k, d AS depth, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '') AS ends FROM m GROUP BY k, d),
u AS (SELECT n.*, q.conv_id AS parent_conv_id, (n_convs - 1) * CASE WHEN n.depth = 0 THEN 0 ELSE strlen(n.k[n.depth].text) END AS own FROM (SELECT *, list_slice(k, 1, depth - 1) AS pk FROM n) n LEFT JOIN (SELECT k AS pk, depth + 1 AS depth, conv_id FROM n) q USING (pk, depth)),
e AS (SELECT pk AS k, depth - 1 AS depth, count(*) AS n_children FROM u WHERE depth > 0 GROUP BY ALL),
v AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN e USING (k, depth)),
t AS (SELECT list_slice(k, 1, a) AS k, a AS depth, sum(own) AS saved, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM v) GROUP BY ALL)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256 FROM v JOIN t USING (k, depth)""",
}
