"""Registered queries of the subpackage, one for each operator, and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op6_byte_bpe
from .jaccard import op8_ngram_jaccard_join
from .lexical import op12_lexical_search
from .mixing import op13_source_mixing
from .near_vectors import op4_embedding_near_dedup
from .packing import op9_packing
from .perplexity import op2_quality_classifier
from .personal import op10_personal_data
from .prefix_trie import op11_prefix_trie
from .quality_rules import BOILERPLATE, NAVIGATION, op3_quality_rules
from .repeats import op7_suffix_array_dedup
from .secrets import op1_secret_scan
from .token_files import op5_token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_quality_rules": op3_quality_rules,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_token_files": op5_token_files,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_packing": op9_packing,
    "op10_personal_data": op10_personal_data,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_lexical_search": op12_lexical_search,
    "op13_source_mixing": op13_source_mixing,
}

_QUOTED = {"boilerplate": BOILERPLATE.replace("'", "''"), "navigation": NAVIGATION.replace("'", "''")}

#: SQL for the queries that SQL can express; the others are tested against brute force in tests/llm.
SQL: dict[str, str] = {
    "op3_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 8], ' ') AS g FROM (SELECT doc_id, w, unnest(range(len(w) - 7)) AS i FROM w WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY 1),
l AS (SELECT doc_id, x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
m AS (SELECT doc_id, x, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS chars, length(regexp_replace(x, '[^#*$%&|<>{{}}\\^~=_@!]+', '', 'g')) AS symbols,
  length(regexp_replace(x, '[^\p{{Lu}}]+', '', 'g')) AS capitals, length(regexp_replace(x, '[^\p{{L}}]+', '', 'g')) AS letters FROM l),
g AS (SELECT doc_id, sum(chars) AS n FROM m WHERE symbols < 0.1 * chars AND letters * 2 >= chars AND NOT (letters >= 12 AND capitals >= 0.6 * letters)
  AND NOT regexp_matches(x, '(?i)^\W*(?:{_QUOTED["navigation"]})\W*$') AND NOT regexp_matches(x, '\s[|>»·•]\s.*\s[|>»·•](?:\s|$)')
  AND NOT regexp_matches(x, '(?i)\b(?:{_QUOTED["boilerplate"]})') GROUP BY 1),
s AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM l GROUP BY 1),
o AS (SELECT d.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(s.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, CAST(coalesce(g.n, 0) AS BIGINT) AS kept_chars
  FROM d JOIN w ON w.doc_id = d.doc_id LEFT JOIN rep ON rep.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id)
SELECT *, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed, NOT (n_words < 20 OR n_repeat_words * 100 > n_words * 30) AND kept_chars >= 0.5 * word_chars AS kept FROM o""",
    "op4_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
o AS (SELECT v.vec_id, coalesce(n, 0) AS n_links, least(v.vec_id, coalesce(c, v.vec_id)) AS component_id FROM v
  LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY 1) x ON x.a = v.vec_id LEFT JOIN (SELECT a, min(b) AS c FROM r GROUP BY 1) y ON y.a = v.vec_id)
SELECT *, vec_id = component_id AS kept FROM o""",
    "op7_suffix_array_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 49)) AS i FROM d)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS m FROM w) WHERE m < doc_id),
n AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM hit),
sp AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM n) GROUP BY 1, 2),
st AS (SELECT doc_id, count(*) AS spans, CAST(sum(b - a) AS BIGINT) AS removed, max(b) AS last FROM sp GROUP BY 1),
gap AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e FROM sp
  UNION ALL SELECT d.doc_id, coalesce(last, 0), length(h) // 2 FROM d LEFT JOIN st ON st.doc_id = d.doc_id),
k AS (SELECT d.doc_id, string_agg(substr(h, 2 * s + 1, 2 * (e - s)), '' ORDER BY s) AS kept FROM gap JOIN d ON d.doc_id = gap.doc_id GROUP BY 1)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN k ON k.doc_id = d.doc_id LEFT JOIN st ON st.doc_id = d.doc_id""",
    "op8_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS g FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b, c = x.k AND c = y.k AS same FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.k + y.k - c) - 1e-9),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
o AS (SELECT w.doc_id, least(w.doc_id, coalesce(m, w.doc_id)) AS class_id, coalesce(t, 0) AS n_links, least(w.doc_id, coalesce(c, w.doc_id)) AS component_id FROM w
  LEFT JOIN (SELECT a, count(*) AS t, min(b) FILTER (same) AS m FROM l GROUP BY 1) x ON x.a = w.doc_id LEFT JOIN (SELECT a, min(b) AS c FROM r GROUP BY 1) y ON y.a = w.doc_id)
SELECT *, doc_id = component_id AS kept FROM o""",
    "op11_prefix_trie": r"""
WITH t AS (SELECT conv_id, role, text, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, md5(strlen(role) || ':' || role || text) AS k,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
b AS (SELECT conv_id, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, CAST(x AS BIGINT)) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS crc FROM (SELECT DISTINCT conv_id FROM t)),
h AS (SELECT conv_id, xor(crc, 4294967295) % 4 AS h FROM b),
u AS (SELECT h.conv_id, 0 AS late, pos, k, words FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 20 AND pos <= h
  UNION ALL SELECT h.conv_id, 1, pos, k, words FROM h JOIN t ON t.conv_id = h.conv_id AND pos > h),
p AS (SELECT conv_id, row_number() OVER o AS depth, md5(string_agg(k, '') OVER o) AS k, words FROM u WINDOW o AS (PARTITION BY conv_id ORDER BY late, pos ROWS UNBOUNDED PRECEDING)),
n AS (SELECT * FROM p UNION ALL SELECT conv_id, 0, '', 0 FROM h),
m AS (SELECT *, lag(k) OVER o AS above, lead(k) OVER o IS NULL AS ends FROM n WINDOW o AS (PARTITION BY conv_id ORDER BY depth)),
v AS (SELECT k, min(conv_id) AS conv_id, depth, any_value(above) AS above, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS own,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY k, depth),
f AS (SELECT above, count(*) AS n FROM v GROUP BY 1),
w AS (SELECT v.*, coalesce(f.n, 0) AS n_children FROM v LEFT JOIN f ON f.above = v.k),
d AS (SELECT DISTINCT x.k AS top, y.k FROM n x JOIN n y ON x.conv_id = y.conv_id AND y.depth >= x.depth),
s AS (SELECT top, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(own) AS BIGINT) AS saved_tokens FROM d JOIN w ON w.k = d.k GROUP BY 1)
SELECT w.conv_id, w.depth, a.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256 FROM w JOIN s ON s.top = w.k LEFT JOIN w a ON a.k = w.above""",
    "op12_lexical_search": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
c AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, n_words, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, len(w) AS n_words, unnest(w) AS t FROM d) GROUP BY 1, 2, 3),
f AS (SELECT t, CAST(count(*) AS BIGINT) AS df FROM p GROUP BY 1),
i AS (SELECT doc_id, p.t, CAST(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n_words * n) // l))) AS s FROM p JOIN f ON f.t = p.t, c),
r AS (SELECT item_id, doc_id, CAST(sum(s) AS BIGINT) AS score FROM q JOIN i ON i.t = q.t GROUP BY 1, 2 HAVING sum(s) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 10""",
    "op13_source_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
v AS (SELECT *, [5, 2, 1][CAST(place % 3 AS BIGINT) + 1] AS weight FROM p),
f AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS shares, sum(source_size) OVER o AS upto, sum(weight) OVER o AS w_upto
  FROM v WINDOW o AS (ORDER BY source_size / weight, place ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, 4 * source_size * (shares - w_upto + weight) <= (3 * total - 4 * (upto - source_size)) * weight AS capped FROM f),
h AS (SELECT *, 3 * total - 4 * coalesce(sum(source_size) FILTER (capped) OVER (), 0) AS rest, sum(weight) FILTER (NOT capped) OVER () AS parts FROM g),
t AS (SELECT source, source_size, CASE WHEN capped THEN 2.0 * source_size ELSE CAST(rest * weight AS DOUBLE) / CAST(2 * parts AS DOUBLE) END AS target,
  CAST(CASE WHEN capped THEN 2 * source_size ELSE (rest * weight) // (2 * parts) END AS BIGINT) AS take FROM h),
e AS (SELECT doc_id, size, t.*, unnest(range(2)) AS epoch FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
u AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY epoch, md5(doc_id || '|' || epoch || '|17') ROWS UNBOUNDED PRECEDING) AS upto FROM e)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, CAST(sum(greatest(0, least(upto, take) - (upto - size))) AS BIGINT) AS taken FROM u GROUP BY ALL""",
}
