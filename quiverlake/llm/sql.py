"""DuckDB SQL for the rows of the operators' queries, where SQL can express them.

Each query works from the texts and contracts alone, pair by pair where need be;
only parameters are shared with the operators.
"""

from __future__ import annotations

import math

from .kernels import KEY_BASE, KEY_FACTOR
from .quality import FLOOR, GROWTH, ODD, OFF, PRIOR, RARE, RATES, SIZES, SPREAD, TAIL
from .substring_dedup import MANY_WORDS, REACH, SENTENCES, WORDS

_WORD = r"'[^\x20\x09-\x0D]+'"
_SPACE = r"[\x20\x09-\x0D]"
_WORDS = rf"coalesce(len(regexp_extract_all(text, {_WORD})), 0)"
_RULES = ", ".join(f"('{m}', {str(m in RARE).lower()}, '{SIZES.get(m, '')}')" for m in (*RATES, *SIZES.values()))
_WINDOW = " || ' ' || ".join(["x"] + [f"lead(x, {j}) OVER o" for j in range(1, 8)])


def _lower(text: str) -> str:
    """A-Z only."""
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


#: A run's end is long enough, given its first sentence a and its last one b.
_LONG = f"(b.s - a.s >= {SENTENCES - 1} AND b.upto - a.upto + a.words >= {WORDS}) OR b.upto - a.upto + a.words >= {MANY_WORDS}"

SQL: dict[str, str] = {
    "op1_mix_sources": rf"""
WITH d AS (SELECT doc_id, source, CAST({_WORDS} AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight FROM s),
r AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS level
      FROM r WINDOW b AS (ORDER BY ratio, weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT min_by(level, ratio) AS x FROM l WHERE level <= ratio),
t AS (SELECT source, source_size, CASE WHEN x IS NULL THEN cap ELSE least(cap, x * weight) END AS target FROM l, x),
c AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
      CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c""",
    "op2_quality_rules": rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, {_WORD}), []) AS words FROM documents),
p AS MATERIALIZED (SELECT doc_id, unnest(words) AS x, generate_subscripts(words, 1) AS i FROM d),
v AS (SELECT doc_id, i, x = lead(x, 1) OVER o AS stutter, {_WINDOW} AS win FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT doc_id, i FROM v WHERE win IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
c AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS place FROM f) GROUP BY doc_id),
h AS (SELECT doc_id, count(*) FILTER (WHERE stutter) AS n FROM v GROUP BY doc_id),
y AS (SELECT *, list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, {_WORD})) AS lines FROM d),
m AS MATERIALIZED (SELECT y.doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda s: length(s))), 0) AS BIGINT) AS word_chars,
      CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
      coalesce(c.n, 0) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines, coalesce(h.n, 0) AS n_stutters FROM y LEFT JOIN c ON c.doc_id = y.doc_id LEFT JOIN h ON h.doc_id = y.doc_id),
j AS MATERIALIZED (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
u(measure, rare, relative) AS (VALUES {_RULES}),
q AS MATERIALIZED (SELECT doc_id, lang, source, base_failed, measure, rare, coalesce(CASE measure WHEN 'symbol_rate' THEN n_symbols / nullif(word_chars, 0) WHEN 'word_length' THEN word_chars / nullif(n_words, 0)
      WHEN 'duplicate_line_rate' THEN n_dup_lines / nullif(n_lines, 0) WHEN 'repeat_rate' THEN n_repeat_words / nullif(n_words, 0) WHEN 'stutter_rate' THEN n_stutters / nullif(n_words, 0)
      WHEN 'word_chars' THEN word_chars ELSE n_words END, 0.0::DOUBLE) AS rate FROM j, u),
b AS (SELECT lang, source, measure, rare, CASE WHEN rate <= {FLOOR!r}::DOUBLE THEN 0 ELSE CAST(ceil(ln(rate / {FLOOR!r}::DOUBLE) / {math.log(GROWTH)!r}::DOUBLE) AS INTEGER) END AS bin FROM q WHERE NOT base_failed),
n AS (SELECT lang, source, measure, grouping(lang, source) AS level, list_sort(list(bin)) AS bins FROM b WHERE NOT rare OR bin > 0 GROUP BY GROUPING SETS ((lang, source, measure), (lang, measure), (measure))),
a AS MATERIALIZED (SELECT lang, source, measure, level, len(bins) AS rows, list_transform([0.25, 0.5, 0.75], lambda s: CASE bins[CAST(ceil(len(bins) * s) AS BIGINT)] WHEN 0 THEN 0.0::DOUBLE ELSE {FLOOR!r}::DOUBLE * pow({GROWTH!r}::DOUBLE, bins[CAST(ceil(len(bins) * s) AS BIGINT)] - 0.5) END) AS quartile FROM n),
y1 AS (SELECT DISTINCT lang, source FROM b),
y2 AS (SELECT y1.lang, y1.source, u.measure, u.rare, u.relative, o.rows AS rows, o.quartile AS own,
      [CASE WHEN l.rows IS NULL THEN e.quartile[i] ELSE (l.rows * l.quartile[i] + e.quartile[i] * {PRIOR}) / (l.rows + {PRIOR}) END FOR i IN [1, 2, 3]] AS wide
      FROM y1 CROSS JOIN u LEFT JOIN a o ON o.level = 0 AND o.measure = u.measure AND o.lang IS NOT DISTINCT FROM y1.lang AND o.source IS NOT DISTINCT FROM y1.source
      LEFT JOIN a l ON l.level = 1 AND l.measure = u.measure AND l.lang IS NOT DISTINCT FROM y1.lang LEFT JOIN a e ON e.level = 3 AND e.measure = u.measure),
t AS MATERIALIZED (SELECT *, [CASE WHEN rows IS NULL THEN wide[i] ELSE (rows * own[i] + wide[i] * {PRIOR}) / (rows + {PRIOR}) END FOR i IN [1, 2, 3]] AS v FROM y2),
z AS (SELECT t.lang, t.source, t.measure, CASE WHEN t.rare THEN coalesce(t.v[3] + (t.v[3] - t.v[1]) * {TAIL!r}::DOUBLE, 1.0) ELSE t.v[2] + (t.v[2] - t.v[1]) * {SPREAD!r}::DOUBLE + coalesce({ODD!r}::DOUBLE / s.v[1], t.v[2] * {OFF!r}::DOUBLE) END AS hi,
      CASE WHEN t.measure = 'word_length' THEN t.v[2] - (t.v[3] - t.v[2]) * {SPREAD!r}::DOUBLE - t.v[2] * {OFF!r}::DOUBLE END AS lo
      FROM t LEFT JOIN t s ON s.measure = t.relative AND s.lang IS NOT DISTINCT FROM t.lang AND s.source IS NOT DISTINCT FROM t.source WHERE t.measure NOT IN ('word_chars', 'n_words')),
k AS (SELECT doc_id, bool_and(rate <= hi AND (lo IS NULL OR rate >= lo)) AS fine
      FROM q JOIN z ON z.measure = q.measure AND z.lang IS NOT DISTINCT FROM q.lang AND z.source IS NOT DISTINCT FROM q.source WHERE NOT base_failed GROUP BY doc_id)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stutters, base_failed, coalesce(k.fine, false) AS kept FROM j LEFT JOIN k ON k.doc_id = j.doc_id""",
    "op3_ngram_jaccard": rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({_lower('text')}, {_WORD}), []) AS words FROM documents),
p AS (SELECT doc_id, len(words) AS n, unnest(words) AS x, generate_subscripts(words, 1) AS i FROM w),
k AS (SELECT doc_id, CASE WHEN n >= 5 THEN x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o
             WHEN i = 1 THEN concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o) END AS shingle FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS MATERIALIZED (SELECT DISTINCT doc_id, shingle FROM k WHERE shingle IS NOT NULL),
z AS MATERIALIZED (SELECT w.doc_id, count(g.doc_id) AS n FROM w LEFT JOIN g ON g.doc_id = w.doc_id GROUP BY w.doc_id),
s AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM g a JOIN g b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM s JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * same >= 80 * (x.n + y.n - same)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT z.doc_id, z.n AS n_shingles, m.component_id FROM z JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = z.doc_id""",
    "op4_substring_dedup": rf"""
WITH d AS (SELECT doc_id, text, coalesce(regexp_extract(text, '^{_SPACE}*'), '') AS head, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+{_SPACE}*'), []) AS tokens FROM documents),
p AS (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS i FROM d),
v AS (SELECT *, {_lower(f'regexp_extract(token, {_WORD})')} AS word FROM p),
z AS (SELECT word, list_reduce(list_transform(range(strlen(word)), lambda i: CAST('0x' || substr(hex(encode(word)), CAST(2 * i + 1 AS BIGINT), 2) AS UBIGINT)), lambda a, b: (a * {KEY_BASE} + b) % 4294967296) % 4294967296 * {KEY_FACTOR} % 4294967296 AS k
      FROM (SELECT DISTINCT word FROM v)),
w AS (SELECT doc_id, token, i, v.word, CASE WHEN regexp_matches(token, '^[^\x20\x09-\x0D]*[.!?]({_SPACE}|$)') OR contains(token, chr(10))
      OR k = min(k) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {REACH} PRECEDING AND {REACH} FOLLOWING) THEN 1 ELSE 0 END AS ends FROM v JOIN z ON z.word = v.word),
n AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM w),
s AS MATERIALIZED (SELECT doc_id, CAST(s AS BIGINT) AS s, string_agg(token, '' ORDER BY i) AS piece, string_agg(word, ' ' ORDER BY i) AS key, count(*) AS words FROM n GROUP BY doc_id, s),
c AS MATERIALIZED (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY s) AS upto FROM s),
f AS (SELECT a.doc_id, a.s AS a, min(b.s) AS b FROM c a JOIN c b ON b.doc_id = a.doc_id AND b.s BETWEEN a.s AND a.s + {MANY_WORDS}
      WHERE {_LONG} GROUP BY a.doc_id, a.s),
g AS (SELECT b.doc_id, max(a.s) AS a, b.s AS b FROM c a JOIN c b ON b.doc_id = a.doc_id AND b.s BETWEEN a.s AND a.s + {MANY_WORDS}
      WHERE {_LONG} GROUP BY b.doc_id, b.s),
r AS (SELECT doc_id, a, b FROM f UNION SELECT doc_id, a, b FROM g),
k AS (SELECT r.doc_id, r.a, r.b, string_agg(s.key, chr(10) ORDER BY s.s) AS key FROM r JOIN s ON s.doc_id = r.doc_id AND s.s BETWEEN r.a AND r.b GROUP BY 1, 2, 3),
o AS (SELECT doc_id, a, b FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, a) > 1),
x AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS s FROM o),
m AS (SELECT s.doc_id, count(*) AS n_sentences, count(x.s) AS n_removed, CAST(coalesce(sum(words) FILTER (WHERE x.s IS NOT NULL), 0) AS BIGINT) AS words_removed,
      coalesce(string_agg(piece, '' ORDER BY s.s) FILTER (WHERE x.s IS NULL), '') AS rest, arg_min(x.s IS NULL, s.s) AS first_stays, arg_max(x.s IS NULL, s.s) AS last_stays
      FROM s LEFT JOIN x ON x.doc_id = s.doc_id AND x.s = s.s GROUP BY s.doc_id)
SELECT d.doc_id, CASE WHEN coalesce(n_removed, 0) = 0 THEN text WHEN last_stays THEN CASE WHEN first_stays THEN head ELSE '' END || rest
       ELSE regexp_replace(CASE WHEN first_stays THEN head ELSE '' END || rest, '{_SPACE}+$', '') END AS text,
       coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed, coalesce(words_removed, 0) AS words_removed FROM d LEFT JOIN m ON m.doc_id = d.doc_id""",
    "op10_warc": """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN last IS NULL OR page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to FROM m""",
}
