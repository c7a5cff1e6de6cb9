"""DuckDB SQL for the queries whose whole result SQL can say.

The others have a plain version in the tests: tokens need the tokenizer (op2), draws the
hash (op3), and models are learned (op8, op10).
"""

from __future__ import annotations

from .license_scan import COVER, NOTICES, PHRASES, SLACK
from .quality import MAX_COVERED, MAX_REPEAT, MIN_REPEAT

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"
NAME = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
SPACE = r"'[^\x20\x09-\x0D]+'"

OP1 = f"""
WITH b AS (SELECT item_id, regexp_extract_all({LOWERED}, {NAME}) AS w FROM benchmark),
s AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0),
wi AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS said, least(len(w), 10) AS width FROM s),
d AS (SELECT doc_id, regexp_extract_all({LOWERED}, {NAME}) AS w FROM documents),
p AS (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM d, (SELECT DISTINCT width FROM wi)),
h AS (SELECT doc_id, i, width, array_to_string(w[i:i + width - 1], ' ') AS said FROM p WHERE array_to_string(w[i:i + width - 1], ' ') IN (SELECT said FROM wi)),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + width)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM h JOIN wi USING (said) WHERE item_id IS NOT NULL GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

OP4 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {SPACE}) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS said FROM p),
h AS (SELECT doc_id, i FROM s WHERE said IN (SELECT said FROM s GROUP BY said HAVING count(*) > 1)),
n AS (SELECT *, CASE WHEN i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, -1) THEN 1 ELSE 0 END AS opens FROM h),
r AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS no FROM n),
g AS (SELECT doc_id, no, max(i) + 50 - min(i) AS size FROM r GROUP BY doc_id, no)
SELECT doc_id, CAST(sum(size) AS BIGINT) AS n_dup_words, CAST(max(size) AS BIGINT) AS longest FROM g GROUP BY doc_id"""


def _marks(column: str) -> str:
    """Characters that escaping adds to a column."""
    counted = " + ".join(f"(length({column}) - length(replace({column}, '{m}', ''))) // {len(m)}" for m in ("\\", "<s>", "</s>", "[INST]", "[/INST]"))
    return f"({counted})"


OP6 = rf"""
WITH k AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, strpos(text, '\') > 0 OR strpos(text, '</s>') > 0 OR strpos(role, '\') > 0 OR strpos(role, '[INST]') > 0 OR strpos(role, '[/INST]') > 0 AS escaped FROM k),
f AS (SELECT *, 3 + length(role) + CASE WHEN role = 'assistant' THEN 7 ELSE 6 END + length(text) + 4 + CASE WHEN escaped THEN {_marks("role")} + {_marks("text")} ELSE 0 END AS size FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(size) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id"""

OP7 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWERED}, {SPACE}) AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS t FROM x),
z AS (SELECT doc_id, count(*) AS n, md5(string_agg(t, chr(10) ORDER BY t)) AS sig FROM s GROUP BY doc_id),
c AS (SELECT sig, min(doc_id) AS class_id, min(n) AS n FROM z GROUP BY sig),
m AS (SELECT c.class_id, c.n, s.t FROM c JOIN s ON s.doc_id = c.class_id),
j AS (SELECT a.class_id AS a, b.class_id AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM m a JOIN m b ON a.t = b.t AND a.class_id <> b.class_id AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n GROUP BY ALL),
l AS (SELECT a, b FROM j WHERE 100 * shared >= 75 * (na + nb - shared)),
r AS (SELECT class_id AS a, class_id AS b FROM c UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
q AS (SELECT a AS class_id, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a AS class_id, count(*) AS n_links FROM l GROUP BY a)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, coalesce(q.component_id, d.doc_id) AS component_id, coalesce(c.class_id, d.doc_id) AS class_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN z USING (doc_id) LEFT JOIN c ON z.sig = c.sig LEFT JOIN q ON q.class_id = c.class_id LEFT JOIN n ON n.class_id = c.class_id"""

_TEMPLATES = ", ".join(f"({i}, '{k}', {str(b).lower()}, '{t}')" for i, (t, k, b) in enumerate([(t, k, True) for t, k in PHRASES] + [(t, k, False) for t, k in NOTICES]))
_NONE = "list_transform(range(0, n), lambda z: CAST(0 AS BIGINT))"
_BEST = "CASE WHEN x.pos = a.pos THEN a.best ELSE a.now END"
OP9 = f"""
WITH t AS (SELECT i AS template, label, base, string_split(said, ' ') AS w FROM (VALUES {_TEMPLATES}) v(i, label, base, said)),
u AS (SELECT *, unnest(range(0, len(w) - 2)) AS k FROM t), g AS (SELECT template, label, base, len(w) - 2 AS n, k, array_to_string(w[k + 1:k + 3], ' ') AS said FROM u),
d AS (SELECT doc_id, regexp_extract_all({LOWERED}, {NAME}) AS w FROM documents), q AS (SELECT doc_id, w, unnest(range(0, len(w) - 2)) AS pos FROM d WHERE len(w) > 2),
v AS (SELECT doc_id, template, label, base, n, pos, k FROM (SELECT doc_id, pos, array_to_string(w[pos + 1:pos + 3], ' ') AS said FROM q) JOIN g USING (said)),
y AS (SELECT DISTINCT doc_id, template, base, pos - k AS diag FROM v),
o AS (SELECT *, CASE WHEN base OR coalesce(diag - lag(diag) OVER (PARTITION BY doc_id, template ORDER BY diag), {SLACK + 1}) > {SLACK} THEN 1 ELSE 0 END AS opens FROM y),
r AS (SELECT doc_id, template, diag, sum(opens) OVER (PARTITION BY doc_id, template ORDER BY diag) AS run FROM o),
l AS (SELECT v.doc_id, v.template, label, base, n, run, list({{'pos': pos, 'k': k}} ORDER BY pos, k) AS xs FROM v JOIN r ON v.doc_id = r.doc_id AND v.template = r.template AND v.pos - v.k = r.diag GROUP BY ALL),
c AS (SELECT doc_id, label, base, n, xs[1].pos AS first_pos, list_max(list_reduce(list_concat([{{'pos': CAST(-1 AS BIGINT), 'k': CAST(-1 AS BIGINT), 'best': {_NONE}, 'now': {_NONE}}}], list_transform(xs, lambda x: {{'pos': x.pos, 'k': x.k, 'best': {_NONE}, 'now': {_NONE}}})),
  lambda a, x: {{'pos': x.pos, 'k': x.k, 'best': {_BEST}, 'now': list_transform(a.now, lambda z, i: CASE WHEN i = x.k + 1 THEN greatest(z, 1 + coalesce(list_max(({_BEST})[1:x.k]), 0)) ELSE z END)}}).now) / n AS covered FROM l),
s AS (SELECT * FROM c WHERE covered >= CASE WHEN base THEN 1.0 ELSE {COVER} END),
f AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(first_pos) FILTER (base) AS first_word, max(first_pos) FILTER (base) AS last_word, list_sort(list(DISTINCT label) FILTER (base)) AS own, list_sort(list(DISTINCT label)) AS every, max(covered) AS score FROM s GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(array_to_string(own, ','), '') AS base_labels, coalesce(array_to_string(every, ','), '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM d LEFT JOIN f USING (doc_id)"""

OP5 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {SPACE}) AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
one AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id, w[i]) GROUP BY doc_id),
two AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, count(*) AS n FROM x WHERE i < len(w) GROUP BY doc_id, w[i], w[i + 1]) GROUP BY doc_id),
t AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS said FROM x WHERE i + 2 <= len(w)),
p AS (SELECT a.doc_id, a.i, b.i - a.i AS diag FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.said = b.said AND a.i < b.i),
n AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, diag ORDER BY i) AS no FROM p),
r AS (SELECT doc_id, diag, min(i) AS s, count(*) + 2 AS size FROM n GROUP BY doc_id, diag, no),
e AS (SELECT doc_id, s, size FROM r UNION SELECT doc_id, s + diag, size FROM r),
c AS (SELECT doc_id, count(DISTINCT pos) AS again, count(DISTINCT pos) FILTER (size >= {MIN_REPEAT}) AS covered FROM (SELECT doc_id, size, unnest(range(s, s + size)) AS pos FROM e) GROUP BY doc_id),
m AS (SELECT doc_id, max(size) AS longest FROM r GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
k AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dups FROM l WHERE regexp_matches(line, {SPACE}) GROUP BY doc_id),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda v: length(v))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dups, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(again, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(covered, 0) AS BIGINT) AS n_covered,
  CAST(coalesce(longest, CASE WHEN two.n > 1 THEN 2 WHEN one.n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS longest_repeat
  FROM d LEFT JOIN k USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN one USING (doc_id) LEFT JOIN two USING (doc_id)),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND n_covered <= {MAX_COVERED} * n_words AND longest_repeat <= {MAX_REPEAT} AS kept FROM g"""

ORACLES = {"op5_quality_rules": OP5, "op9_license_scan": OP9, "op1_decontamination": OP1, "op4_suffix_dedup": OP4, "op6_chat_format": OP6, "op7_ngram_join": OP7}
