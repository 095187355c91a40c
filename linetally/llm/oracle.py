"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

from linetally.llm.licences import BASE_PHRASES, LEAST_SHARE, TEMPLATES

ORACLE: dict[str, str] = {}

_LINES = """
lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (
  SELECT doc_id, i, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
repeated AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT keyed.*, coalesce(repeated.keeper <> doc_id, false) AS gone
  FROM keyed LEFT JOIN repeated USING (k))
"""

ORACLE["op9_line_index"] = f"""
WITH {_LINES}
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_WORDS = r"""
SELECT {key} AS key, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
FROM {table}
"""

ORACLE["op4_wu_manber"] = f"""
WITH d AS ({_WORDS.format(key="doc_id", table="documents")}),
b AS ({_WORDS.format(key="item_id", table="benchmark")}),
windows AS (
  SELECT DISTINCT key AS item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS t
  FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS r(i) WHERE len(w) > 0),
places AS (
  SELECT key AS doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS t
  FROM d, (SELECT DISTINCT m FROM windows) AS lengths, unnest(range(1, len(w) - m + 2)) AS r(i)),
hits AS (SELECT doc_id, i, m, item_id FROM places JOIN windows USING (m, t)),
per_word AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + m)) AS r(p) GROUP BY doc_id),
per_item AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.key AS doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per_word ON d.key = per_word.doc_id LEFT JOIN per_item ON d.key = per_item.doc_id
"""

_ESCAPES = r"""length({x}) - length(replace({x}, '\', '')) + length(replace({x}, '</turn>', '</turn>!')) - length({x})
  + length(array_to_string(regexp_extract_all({x}, '#{{3,}}'), '')) - 2 * len(regexp_extract_all({x}, '#{{3,}}'))"""

ORACLE["op10_chat"] = rf"""
WITH turns AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, 4 + length(role) + {_ESCAPES.format(x="role")} + length(role) - length(replace(role, ':', ''))
         + 2 + length(text) + {_ESCAPES.format(x="text")} + 8 AS chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

_SHINGLES = r"""
d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS t
  FROM d, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
  FROM s AS x JOIN s AS y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b
  WHERE 100 * shared >= 85 * (na.n + nb.n - shared)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
"""

ORACLE["op3_set_join"] = f"""
WITH RECURSIVE {_SHINGLES.strip()}
reach AS (
  SELECT a AS doc_id, least(a, b) AS r FROM edges
  UNION
  SELECT edges.b, reach.r FROM reach JOIN edges ON edges.a = reach.doc_id WHERE reach.r < edges.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce((SELECT min(r) FROM reach WHERE reach.doc_id = d.doc_id), d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id
"""

ORACLE["op11_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS t FROM d, unnest(range(1, len(w) - 18)) AS r(i)),
numbered AS (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS place FROM windows),
gone AS (SELECT DISTINCT doc_id, p FROM numbered, unnest(range(i, i + 20)) AS r(p) WHERE place > 1),
placed AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS r(p)),
marked AS (
  SELECT placed.doc_id, placed.p, placed.word, gone.p IS NOT NULL AS removed
  FROM placed LEFT JOIN gone ON gone.doc_id = placed.doc_id AND gone.p = placed.p),
per_doc AS (
  SELECT doc_id, count(*) FILTER (removed) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT removed) AS kept
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN per_doc ON per_doc.doc_id = d.doc_id
"""

ORACLE["op12_collocations"] = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
g AS (
  SELECT lang, unnest(list_concat(
           list_transform(range(1, len(w) + 1), lambda i: w[i]),
           list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
           list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]),
           list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]))) AS t
  FROM p WHERE len(w) > 0),
f AS (SELECT lang, t, count(*) AS a FROM g GROUP BY lang, t HAVING count(*) >= 30),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
c AS (SELECT lang, t, string_split(t, ' ') AS w, a FROM f WHERE contains(t, ' ')),
parts AS (
  SELECT c.lang, t, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:len(w)], ' ') AS rest
  FROM c JOIN (VALUES (1), (2), (3)) AS ks(k) ON k < len(w)),
cuts AS (
  SELECT parts.lang, parts.t, parts.a, k, x.a AS l, y.a AS r, (CAST(2000000 AS HUGEINT) * parts.a) // (x.a + y.a) AS score
  FROM parts JOIN f AS x ON x.lang = parts.lang AND x.t = head JOIN f AS y ON y.lang = parts.lang AND y.t = rest),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, t ORDER BY score, k) = 1),
inside AS (
  SELECT lang, a, unnest(CASE len(w)
    WHEN 3 THEN [w[1] || ' ' || w[2], w[2] || ' ' || w[3]]
    ELSE [w[1] || ' ' || w[2], w[2] || ' ' || w[3], w[3] || ' ' || w[4],
          w[1] || ' ' || w[2] || ' ' || w[3], w[2] || ' ' || w[3] || ' ' || w[4]] END) AS t
  FROM c WHERE len(w) > 2),
longer AS (SELECT lang, t, max(a) AS a FROM inside GROUP BY lang, t),
kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN longer ON longer.lang = lowest.lang AND longer.t = lowest.t
  WHERE longer.a IS NULL OR 100 * longer.a < 80 * lowest.a),
ranked AS (
  SELECT lang, t AS phrase, a, l, r, CAST(score AS BIGINT) AS score,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, t) AS rank
  FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000
"""

ORACLE["op13_filter_audit"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
firsts AS (SELECT text, min(doc_id) AS first_id FROM t GROUP BY text),
good_ids AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
toxic_ids AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
facts AS (
  SELECT part,
         CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * (length(t.text) - length(regexp_replace(t.text, '[A-Z]', '', 'g'))) > 3 * length(t.text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t.text, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN firsts.first_id < doc_id THEN 16 ELSE 0 END AS mask,
         doc_id IN (SELECT doc_id FROM good_ids) AS good, doc_id IN (SELECT doc_id FROM toxic_ids) AS toxic
  FROM t JOIN firsts ON firsts.text = t.text),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM f AS a, f AS b, f AS c, f AS d, f AS e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, f.bit,
         (SELECT coalesce(sum(x.bit), 0) FROM f AS x WHERE instr(filter_order, x.letter) < step) AS earlier
  FROM orders, range(1, 6) AS r(step) JOIN f ON f.letter = filter_order[step]),
counted AS (
  SELECT part, filter_order, step, bit,
         count(*) FILTER (mask & bit = 0 AND mask & earlier = 0) AS kept,
         count(*) FILTER (mask & bit <> 0 AND mask & earlier = 0) AS removed,
         count(*) FILTER (mask & bit <> 0 AND mask & earlier <> 0) AS redundant,
         count(*) FILTER (mask = bit) AS unique_fails,
         count(*) FILTER (mask & bit <> 0 AND mask & earlier = 0 AND good) AS good_lost,
         count(*) FILTER (mask & bit <> 0 AND mask & earlier = 0 AND toxic) AS toxic_lost
  FROM facts, (SELECT filter_order, step, bit, CAST(earlier AS INTEGER) AS earlier FROM steps) GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted
"""


def _rows(values) -> str:
    return ", ".join("(" + ", ".join(repr(v) for v in row) + ")" for row in values)


_TEMPLATE_WORDS = _rows((t, at, w) for t, x in enumerate(TEMPLATES) for at, w in enumerate(x.text.split()))
_TEMPLATE_SIZES = _rows((t, x.label, len(x.text.split()), len(x.keys)) for t, x in enumerate(TEMPLATES))
_PHRASES = _rows((p, p.split()[0], len(p.split())) for p in sorted({*BASE_PHRASES, *(k for x in TEMPLATES for k in x.keys)}))
_KEYS = _rows((t, k) for t, x in enumerate(TEMPLATES) for k in x.keys)

#: The licence scan by votes of all words. Tests compare it row by row; it is no registered twin, as frames
#: turn integers that may be null into other types on either side.
LICENCES = rf"""
WITH tw(t, pos, w) AS (VALUES {_TEMPLATE_WORDS}),
sizes(t, label, n, n_keys) AS (VALUES {_TEMPLATE_SIZES}),
phrases(phrase, w, m) AS (VALUES {_PHRASES}),
keys(t, phrase) AS (VALUES {_KEYS}),
base(phrase, label) AS (VALUES {_rows(BASE_PHRASES.items())}),
d AS ({_WORDS.format(key="doc_id", table="documents")}),
placed AS (SELECT key AS doc_id, d.w AS words, i, d.w[i] AS w FROM d, unnest(range(1, len(d.w) + 1)) AS r(i)),
said AS (
  SELECT doc_id, phrase, i FROM placed JOIN phrases USING (w) WHERE array_to_string(words[i:i + m - 1], ' ') = phrase),
votes AS (SELECT doc_id, t, i - pos AS s, count(*) AS k FROM placed JOIN tw USING (w) GROUP BY ALL),
near AS (SELECT doc_id, t, s, label, n, n_keys, k / CAST(n AS DOUBLE) AS share FROM votes JOIN sizes USING (t) WHERE k / CAST(n AS DOUBLE) >= {LEAST_SHARE}),
notices AS (
  SELECT near.doc_id, near.t, s, any_value(label) AS label, any_value(share) AS share
  FROM near JOIN keys ON keys.t = near.t JOIN said ON said.doc_id = near.doc_id AND said.phrase = keys.phrase AND said.i BETWEEN s - 2 AND s + n + 2
  GROUP BY near.doc_id, near.t, s, n_keys HAVING count(DISTINCT keys.phrase) = n_keys),
b AS (SELECT doc_id, label, i FROM said JOIN base USING (phrase)),
totals AS (SELECT doc_id, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word FROM b GROUP BY doc_id),
base_labels AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS x FROM (SELECT DISTINCT doc_id, label FROM b) GROUP BY doc_id),
all_labels AS (
  SELECT doc_id, string_agg(label, ',' ORDER BY label) AS x
  FROM (SELECT doc_id, label FROM b UNION SELECT doc_id, label FROM notices) GROUP BY doc_id),
best AS (SELECT doc_id, max(share) AS share FROM notices GROUP BY doc_id)
SELECT d.key AS doc_id, len(d.w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels.x, '') AS base_labels, coalesce(all_labels.x, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score
FROM d LEFT JOIN totals ON totals.doc_id = d.key LEFT JOIN base_labels ON base_labels.doc_id = d.key
LEFT JOIN all_labels ON all_labels.doc_id = d.key LEFT JOIN best ON best.doc_id = d.key
"""
