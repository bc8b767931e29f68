"""DuckDB statements for the registered queries of this subpackage."""

from corpuskit.llm.license_scan import TEMPLATES

_TEMPLATE_ROWS = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in sorted(TEMPLATES.items()))

QUALITY_RULES = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
lines AS (
  SELECT doc_id, line, count(*) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
dup AS (SELECT doc_id, sum(n - 1)::BIGINT AS n_dup_lines FROM lines GROUP BY doc_id),
places AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS p, w FROM d WHERE len(w) >= 8),
grams AS (SELECT doc_id, p, array_to_string(w[p:p + 7], ' ') AS gram FROM places),
twice AS (
  SELECT doc_id, p FROM grams
  QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
rep AS (
  SELECT doc_id, count(DISTINCT q)::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(p, p + 8)) AS q FROM twice) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
l AS (SELECT doc_id, sum(n)::BIGINT AS n_lines FROM lines GROUP BY doc_id),
f AS (
  SELECT m.*, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END
     + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
     + CASE WHEN 5 * n_symbols > n_words THEN 4 ELSE 0 END
     + CASE WHEN word_chars < 2 * n_words OR word_chars > 12 * n_words THEN 8 ELSE 0 END
     + CASE WHEN 100 * n_dup_lines > 30 * coalesce(n_lines, 0) THEN 16 ELSE 0 END
     + CASE WHEN n_words = 0 THEN 32 ELSE 0 END)::BIGINT AS failed_rules
  FROM m LEFT JOIN l USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed_rules & 3) <> 0 AS base_failed, (failed_rules & 47) = 0 AS kept, failed_rules
FROM f
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, gram FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]]
      ELSE list_transform(range(1, len(w)), lambda p: w[p] || ' ' || w[p + 1]) END) AS gram FROM d)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
both_sides AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM both_sides JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * common >= 80 * (na.n + nb.n - common)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM d
  UNION
  SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
c AS (SELECT a AS doc_id, min(b)::BIGINT AS component_id FROM reach GROUP BY a)
SELECT c.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""

LEAKS = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
i AS (
  SELECT DISTINCT item_id, CASE WHEN item_id IS NULL THEN array_to_string(w, ' ') ELSE item_id::VARCHAR END AS name, w
  FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark)),
dg AS (
  SELECT r, doc_id, gram, count(*) AS found
  FROM (SELECT r, doc_id, unnest(list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' '))) AS gram FROM d)
  GROUP BY ALL),
ig AS (
  SELECT item_id, name, gram, count(*) AS weight
  FROM (SELECT item_id, name, unnest(list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' '))) AS gram FROM i)
  GROUP BY ALL),
t AS (SELECT item_id IS NULL AS nameless, name, sum(weight)::BIGINT AS total FROM ig GROUP BY ALL),
m AS (
  SELECT r, doc_id, item_id, item_id IS NULL AS nameless, name, sum(least(found, weight))::BIGINT AS matched
  FROM dg JOIN ig USING (gram) GROUP BY ALL),
hit AS (
  SELECT doc_id, item_id, nameless, name, max(matched) AS matched, total
  FROM m JOIN t USING (nameless, name) WHERE 100 * matched >= 80 * total GROUP BY ALL)
SELECT doc_id, item_id, matched, total FROM hit
"""

LINES = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS number
  FROM documents WHERE text IS NOT NULL),
p AS (SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
f AS (SELECT line, min({'d': doc_id, 'n': number}) AS first, strlen(line) AS bytes FROM p GROUP BY line),
c AS (SELECT * FROM f WHERE bytes >= 32),
links AS (
  SELECT x.line AS a, y.line AS b, x.first AS fa, y.first AS fb
  FROM c x JOIN c y ON y.bytes BETWEEN x.bytes AND x.bytes + 2 AND x.line <> y.line
  WHERE (y.bytes > x.bytes OR x.line < y.line) AND levenshtein(x.line, y.line) <= 2),
near AS (
  SELECT line, count(*) AS n, bool_or(other < own) AS later FROM (
    SELECT a AS line, fa AS own, fb AS other FROM links UNION ALL SELECT b, fb, fa FROM links) GROUP BY line),
v AS (
  SELECT doc_id, number, CASE WHEN {'d': doc_id, 'n': number} <> first THEN 1 WHEN later THEN 2 ELSE 0 END AS verdict,
         coalesce(n, 0) AS n_links
  FROM p JOIN f USING (line) LEFT JOIN near USING (line))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (verdict = 1)::BIGINT AS n_equal,
       count(*) FILTER (verdict = 2)::BIGINT AS n_near, sum(n_links)::BIGINT AS n_links,
       coalesce(string_agg(number::VARCHAR, ',' ORDER BY number) FILTER (verdict > 0), '') AS removed
FROM v GROUP BY doc_id
"""

LICENSES = r"""
WITH low AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '(?:[a-z0-9]|[^\x00-\x7F])+') AS w FROM low),
l AS (
  SELECT template, regexp_extract_all(translate(words, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '(?:[a-z0-9]|[^\x00-\x7F])+') AS w
  FROM (VALUES """ + _TEMPLATE_ROWS + r""") AS v(template, words)),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' '))) AS gram
       FROM d),
lg AS (SELECT DISTINCT template, unnest(list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' '))) AS gram
       FROM l),
t AS (SELECT template, count(*)::BIGINT AS total FROM lg GROUP BY template),
m AS (SELECT doc_id, template, count(*)::BIGINT AS matched FROM dg JOIN lg USING (gram) GROUP BY ALL)
SELECT doc_id, split_part(template, '/', 1) AS license, template, matched, total
FROM m JOIN t USING (template) WHERE 100 * matched >= 80 * total
"""

TOKEN_COUNTS = r"""
WITH d AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents),
q AS (SELECT doc_id, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS gone, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS cut
      FROM labels GROUP BY doc_id),
c AS (
  SELECT source, lang, 'words-1' AS tokenizer, coalesce(gone, 0) AS gone,
         len(regexp_extract_all(CASE WHEN cut = 1 THEN string_split(text, chr(10))[1] ELSE text END,
                                '[^\x20\x09-\x0D]+')) AS n
  FROM d LEFT JOIN q USING (doc_id)
  UNION ALL
  SELECT source, lang, 'words-2', coalesce(gone, 0),
         len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]'))
  FROM d LEFT JOIN q USING (doc_id))
SELECT source, lang, tokenizer, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens
FROM c WHERE gone = 0 GROUP BY ALL
"""
