"""Queries of this subpackage as SQL over the same tables, where SQL can express them."""

from __future__ import annotations

from scrapelake.llm import divergence, quality

_SPACE = r"[\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{_SPACE}'), lambda x: x <> '')"


_QUALITY = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, {_words("coalesce(text, '')")} AS w
  FROM documents),
t AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM t),
r AS (
  SELECT doc_id, count(DISTINCT k) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM g WHERE n > 1) GROUP BY doc_id),
l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
    unnest(range(len(string_split(text, chr(10))))) AS place FROM d),
ln AS (
  SELECT *, {_words("line")} AS lw FROM l),
m AS (
  SELECT doc_id, source, line, place, len(lw) AS n, {_LOWER.format("array_to_string(lw, ' ')")} AS norm,
    row_number() OVER (PARTITION BY doc_id, line ORDER BY place) > 1 AS dup
  FROM ln WHERE len(lw) > 0),
f AS (
  SELECT source, norm FROM m GROUP BY source, norm HAVING count(DISTINCT doc_id) > {quality.LINE_LIMIT}),
lost AS (
  SELECT m.doc_id, sum(n) AS lost_words FROM m JOIN f
    ON m.norm = f.norm AND m.source IS NOT DISTINCT FROM f.source GROUP BY m.doc_id),
dups AS (SELECT doc_id, count(*) FILTER (dup) AS n_dup_lines FROM m GROUP BY doc_id),
b AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(lost_words, 0)::BIGINT AS lost_words
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN dups USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, n_words < {quality.LEAST_WORDS}
    OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed,
  NOT base_failed AND 100 * (n_words - lost_words) >= {quality.LEAST_KEPT} * n_words AS kept FROM b
"""

_JACCARD = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_words(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, w[i:i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY ALL),
k AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM k UNION SELECT b, a FROM k),
reach AS (
  SELECT doc_id, doc_id AS other FROM d
  UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON e.a = reach.other)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(other) AS component_id
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id, n
"""

_TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, c.e) DESC, c.vec_id) AS rank
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
WHERE rank <= 20
"""

_SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM g),
x AS (
  SELECT doc_id, list(DISTINCT k) AS gone
  FROM (SELECT doc_id, unnest(range(i, i + 13)) AS k FROM f WHERE first < doc_id) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda v, i:
    NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
"""

_DIVERGENCE = f"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t
  FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(t) AS term FROM d) GROUP BY ALL),
k AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(t)) AS term FROM d)
  GROUP BY ALL HAVING count(*) >= {divergence.LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
x AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n
  FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
l AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM x GROUP BY ALL),
p AS (
  SELECT lang, source, term, n, 1 + {divergence.SCALE}::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p
  FROM x JOIN v USING (lang)),
q AS (
  SELECT lang, term, 1 + {divergence.SCALE}::HUGEINT * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q
  FROM l JOIN v USING (lang)),
s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, r::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM u)
WHERE part = 'pair' OR r <= {divergence.TOP_TERMS}
"""

_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
WHERE rank <= 3
"""

ORACLE = {
    "op1_quality_rules": _QUALITY,
    "op2_jaccard_join": _JACCARD,
    "op3_topk_search": _TOPK,
    "op10_substring_dedup": _SUBSTRINGS,
    "op12_divergence_audit": _DIVERGENCE,
    "op13_hard_negatives": _NEGATIVES,
}
