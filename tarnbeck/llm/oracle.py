"""SQL of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Exact similarities by an inverted index of shingles, then components by reachability.
_NEAR_DUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]) END) AS g FROM w),
e AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
pairs AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM s UNION SELECT p.v, reach.r FROM reach JOIN pairs p ON p.u = reach.doc_id)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c ON s.doc_id = c.doc_id"""


def _repeats(n: int) -> str:
    """Characters in words of n-grams that have occurred before in the text, per document."""
    gram = " || ' ' || ".join(f"w[k + {j}]" if j else "w[k]" for j in range(n))
    return f"""(SELECT doc_id, sum(length(w[i])) AS c FROM (SELECT DISTINCT doc_id, w, unnest(range(k, k + {n})) AS i FROM (
      SELECT doc_id, w, k, row_number() OVER (PARTITION BY doc_id, {gram} ORDER BY k) AS r FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS k FROM w)) WHERE r > 1) GROUP BY doc_id)"""


_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_RULES = f"""
WITH w AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
lines AS (SELECT doc_id, line, length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars, row_number() OVER (PARTITION BY doc_id, line) AS r
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (r > 1) AS dup, coalesce(sum(chars) FILTER (r > 1), 0) AS dup_chars FROM lines GROUP BY doc_id),
g AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM w)),
rep AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS i FROM g WHERE n > 1) GROUP BY doc_id),
b AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
        coalesce(n_lines, 0) AS n_lines, coalesce(dup_chars, 0) / greatest(length(array_to_string(w, '')), 1) AS dup_line_char_share,
        {", ".join(f"coalesce(d{n}.c, 0) / greatest(length(array_to_string(w, '')), 1) AS dup_{n}gram_share" for n in (5, 7, 10))}
      FROM w LEFT JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id) {" ".join(f"LEFT JOIN {_repeats(n)} d{n} USING (doc_id)" for n in (5, 7, 10))}),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND dup_line_char_share <= 0.20 AND n_dup_lines <= 0.30 * greatest(n_lines, 1) AND dup_5gram_share <= 0.15 AND dup_7gram_share <= 0.13 AND dup_10gram_share <= 0.10 AS kept,
  dup_line_char_share, dup_5gram_share, dup_7gram_share, dup_10gram_share FROM f"""

ORACLE_SQL: dict[str, str] = {"op1_near_dup": _NEAR_DUP, "op7_quality_rules": _RULES}
