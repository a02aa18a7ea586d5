"""DuckDB SQL that gives the rows of those queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: A later line goes if an earlier one shares its words, or, both of 6 words or more, all but one deleted, inserted or replaced.
LINES = rf"""
WITH lines AS (
  SELECT doc_id, u.i - 1 AS line, u.t AS t, {_WORDS.format("u.t")} AS w
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL) d,
       LATERAL (SELECT unnest(d.s) AS t, unnest(range(1, len(d.s) + 1)) AS i) u
), whole AS (
  SELECT doc_id, line, w, row_number() OVER (ORDER BY doc_id, line) AS ord FROM lines WHERE len(w) >= 1
), full_keys AS (
  SELECT array_to_string(w, ' ') AS k, len(w) AS n, min(ord) AS first FROM whole GROUP BY 1, 2
), variants AS (
  SELECT ord, p, array_to_string(list_concat(w[1:p - 1], w[p + 1:]), ' ') AS k
  FROM (SELECT ord, w, unnest(range(1, len(w) + 1)) AS p FROM whole WHERE len(w) >= 6)
), variant_keys AS (
  SELECT k, min(ord) AS first FROM variants GROUP BY 1
), place_keys AS (
  SELECT k, p, min(ord) AS first FROM variants GROUP BY 1, 2
), gone AS (
  SELECT l.ord FROM whole l JOIN full_keys f ON f.k = array_to_string(l.w, ' ') WHERE f.first < l.ord
  UNION SELECT l.ord FROM whole l JOIN variant_keys v ON v.k = array_to_string(l.w, ' ') WHERE v.first < l.ord AND len(l.w) >= 6
  UNION SELECT v.ord FROM variants v JOIN full_keys f ON f.k = v.k WHERE f.first < v.ord AND f.n >= 6
  UNION SELECT v.ord FROM variants v JOIN place_keys s ON s.k = v.k AND s.p = v.p WHERE s.first < v.ord
), judged AS (
  SELECT n.doc_id, n.line, n.t, g.ord IS NOT NULL AS removed
  FROM lines n LEFT JOIN whole l ON l.doc_id = n.doc_id AND l.line = n.line LEFT JOIN gone g ON g.ord = l.ord
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE removed) AS n_removed,
       sha256(coalesce(string_agg(t, chr(10) ORDER BY line) FILTER (WHERE NOT removed), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

#: A window's words start in an earlier document: every word that it covers goes.
PASSAGES = rf"""
WITH words AS (
  SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents
), windows AS (
  SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM words)
), first AS (
  SELECT k, min(doc_id) AS doc_id FROM windows GROUP BY 1
), gone AS (
  SELECT DISTINCT h.doc_id, h.p + o.o AS p
  FROM (SELECT w.doc_id, w.p FROM windows w JOIN first f ON f.k = w.k WHERE f.doc_id < w.doc_id) h, (SELECT unnest(range(0, 13)) AS o) o
), each AS (
  SELECT x.doc_id, x.p, x.t, g.p IS NOT NULL AS removed
  FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS t FROM words) x
  LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.p = x.p
), kept AS (
  SELECT doc_id, count(*) FILTER (WHERE removed) AS n_removed,
         string_agg(t, ' ' ORDER BY p) FILTER (WHERE NOT removed) AS kept
  FROM each GROUP BY doc_id
)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON k.doc_id = w.doc_id
"""

#: Cosine in double precision against every other valid vector, the five largest.
NEAREST = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS rank FROM p
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

#: Units as a list, cut at places drawn from the id; the restored text is the text.
MIDDLES = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u
  FROM documents
), drawn AS (
  SELECT *, len(u) AS n, list_transform(range(0, 4), lambda k: CAST('0x' || h[8 * k + 1:8 * k + 8] AS BIGINT)) AS r FROM d
), cut AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 90 THEN 'plain'
              WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""

#: Every order and step by plain conditions on the five failures.
AUDIT = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents
), first AS (
  SELECT t, min(doc_id) AS f FROM d GROUP BY t
), said AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), failing AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN len(w) < 200 WHEN 'B' THEN 100 * len(list_distinct(w)) < 50 * len(w)
           WHEN 'C' THEN 100 * (length(d.t) - length(regexp_replace(d.t, '[A-Z]', '', 'g'))) > 2 * length(d.t)
           WHEN 'D' THEN regexp_matches(d.t, '[#$%&*|]') ELSE coalesce(d.doc_id > f, false) END) AS fails
  FROM d JOIN first ON first.t = d.t LEFT JOIN said ON said.doc_id = d.doc_id
), counted AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM failing GROUP BY part, fails
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
  SELECT filter_order, CAST(s AS INTEGER) AS step, filter_order[s:s] AS own, string_split(filter_order[1:s - 1], '') AS before
  FROM (SELECT filter_order, unnest(range(1, 6)) AS s FROM orders)
), judged AS (
  SELECT part, filter_order, step, own, n, g, x, list_contains(fails, own) AS f, list_has_any(fails, before) AS earlier, fails = [own] AS alone
  FROM counted, steps
), summed AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE NOT f AND NOT earlier), 0) AS kept, coalesce(sum(n) FILTER (WHERE f AND NOT earlier), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE f AND earlier), 0) AS redundant, coalesce(sum(n) FILTER (WHERE alone), 0) AS unique_fails,
         coalesce(sum(g) FILTER (WHERE f AND NOT earlier), 0) AS good_lost, coalesce(sum(x) FILTER (WHERE f AND NOT earlier), 0) AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM summed
"""

ORACLES = {"op1_line_dedup": LINES, "op2_substring_dedup": PASSAGES, "op11_fill_in_middle": MIDDLES, "op12_filter_audit": AUDIT}
