"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

from marketframe.llm import lexical as LEX
from marketframe.llm import quality_rules as QR

W = r"[^\x20\x09-\x0D]+"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


OP10 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line,
             unnest(range(len(string_split(text, chr(10))))) AS pos FROM d),
f AS (SELECT rid, pos, line,
             len(regexp_extract_all(line, '{W}')) AS words,
             length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
             len(regexp_extract_all(line, {_quoted(QR.MARK)})) AS marks,
             len(regexp_extract_all(line, {_quoted(QR.SEPARATOR)})) AS seps,
             regexp_matches(line, {_quoted(QR.CLOSED)}) AS closed,
             regexp_matches(line, {_quoted(QR.BOILERPLATE)}) AS stock,
             row_number() OVER (PARTITION BY rid, line ORDER BY pos) > 1 AS later FROM l),
v AS (SELECT *, words > 0 AND later AS again,
             words > 0 AND (NOT closed OR (marks >= {QR.MARK_LEAST} AND marks * 100 > {QR.MARK_SHARE} * chars)
               OR (seps >= 2 AND seps * 100 >= {QR.NAV_SHARE} * words) OR stock OR later) AS fails FROM f),
g AS (SELECT rid, sum(words)::BIGINT AS n_words, sum(chars)::BIGINT AS word_chars,
             sum(again::BIGINT)::BIGINT AS n_dup_lines,
             sum(CASE WHEN fails THEN chars ELSE 0 END)::BIGINT AS lost_chars FROM v GROUP BY rid),
t AS (SELECT rid, regexp_extract_all(text, '{W}') AS ws FROM d),
w AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win
      FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM t)),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM w),
c AS (SELECT rid, count(DISTINCT i + k)::BIGINT AS n_repeat_words
      FROM r, (SELECT unnest([0, 1, 2]) AS k) WHERE n >= 2 GROUP BY rid),
b AS (SELECT d.doc_id, g.*, coalesce(c.n_repeat_words, 0) AS n_repeat_words,
             len(regexp_extract_all(d.text, '[#*$%&|<>]'))::BIGINT AS n_symbols
      FROM d JOIN g USING (rid) LEFT JOIN c USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < {QR.MIN_WORDS} OR 100 * n_repeat_words > {QR.REPEAT_SHARE} * n_words) AS base_failed,
       NOT (n_words < {QR.MIN_WORDS} OR 100 * n_repeat_words > {QR.REPEAT_SHARE} * n_words)
         AND 100 * lost_chars <= {QR.LOSS_SHARE} * word_chars AS kept, lost_chars
FROM b
"""

OP7 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20
"""

OP2 = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{W}'))::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '') || ':mix-1') AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
o AS (SELECT *, 2 * source_size AS cap, row_number() OVER (ORDER BY 2 * source_size / w, source) AS k FROM s),
a AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
             sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_left,
             1.5::DOUBLE * sum(source_size) OVER () AS budget FROM o),
b AS (SELECT *, (budget - cap_before) / w_left AS level FROM a),
e AS (SELECT min(k) AS k FROM b WHERE cap > w * level),
t AS (SELECT source, source_size, CASE WHEN b.k < e.k OR e.k IS NULL THEN cap::DOUBLE
             ELSE w * (SELECT level FROM b x WHERE x.k = e.k) END AS target FROM b, e),
c AS (SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id::VARCHAR) AS upto,
             sum(size) OVER (PARTITION BY d.source, key, doc_id::VARCHAR) AS same,
             CASE WHEN target >= 2 * source_size THEN 2 WHEN target >= source_size THEN 1 ELSE 0 END AS whole
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN whole < 2 AND target - whole * source_size > 0
                              AND 2 * upto - same <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{W}') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ')
         ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 90 * (x.n + y.n - inter)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, seen) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.seen = e.a),
m AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

OP4 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{W}') AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d)),
g AS (SELECT doc_id, i FROM w QUALIFY doc_id > min(doc_id) OVER (PARTITION BY h)),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM g, (SELECT unnest(range(50)) AS k)),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM d),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.j) AS kept, count(*) AS n FROM x ANTI JOIN gone ON x.doc_id = gone.doc_id AND x.j = gone.j
      GROUP BY x.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

# bytes as pairs of hexadecimal digits
OP5 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, substring(x, 2 * i + 1, 100) AS h
      FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM d)),
g AS (SELECT doc_id, i FROM w QUALIFY doc_id > min(doc_id) OVER (PARTITION BY h)),
u AS (SELECT doc_id, i, i > coalesce(max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 50, -1) AS new FROM g),
v AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM u),
spans AS (SELECT doc_id, run, min(i) AS lo, max(i) + 50 AS hi FROM v GROUP BY doc_id, run),
t AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his
      FROM spans GROUP BY doc_id),
k AS (SELECT d.doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, x,
             list_concat([0], coalesce(his, [])) AS begins, list_concat(coalesce(los, []), [length(x) // 2]) AS ends
      FROM d LEFT JOIN t USING (doc_id))
SELECT doc_id, n_bytes::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans,
       sha256(unhex(array_to_string(list_transform(list_zip(begins, ends),
              lambda z: substring(x, 2 * z[1] + 1, 2 * (z[2] - z[1]))), ''))) AS kept_sha256
FROM k
"""

OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{LEX.TERM}') AS ts
           FROM documents WHERE doc_id IS NOT NULL),
c AS (SELECT count(*)::BIGINT AS nd, sum(len(ts))::BIGINT AS nt FROM d WHERE len(ts) > 0),
t AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(ts) AS term FROM d) GROUP BY rid, term),
f AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
      FROM t, c GROUP BY term, nd),
q AS (SELECT DISTINCT item_id, text,
             unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{LEX.TERM}')) AS term
      FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT item_id, q.text, rid, doc_id,
             sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * len(ts) * nd) // nt))))::BIGINT AS score
      FROM q JOIN t USING (term) JOIN f USING (term) JOIN d USING (rid), c GROUP BY item_id, q.text, rid, doc_id)
SELECT item_id, (row_number() OVER r)::INT AS rank, doc_id, score FROM s WHERE score > 0
WINDOW r AS (PARTITION BY item_id, text ORDER BY score DESC, doc_id) QUALIFY row_number() OVER r <= 50
"""

OP13 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
             coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER r)::INT AS rank, other AS negative_id, positive_score,
       score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW r AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER r <= 10
"""

ORACLES = {"op11_lexical_search": OP11, "op13_hard_negatives": OP13,
           "op1_ngram_jaccard": OP1, "op4_block_dedup": OP4, "op5_suffix_dedup": OP5, "op2_mixing": OP2, "op7_topk": OP7, "op10_quality_rules": OP10}
