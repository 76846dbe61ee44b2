"""DuckDB SQL for the queries of this subpackage, over whole tables."""

OP8 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT doc_id, dw.k, i, item_id FROM dw JOIN bw USING (k, win)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP10 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
r AS (
  SELECT doc_id AS u, doc_id AS v FROM d
  UNION SELECT u, y FROM r JOIN (SELECT x, y FROM e UNION ALL SELECT y, x FROM e) t ON v = t.x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
tot AS (SELECT CAST(sum(ss) AS BIGINT) AS t FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY 3 * ss / w, w, source NULLS LAST) AS i FROM s),
v AS (
  SELECT a.source, a.ss, a.w, a.i,
         (SELECT t FROM tot) - coalesce((SELECT CAST(sum(3 * ss) AS BIGINT) FROM r b WHERE b.i < a.i), 0) AS l,
         (SELECT CAST(sum(w) AS BIGINT) FROM s) - coalesce((SELECT CAST(sum(w) AS BIGINT) FROM r b WHERE b.i < a.i), 0) AS sh
  FROM r a),
o AS (SELECT l, sh FROM v WHERE 3 * ss * sh > l * w ORDER BY i LIMIT 1),
g AS (SELECT source, ss, CASE WHEN 3 * ss * sh <= l * w THEN CAST(3 * ss AS DOUBLE) ELSE CAST((SELECT l FROM o) * w AS DOUBLE) / (SELECT sh FROM o) END AS target FROM v),
p AS (
  SELECT d.doc_id, d.source, d.size, md5(CAST(d.doc_id AS VARCHAR)) AS k, g.ss, g.target,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(CAST(d.doc_id AS VARCHAR)), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS pl
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
c AS (SELECT *, CAST(pl + copy * ss AS DOUBLE) / target AS f FROM p, (SELECT unnest([0, 1, 2]) AS copy) WHERE target > 0 AND size > 0),
q AS (SELECT *, sum(size) OVER (ORDER BY f, k, doc_id, source NULLS LAST, copy ROWS UNBOUNDED PRECEDING) AS run FROM c),
n AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS taken FROM q WHERE run <= (SELECT t FROM tot) GROUP BY 1)
SELECT doc_id, size, ss AS source_size, target, coalesce(taken, 0) AS taken FROM p LEFT JOIN n USING (doc_id)
"""

OP5 = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)
"""

#: Scripts written without spaces between words.
UNSPACED = "".join(rf"\p{{{x}}}" for x in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"))
OP6 = rf"""
WITH l AS (
  SELECT doc_id, pos, line, CASE WHEN len(w) >= 5 OR len(c) < 5 OR NOT regexp_matches(line, '[{UNSPACED}]') THEN w ELSE c END AS w
  FROM (
    SELECT doc_id, i - 1 AS pos, x[i] AS line, regexp_extract_all(x[i], '[^\x20\x09-\x0D]+') AS w, regexp_extract_all(x[i], '[{UNSPACED}]|[^\x20\x09-\x0D{UNSPACED}]+') AS c
    FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)))),
e AS (SELECT doc_id, pos, w, array_to_string(w, ' ') AS s FROM l WHERE len(w) > 0),
k AS (SELECT s, any_value(w) AS w, min((doc_id, pos)) AS spot FROM e GROUP BY s),
t AS (SELECT * FROM k WHERE len(w) >= 5),
v AS (SELECT s, spot, len(w) AS m, i, array_to_string(w[1:i - 1] || w[i + 1:], ' ') AS d FROM (SELECT s, spot, w, unnest(range(1, len(w) + 1)) AS i FROM t)),
pr AS (
  SELECT a.s AS x, b.s AS y FROM v a JOIN v b ON a.d = b.d AND a.i = b.i AND a.m = b.m AND a.spot > b.spot
  UNION SELECT a.s, b.s FROM v a JOIN t b ON a.d = b.s AND a.spot > b.spot
  UNION SELECT b.s, a.s FROM v a JOIN t b ON a.d = b.s AND b.spot > a.spot),
g AS (SELECT DISTINCT x AS s FROM pr),
z AS (SELECT e.doc_id, e.pos FROM e JOIN k USING (s) LEFT JOIN g USING (s) WHERE g.s IS NOT NULL OR (e.doc_id, e.pos) <> k.spot)
SELECT l.doc_id, count(*) AS n_lines, count(z.pos) AS n_dropped, sha256(coalesce(string_agg(CASE WHEN z.pos IS NULL THEN line END, chr(10) ORDER BY l.pos), '')) AS text_sha256
FROM l LEFT JOIN z ON l.doc_id = z.doc_id AND l.pos = z.pos GROUP BY 1
"""

DEFECT_RULES = [
    "nw < 50", "10 * sy > nw", "100 * lw < 80 * nw", "100 * le < 75 * wc", "nl > 1 AND 100 * dl > 30 * nl", "100 * rw > 30 * nw", "10 * dw < nw", "wc < 3 * nw OR wc > 12 * nw", "100 * cl < 10 * nl",
]
SIGN_RULES = ["nl > 0 AND 100 * cl >= 80 * nl", "nw > 0 AND 100 * le >= 90 * wc", "nw >= 100 AND 5 * dw >= nw"]
VOTES = ", ".join([f"CASE WHEN {r} THEN -1 ELSE 0 END" for r in DEFECT_RULES] + [f"CASE WHEN {r} THEN 1 ELSE 0 END" for r in SIGN_RULES])


RULES = range(1, len(DEFECT_RULES) + len(SIGN_RULES) + 1)


def _prior(j: int, of_bad: bool) -> str:
    return ("0.3e0" if of_bad else "0.02e0") if j <= len(DEFECT_RULES) else ("0.5e0" if of_bad else "0.9e0")


def _rates(of_bad: bool) -> str:
    p = "(1 - p)" if of_bad else "p"
    return ", ".join(f"(sum(CASE WHEN v[{j}] <> 0 THEN n * {p} ELSE 0e0 END) + 10e0 * {_prior(j, of_bad)}) / (sum(n * {p}) + 10e0)" for j in RULES)


ODDS = " + ".join(f"CASE WHEN v[{j}] <> 0 THEN ln(good[{j}] / bad[{j}]) ELSE ln((1 - good[{j}]) / (1 - bad[{j}])) END" for j in RULES)
OP1 = rf"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
r AS (SELECT id, count(DISTINCT p) AS rw FROM (SELECT id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT id, i, count(*) OVER (PARTITION BY id, g) AS c FROM g) WHERE c > 1) GROUP BY 1),
m AS (
  SELECT l.id, doc_id, CAST(len(w) AS BIGINT) AS nw, CAST(length(array_to_string(w, '')) AS BIGINT) AS wc, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS sy, CAST(len(ls) AS BIGINT) AS nl, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS dl, coalesce(rw, 0) AS rw,
         len(list_filter(ls, lambda x: regexp_matches(x, '[.!?:;…»”"'')\]]\s*\z'))) AS cl, length(t) - length(regexp_replace(t, '\p{{L}}+', '', 'g')) AS le, len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS lw, len(list_distinct(w)) AS dw
  FROM l LEFT JOIN r ON r.id = l.id),
vt AS (SELECT id, [{VOTES}] AS v FROM m),
pat AS (SELECT v, count(*) AS n FROM vt GROUP BY v),
em AS (
  SELECT 0 AS it, 0.8e0 AS share, [{', '.join(_prior(j, False) for j in RULES)}] AS good, [{', '.join(_prior(j, True) for j in RULES)}] AS bad
  UNION ALL
  SELECT it + 1, (sum(n * p) + 10e0 * 0.8e0) / (sum(n) + 10e0), [{_rates(False)}], [{_rates(True)}]
  FROM (SELECT it, v, n, 1 / (1 + exp(-(ln(share / (1 - share)) + {ODDS}))) AS p FROM em, pat WHERE it < 40) GROUP BY it),
f AS (SELECT v, 1 / (1 + exp(-(ln(share / (1 - share)) + {ODDS}))) AS p FROM em, pat WHERE it = 40)
SELECT doc_id, nw AS n_words, wc AS word_chars, sy AS n_symbols, dl AS n_dup_lines, rw AS n_repeat_words, nw < 50 OR 100 * rw > 50 * nw AS base_failed, NOT (nw < 50 OR 100 * rw > 50 * nw) AND p >= 0.5 AS kept, round(p, 6) AS probability
FROM m JOIN vt ON vt.id = m.id JOIN f ON f.v = vt.v
"""

ORACLES = {
    "op1_quality_rules": OP1,
    "op2_source_mixing": OP2,
    "op5_url_filter": OP5,
    "op6_line_dedup": OP6,
    "op8_benchmark_decontamination": OP8,
    "op10_ngram_jaccard_join": OP10,
}
