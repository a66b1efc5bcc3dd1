"""Oracle SQL (DuckDB) of the queries that SQL can express."""

from assetlake.llm.license_scan import PHRASES, TEMPLATES, templates_of

WORD = r"[^\x20\x09-\x0D]+"
TEXT = "coalesce(text, '')"
AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
BLANKS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

OP4 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {TEXT} AS t, regexp_extract_all({TEXT}, '{WORD}') AS w FROM documents),
g AS (SELECT r, i, list_slice(w, i, i + 4) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) > 4)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY r),
l AS (SELECT r, x, trim(x, {BLANKS}) AS s FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d)),
ln AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT x) AS dup,
    sum(CASE WHEN suffix(s, '...') OR suffix(s, '…') THEN 1 ELSE 0 END) AS dots,
    sum(CASE WHEN prefix(s, '-') OR prefix(s, '*') OR prefix(s, '•') THEN 1 ELSE 0 END) AS bullets
  FROM l WHERE s <> '' GROUP BY r),
top AS (SELECT r, max(n) AS n FROM (SELECT r, x, count(*) AS n FROM (SELECT r, unnest(w) AS x FROM d) GROUP BY r, x) GROUP BY r),
f AS (SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(ln.dup, 0) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, coalesce(ln.n, 0) AS lines, coalesce(dots, 0) AS dots, coalesce(bullets, 0) AS bullets,
    coalesce(top.n, 0) AS most,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS echoed,
    len(list_filter(w, lambda x: regexp_full_match(x, '[^A-Za-z]*[A-Z][^a-z]*[A-Z][^a-z]*'))) AS loud,
    len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS lettered
  FROM d LEFT JOIN rep USING (r) LEFT JOIN ln USING (r) LEFT JOIN top USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > n_words OR 2 * loud > n_words OR 2 * n_dup_lines > lines
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * lettered < n_words OR 10 * dots > 3 * lines
    OR 10 * bullets > 9 * lines OR 2 * most > n_words OR 10 * echoed > 3 * n_words) AS kept
FROM b
"""

OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({TEXT}, '{WORD}') AS w FROM documents),
x AS MATERIALIZED (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT r, i, k, list_slice(w, i - k + 1, i) AS g FROM x, (VALUES (1), (2), (3)) AS o(k) WHERE i >= k),
n AS (SELECT r, i, k, count(*) OVER (PARTITION BY g) - count(*) OVER (PARTITION BY g, r) AS n FROM g),
p AS (SELECT r, i, max(n) FILTER (WHERE k = 1) AS n1, coalesce(max(n) FILTER (WHERE k = 2), 0) AS n2, coalesce(max(n) FILTER (WHERE k = 3), 0) AS n3
  FROM n GROUP BY r, i),
c AS (SELECT *, lag(n1) OVER (PARTITION BY r ORDER BY i) AS c1, lag(n2) OVER (PARTITION BY r ORDER BY i) AS c2 FROM p),
s AS (SELECT r, CASE WHEN n3 > 0 THEN ln(CAST(n3 AS DOUBLE) / c2) WHEN n2 > 0 THEN ln(0.4::DOUBLE * n2 / c1)
  ELSE ln(greatest(n1, 1) * 0.16::DOUBLE / (SELECT count(*) FROM x)) END AS s FROM c),
t AS (SELECT r, sum(s) AS s FROM s GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(t.s, 0.0::DOUBLE), 6) AS score FROM d LEFT JOIN t USING (r)
"""

OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate({TEXT}, {AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate({TEXT}, {AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS g FROM bi),
di AS (SELECT r, w, s.n, unnest(range(1, len(w) - s.n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) AS s WHERE len(w) >= s.n),
hits AS (SELECT r, i, n, item_id FROM (SELECT r, i, n, list_slice(w, i, i + n - 1) AS g FROM di) JOIN bw USING (n, g)),
hw AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
it AS (SELECT r, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hw.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(it.n, 0) AS BIGINT) AS n_items, sha256(coalesce(it.s, '')) AS items_sha256, coalesce(hw.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN it USING (r)
"""

OP6 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate({TEXT}, {AZ}), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT r, list_slice(w, i, i + 3) AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s AS a JOIN s AS b USING (g) GROUP BY a.r, b.r),
e AS (SELECT x, y FROM p JOIN n AS a ON a.r = x JOIN n AS b ON b.r = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
reach AS (SELECT x, y FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
c AS (SELECT x AS r, min(doc_id) AS c FROM reach JOIN d ON d.r = y GROUP BY x)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.c, doc_id) AS component_id, doc_id = coalesce(c.c, doc_id) AS kept
FROM d LEFT JOIN n USING (r) LEFT JOIN c USING (r)
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({TEXT}, '{WORD}') AS w FROM documents),
g AS (SELECT doc_id, i, list_slice(w, i, i + 19) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) > 19)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM g) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
ws AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT ws.doc_id, count(*) FILTER (WHERE gone.p IS NOT NULL) AS n, string_agg(x, ' ' ORDER BY ws.p) FILTER (WHERE gone.p IS NULL) AS t
  FROM ws LEFT JOIN gone ON gone.doc_id = ws.doc_id AND gone.p = ws.p GROUP BY ws.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

OP10 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split({TEXT}, chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, i, ls[i] AS x, translate(trim(ls[i], {BLANKS}), {AZ}) AS k
  FROM (SELECT r, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
c AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT r, doc_id, i, x, c.k IS NOT NULL AND doc_id <> keeper AS gone FROM l LEFT JOIN c USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""

OP11 = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS id, a.l = b.l AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e AS a, e AS b WHERE a.vec_id % 50 = 0 AND a.r <> b.r),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST, b) AS k FROM s WHERE same) WHERE k <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.id NULLS LAST, s.b) AS rank
  FROM p JOIN s ON p.a = s.a WHERE NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
WHERE rank <= 3
"""


def _op12():
    known = templates_of(TEMPLATES, 80)
    rows = ", ".join(f"({t.number}, '{t.label}', {t.step}, {len(t.words)}, {t.need}, '{w.decode()}')" for t in known for w in sorted(t.words))
    places = " UNION ALL ".join(
        f"SELECT r, '{label}' AS label, i FROM (SELECT r, w, unnest(range(0, len(w) - {n - 1})) AS i FROM d WHERE len(w) >= {n}) "
        f"WHERE list_slice(w, i + 1, i + {n}) = {phrase.split()}" for label, phrase in PHRASES for n in [len(phrase.split())])
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate({TEXT}, {AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS ({places}),
b AS (SELECT r, count(*) AS n, min(i) AS a, max(i) AS z, list(DISTINCT label) AS ls FROM p GROUP BY r),
t(number, label, step, size, need, word) AS (VALUES {rows}),
x AS (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM d),
m AS (SELECT r, number, any_value(label) AS label, any_value(size) AS size, any_value(need) AS need, block, count(DISTINCT word) AS n
  FROM (SELECT *, unnest([i // step, i // step - 1]) AS block FROM x JOIN t USING (word)) WHERE block >= 0 GROUP BY r, number, block),
f AS (SELECT r, max(CAST(n AS DOUBLE) / size) AS c, list(DISTINCT label) AS ls FROM m WHERE n >= need GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(b.a AS BIGINT) AS first_word,
  CAST(b.z AS BIGINT) AS last_word, coalesce(array_to_string(list_sort(b.ls), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(b.ls, f.ls))), ','), '') AS labels,
  CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(f.c, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN f USING (r)
"""


def _op13(rounds=6):
    """Parts of 8 components at 8 positions, 16 entries; every distance is computed."""
    nearest = """SELECT r, p, arg_min(k, d * 64 + k) AS k, min(d) AS d FROM (
    SELECT x.r, x.p, e.k, CAST(list_sum(list_transform(list_zip(x.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
    FROM x JOIN {e} AS e USING (p)) GROUP BY r, p"""
    steps = []
    for i in range(rounds):
        steps.append(f"""a{i} AS MATERIALIZED ({nearest.format(e=f'e{i}')}),
m{i} AS (SELECT p, k, list(v ORDER BY j) AS v FROM (SELECT p, k, j, CAST(floor(CAST(sum(c) AS DOUBLE) / count(*)) AS BIGINT) AS v FROM (
    SELECT a{i}.p, a{i}.k, unnest(x.v) AS c, unnest(range(len(x.v))) AS j FROM a{i} JOIN x USING (r, p)) GROUP BY p, k, j) GROUP BY p, k),
e{i + 1} AS MATERIALIZED (SELECT p, k, coalesce(m{i}.v, e{i}.v) AS v FROM e{i} LEFT JOIN m{i} USING (p, k))""")
    return f"""
WITH w AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT r, p, list_slice(v, p * len(v) // 8 + 1, (p + 1) * len(v) // 8) AS v FROM (SELECT r, v, unnest(range(8)) AS p FROM w)),
e0 AS MATERIALIZED (SELECT p, r - 1 AS k, v FROM x WHERE r <= 16),
{", ".join(steps)},
a AS MATERIALIZED ({nearest.format(e=f'e{rounds}')}),
c AS (SELECT r, string_agg(format('{{:02x}}', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a GROUP BY r),
b AS (SELECT sha256(string_agg(s, ',' ORDER BY p, k)) AS s FROM (SELECT p, k, array_to_string(v, ',') AS s FROM e{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, b.s AS codebooks_sha256
FROM w JOIN c USING (r), b
"""


ORACLES = {"op11_hard_negatives": OP11, "op12_license_scan": _op12(), "op13_vector_codes": _op13(), "op2_lm_scores": OP2, "op4_quality_rules": OP4, "op6_minhash_near_dedup": OP6, "op8_decontaminate": OP8, "op9_phrase_dedup": OP9,
           "op10_line_dedup": OP10}
