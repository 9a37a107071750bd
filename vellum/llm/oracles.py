"""DuckDB SQL for the queries that SQL can express on whole tables.

The others (tokenizing, fitted models, page parsing, approximate search) are held against brute force in tests/llm.
"""

_COMPONENTS = """
reach(id, other) AS (SELECT a, b FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
comp AS (SELECT id, min(other) AS low FROM reach GROUP BY id)
"""

ORACLES: dict[str, str] = {
    "op1_embedding_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
ok AS (SELECT * FROM v WHERE len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
{_COMPONENTS}
SELECT m.vec_id, (SELECT count(*) FROM links l WHERE l.a = m.vec_id) AS n_links, least(m.vec_id, coalesce(c.low, m.vec_id)) AS component_id,
  m.vec_id = least(m.vec_id, coalesce(c.low, m.vec_id)) AS kept
FROM embeddings m LEFT JOIN comp c ON c.id = m.vec_id""",
    "op6_minhash_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
common AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM e p JOIN e q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY ALL),
links AS (SELECT c.a, c.b FROM common c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b WHERE 100 * c.n >= 85 * (len(x.s) + len(y.s) - c.n)),
{_COMPONENTS}
SELECT s.doc_id, len(s.s) AS n_shingles, least(s.doc_id, coalesce(c.low, s.doc_id)) AS component_id, s.doc_id = least(s.doc_id, coalesce(c.low, s.doc_id)) AS kept
FROM s LEFT JOIN comp c ON c.id = s.doc_id""",
    "op7_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, unnest(range(0, CAST(length(h) AS BIGINT) // 2 - 49)) AS p, h FROM d),
grams AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 100)) AS s FROM g),
hits AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS first FROM grams) WHERE first < doc_id),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run
  FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS new FROM hits)) GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM runs UNION ALL SELECT doc_id, max(b), NULL FROM runs GROUP BY doc_id),
kept AS (SELECT k.doc_id, string_agg(substr(d.h, 2 * k.a + 1, 2 * (coalesce(k.b, length(d.h) // 2) - k.a)), '' ORDER BY k.a) AS h FROM gaps k JOIN d USING (doc_id) GROUP BY k.doc_id),
total AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(t.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(t.spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM d LEFT JOIN total t USING (doc_id) LEFT JOIN kept k USING (doc_id)""",
    "op11_spelling_variants": """
WITH RECURSIVE runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00c0-\u00ff]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
own AS (SELECT r, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)) AS x FROM runs WHERE length(r) >= 5 GROUP BY doc_id, r),
bits AS (SELECT r, n, flatten([[('0x' || substr(x, 2 * i + 1, 2))::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR i IN range(length(x) // 2)]) AS x FROM own),
summed AS (SELECT r, n, xor(list_reduce(x, lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(xor(c, b) >> 1, 3988292384) ELSE xor(c, b) >> 1 END, 4294967295), 4294967295) AS h FROM bits),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, n AS k FROM summed),
w AS (SELECT word, sum(k)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
i AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
less AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM i),
gap AS (SELECT word, n, i, substr(word, 1, i - 1) || chr(1) || substr(word, i + 1) AS v FROM i),
pairs AS (SELECT l.word AS a, w.word AS b FROM less l JOIN w ON l.v = w.word UNION SELECT w.word, l.word FROM less l JOIN w ON l.v = w.word
  UNION SELECT p.word, q.word FROM gap p JOIN gap q ON p.v = q.v AND p.word <> q.word),
ranked AS (SELECT a, b AS f, n AS fn, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k FROM pairs JOIN w ON word = b),
forms AS (SELECT w.word, CASE WHEN fn >= 2 * n THEN f END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN fn >= 2 * n THEN fn END AS form_n FROM w LEFT JOIN ranked ON a = word AND k = 1),
chain(word, root, depth) AS (SELECT word, word, 0 FROM forms UNION ALL SELECT c.word, f.form, depth + 1 FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, depth) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)""",
    "op12_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
ok AS (SELECT vec_id, label, [floor(256 * x) FOR x IN e] AS q FROM v WHERE len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM ok a JOIN ok b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) <= 5""",
}
