"""Checking SQL of the corpus queries, for DuckDB."""

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

POSITIONAL_INDEX = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
spots AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) AS i FROM b),
wins AS (SELECT DISTINCT item_id, len(w[i:i + 9]) AS k, array_to_string(w[i:i + 9], ' ') AS g FROM spots),
lens AS (SELECT DISTINCT k FROM wins),
places AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lens WHERE len(w) >= k),
found AS (SELECT doc_id, i, p.k AS k, item_id FROM places p JOIN wins ON wins.k = p.k AND wins.g = array_to_string(p.w[i:i + p.k - 1], ' ')),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

BBIT_MINHASH = f"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
d AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM t),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM d),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b USING (g) WHERE a.doc_id <> b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT doc_id, y FROM reach JOIN links ON r = x)
SELECT d.doc_id, CAST(len(any_value(s)) AS BIGINT) AS n_shingles, min(r) AS component_id, min(r) = d.doc_id AS kept
FROM d JOIN reach USING (doc_id) GROUP BY d.doc_id
"""

RULE_OF = """CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
           WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
           WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
           WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END"""

REDIRECT_EQUIVALENCE = f"""
WITH RECURSIVE u AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{CAPITALS}', '{SMALL}') AS host,
      regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM u),
k AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www\\.|m\\.|blog\\.)', '') || regexp_replace(path, '(\\.html|/)$', '') END AS address,
      {RULE_OF} AS rule FROM p),
t AS (SELECT address, unnest([regexp_extract(regexp_extract(html, '<link\\b[^>]*\\brel=["'']?canonical\\b[^>]*>', 0, 'i'), '\\bhref=["'']?([^"''\\s>]+)', 1, 'i'),
      regexp_extract(regexp_extract(html, '<meta\\b[^>]*\\bhttp-equiv=["'']?refresh\\b[^>]*>', 0, 'i'), '\\burl=["'']?([^"''\\s>]+)', 1, 'i')]) AS url FROM k),
o AS (SELECT address, translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{CAPITALS}', '{SMALL}') AS host,
      regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM t),
l AS (SELECT address AS a, regexp_replace(host, '^(www\\.|m\\.|blog\\.)', '') || regexp_replace(path, '(\\.html|/)$', '') AS b, {RULE_OF} AS rule FROM o
      WHERE address IS NOT NULL AND host <> ''),
both_ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT address, address AS r FROM k WHERE address IS NOT NULL UNION SELECT b, b FROM l UNION SELECT reach.address, b FROM reach JOIN both_ways ON r = a),
least AS (SELECT address, min(r) AS component FROM reach GROUP BY address),
d AS (SELECT component, min(CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END) AS decision
      FROM (SELECT address, rule FROM k UNION ALL SELECT b, rule FROM l) JOIN least USING (address) WHERE rule IS NOT NULL GROUP BY component),
v AS (SELECT page_id, host, path, rule, component, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS ruled
      FROM k LEFT JOIN least USING (address))
SELECT page_id, host, path, rule, coalesce(ruled, decision, 'allow') AS verdict, component FROM v LEFT JOIN d USING (component)
"""

COVER_TREE = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
g AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM e
      WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.95),
reach AS (SELECT vec_id, vec_id AS r FROM e UNION SELECT reach.vec_id, y FROM reach JOIN l ON r = x),
c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
k AS (SELECT x AS vec_id, count(*) AS n_links FROM l GROUP BY x)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, component_id = e.vec_id AS kept
FROM e JOIN c USING (vec_id) LEFT JOIN k USING (vec_id)
"""

#: Bytes as pairs of hex digits; 400 of them are named by a 64-bit hash.
BWT_EXPANSION = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
s AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 399)) AS i FROM d)),
r AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1),
t AS (SELECT doc_id, i, i > lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) + 400 AS fresh FROM s SEMI JOIN r USING (k)),
g AS (SELECT doc_id, i, count(*) FILTER (WHERE fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM t),
p AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY doc_id, g),
q AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS f, a AS t FROM p
      UNION ALL SELECT d.doc_id, coalesce(max(b), 0), any_value(n) FROM d LEFT JOIN p USING (doc_id) GROUP BY d.doc_id),
k AS (SELECT doc_id, string_agg(substr(h, 2 * f + 1, 2 * (t - f)), '' ORDER BY f) AS kept FROM q JOIN d USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM p GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)
"""

SEGMENT_SUMMARIES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM v a JOIN v b ON len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND vec_id <> anchor_id
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""

GEOMETRIC_BLOCKS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), '{CAPITALS}', '{SMALL}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))) AS t FROM benchmark),
c AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
o AS (SELECT r, any_value(doc_id) AS doc_id, any_value(len(w)) AS n, t, count(*) AS tf FROM (SELECT r, doc_id, w, unnest(w) AS t FROM d) GROUP BY r, t),
i AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM o, c GROUP BY t),
s AS (SELECT item_id, r, any_value(doc_id) AS doc_id,
      CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // total)))) AS BIGINT) AS score
      FROM b JOIN o USING (t) JOIN i USING (t), c GROUP BY item_id, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""

ORACLES = {"op10_bwt_expansion": BWT_EXPANSION, "op3_cover_tree": COVER_TREE, "op7_redirect_equivalence": REDIRECT_EQUIVALENCE,
           "op2_positional_index": POSITIONAL_INDEX, "op5_bbit_minhash": BBIT_MINHASH, "op11_segment_summaries": SEGMENT_SUMMARIES,
           "op13_geometric_blocks": GEOMETRIC_BLOCKS}
