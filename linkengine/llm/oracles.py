"""SQL of the operators that SQL can express and that no module of theirs holds."""

from __future__ import annotations

_BLANK = r"'[\x20\x09-\x0D]+'"
_REACH = """
reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
least AS (SELECT a AS id, min(b) AS c FROM reach GROUP BY 1)
"""

OP3_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_BLANK}), lambda x : x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i : array_to_string(w[i:i + 4], ' '))) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * i >= 75 * (x.n + y.n - i)), {_REACH}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) AS component_id, d.doc_id <= coalesce(c, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.id = d.doc_id
"""

OP5_SQL = f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), {_BLANK}), lambda x : x <> '') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
m AS (SELECT g, min(doc_id) AS m FROM x GROUP BY 1),
r AS (SELECT DISTINCT doc_id, i + k AS pos FROM (SELECT doc_id, i, unnest(range(13)) AS k FROM x JOIN m USING (g) WHERE m < doc_id)),
k AS (SELECT doc_id, string_agg(t, ' ' ORDER BY pos) AS t FROM (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS pos FROM w) ANTI JOIN r USING (doc_id, pos) GROUP BY 1)
SELECT w.doc_id, len(w.w) AS n_words, (SELECT count(*) FROM r WHERE r.doc_id = w.doc_id) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""

OP8_SQL = f"""
WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x : x::DOUBLE) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x : x <> 0)) > 0),
u AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x : x * x))) AS n FROM e),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.98), {_REACH}
SELECT d.vec_id, (SELECT count(*) FROM l WHERE l.a = d.vec_id) AS n_links, least(d.vec_id, coalesce(c, d.vec_id)) AS component_id, d.vec_id <= coalesce(c, d.vec_id) AS kept
FROM embeddings d LEFT JOIN least ON least.id = d.vec_id
"""
