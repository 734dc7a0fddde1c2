"""Check SQL of the operators that DuckDB can express; the tests hold the others against brute force."""

SQL: dict[str, str] = {}
SQL["op9_warc"] = """WITH p AS (SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS newest FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> newest THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN n >= 1000 AND page_id <> newest THEN newest END AS refers_to FROM w"""
SQL["op11_prefix_trie"] = """WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
own AS (SELECT conv_id AS c, list({'r': coalesce(role, ''), 'x': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT c, ts, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h FROM own, tab),
built AS (SELECT h.c, list_concat(coalesce(b.ts[1:h.h], []), h.ts[h.h + 1:]) AS ts FROM h LEFT JOIN own b ON b.c = h.c - h.c % 100),
pre AS (SELECT c, d, ts[1:d] AS p, len(ts) AS n FROM (SELECT c, ts, unnest(range(len(ts) + 1)) AS d FROM built)),
node AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs FROM pre GROUP BY 1, 2),
kid AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY 1, 2),
nk AS (SELECT node.*, coalesce(kid.n, 0) AS n_children FROM node LEFT JOIN kid USING (p, d)),
sub AS (SELECT a.p, a.d, count(*) FILTER (b.n_children = 0) AS n_leaves, sum(CASE WHEN b.d = 0 THEN 0 ELSE (b.n_convs - 1) * length(b.p[b.d].x) END) AS saved FROM nk a JOIN nk b ON b.d >= a.d AND b.p[1:a.d] = a.p GROUP BY 1, 2),
fin AS (SELECT p, d, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS sha FROM pre WHERE d = n GROUP BY 1, 2)
SELECT nk.conv_id, CAST(nk.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(nk.n_convs AS BIGINT) AS n_convs, CAST(nk.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
 CAST(saved AS BIGINT) AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM nk JOIN sub USING (p, d) LEFT JOIN fin USING (p, d) LEFT JOIN node up ON up.p = nk.p[1:nk.d - 1] AND up.d = nk.d - 1"""
