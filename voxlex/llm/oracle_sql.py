"""DuckDB SQL of the queries that SQL can express.

Language ID, tokenizing, Huffman files, packing, fingerprints (library hashes),
learned spans and template windows have no SQL form; tests check those
against brute force.
"""

from __future__ import annotations

#: The base32 alphabet (fixed value).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

_PART = "CAST(('0x' || substr(h, {0}, 5)) AS BIGINT)"
_DIGEST = " || ".join(f"substr('{BASE32}', CAST(({_PART.format(5 * k + 1)} // {1 << s}) % 32 + 1 AS BIGINT), 1)"
                      for k in range(8) for s in (15, 10, 5, 0))

OP2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(list_slice(ws, i, i + 4), ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON y.g = x.g AND y.doc_id <> x.doc_id
                    GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
r AS (SELECT DISTINCT a AS node, a AS seen FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen),
c AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id,
       d.doc_id = coalesce(c.component, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id
"""

OP6 = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_DIGEST} AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM p
"""

OP7 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT doc_id, k, substr(x, 2000 * k + 1, 2398) AS y
      FROM (SELECT doc_id, x, unnest(range(0, (len(x) + 1999) // 2000)) AS k FROM d)),
b AS (SELECT doc_id, k, y, unnest(range(0, least(1000, len(y) // 2))) AS j FROM c),
w AS (SELECT doc_id, 1000 * k + j AS i, substr(y, 2 * j + 1, 2) AS byte,
             CASE WHEN 2 * j + 400 <= len(y) THEN md5(substr(y, 2 * j + 1, 400)) END AS m FROM b),
k AS (SELECT m FROM w WHERE m IS NOT NULL GROUP BY m HAVING count(*) > 1),
f AS (SELECT w.doc_id, w.i, w.byte, max(CASE WHEN k.m IS NOT NULL THEN w.i END)
             OVER (PARTITION BY w.doc_id ORDER BY w.i) AS last FROM w LEFT JOIN k ON k.m = w.m),
g AS (SELECT doc_id, i, byte, coalesce(last >= i - 199, false) AS gone FROM f),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS first FROM g),
a AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS r, count(*) FILTER (WHERE first) AS s,
             coalesce(string_agg(byte, '' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_bytes, coalesce(r, 0) AS n_removed, coalesce(s, 0) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN a ON a.doc_id = d.doc_id
"""

_NEAR = """SELECT p.vec_id, p.part, p.u, min(struct_pack(d := list_sum(list_transform(
    list_zip(p.u, b.u), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := b.e)) AS m
  FROM p JOIN {0} b ON b.part = p.part GROUP BY p.vec_id, p.part, p.u"""
_MOVED = """SELECT b.part, b.e, coalesce(n.u, b.u) AS u FROM {0} b LEFT JOIN (
    SELECT part, e, list((s - (s % n + n) % n) // n ORDER BY i) AS u FROM (
      SELECT part, m.e AS e, i, CAST(sum(u[i]) AS BIGINT) AS s, count(*) AS n
      FROM {1}, (SELECT unnest(range(1, (SELECT max(len(u)) FROM p) + 1)) AS i) GROUP BY ALL)
    GROUP BY part, e) n ON n.part = b.part AND n.e = b.e"""

OP11 = f"""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, part, list_slice(v, part * (len(v) // 16) + 1, (part + 1) * (len(v) // 16)) AS u
      FROM k, (SELECT unnest(range(16)) AS part)),
b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, u FROM p
       WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 64)),
a0 AS ({_NEAR.format('b0')}),
b1 AS ({_MOVED.format('b0', 'a0')}),
a1 AS ({_NEAR.format('b1')}),
b2 AS ({_MOVED.format('b1', 'a1')}),
a2 AS ({_NEAR.format('b2')}),
c AS (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error
      FROM a2 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, e, i)) AS codebooks_sha256
      FROM (SELECT part, e, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM b2))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM c JOIN k USING (vec_id), h
"""

ORACLES = {"op2_minhash": OP2, "op6_warc": OP6, "op7_suffix_dedup": OP7, "op11_vector_codes": OP11}
