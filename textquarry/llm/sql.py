"""DuckDB SQL that the operators' queries must equal."""

LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, u.i AS pos, l[u.i] AS line,
         lower_ascii AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) d,
       LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i) u,
       LATERAL (SELECT translate(
           regexp_replace(regexp_replace(l[u.i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii) k
), many AS (
  SELECT key, max(doc_id) AS keeper FROM lines
  WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
)
SELECT lines.doc_id, count(*) AS n_lines,
       count(*) FILTER (keeper IS NOT NULL AND keeper <> lines.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos)
              FILTER (keeper IS NULL OR keeper = lines.doc_id), '')) AS kept_sha256
FROM lines LEFT JOIN many ON lines.key = many.key AND length(lines.key) >= 40
GROUP BY lines.doc_id
"""

WARC = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), g AS (
  SELECT payload, max(page_id) AS kept, count(*) AS n FROM p
  WHERE octet_length(payload) >= 1000 GROUP BY payload
)
SELECT page_id, octet_length(p.payload)::BIGINT AS payload_bytes, sha1(p.payload) AS payload_digest,
       CASE WHEN kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM p LEFT JOIN g ON p.payload = g.payload
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(l) >= 4 THEN list_transform(range(1, len(l) - 2), lambda i: array_to_string(l[i:i + 3], ' '))
    WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE [] END) AS shingle FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY x, y
), links AS (
  SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
  WHERE 100 * c >= 80 * (p.n + q.n - c)
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS doc, doc_id AS root FROM documents
  UNION
  SELECT e.y, r.root FROM reach r JOIN edges e ON e.x = r.doc
), roots AS (
  SELECT doc, min(root) AS component_id FROM reach GROUP BY doc
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN roots ON doc = d.doc_id
"""

VARIANTS = r"""
WITH RECURSIVE bits AS (
  SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM (SELECT unnest(range(0, 256)) AS b)
), crc_table AS (
  SELECT list(v ORDER BY b) AS t FROM bits
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run
  FROM documents
), counted AS (
  SELECT id, run, count(*) AS c FROM runs WHERE length(run) >= 6 GROUP BY id, run
), hexed AS (
  SELECT run, c, hex(encode(id || ':' || run)) AS h FROM counted
), summed AS (
  SELECT run, c, xor(list_reduce(list_concat([4294967295::BIGINT],
    list_transform(range(0, length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)),
    lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1])), 4294967295) AS crc
  FROM hexed, crc_table
), slipped AS (
  SELECT c, CASE WHEN crc % 199 = 0
    THEN left(run, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word
  FROM summed
), words AS (
  SELECT word, sum(c)::BIGINT AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5
), holes AS (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM holes a JOIN holes b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word
), forms AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN other END AS form,
         CASE WHEN m >= 5 * n THEN m END AS form_n
  FROM words LEFT JOIN best ON best.word = words.word
), walk AS (
  SELECT word, word AS root FROM forms WHERE form IS NULL
  UNION ALL
  SELECT f.word, w.root FROM forms f JOIN walk w ON f.form = w.word
)
SELECT forms.word, form, root, n, n_near::BIGINT AS n_near, form_n FROM forms JOIN walk ON walk.word = forms.word
"""

HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
  AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
QUALIFY rank <= 10
"""
