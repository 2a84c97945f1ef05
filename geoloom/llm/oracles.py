"""DuckDB SQL for the queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op1_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS drawn
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, (3.0::DOUBLE * source_size) / weight AS level FROM sources
), candidates AS (
  SELECT a.source, a.level,
         ((SELECT sum(source_size) FROM sources)::DOUBLE
           - coalesce(sum(b.cap) FILTER (WHERE (b.level, coalesce(b.source, chr(1114111))) < (a.level, coalesce(a.source, chr(1114111)))), 0))
         / sum(b.weight) FILTER (WHERE (b.level, coalesce(b.source, chr(1114111))) >= (a.level, coalesce(a.source, chr(1114111))))::DOUBLE AS share
  FROM levels a CROSS JOIN levels b GROUP BY a.source, a.level
), common AS (
  SELECT arg_min(share, level) AS share FROM candidates WHERE share <= level
), targets AS (
  SELECT l.source, l.source_size, coalesce(least(l.cap, c.share * l.weight), l.cap) AS target FROM levels l CROSS JOIN common c
), planned AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END::BIGINT AS whole FROM targets
), rests AS (
  SELECT *, floor(target - whole * source_size + 0.5)::BIGINT AS rest FROM planned
), running AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.whole, r.rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.drawn, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized d JOIN rests r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target,
       (whole * size + least(greatest(rest - upto + size, 0), size))::BIGINT AS taken
FROM running
"""

ORACLES["op9_substrings"] = r"""
WITH split AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), places AS (
  SELECT doc_id, unnest(range(1, len(words) - 11)) AS place, words FROM split WHERE len(words) >= 13
), windows AS (
  SELECT doc_id, place, array_to_string(words[place:place + 12], ' ') AS seq FROM places
), firsts AS (
  SELECT seq, min(doc_id) AS least FROM windows GROUP BY seq
), gone AS (
  SELECT w.doc_id, list(DISTINCT w.place + k.k) AS places
  FROM windows w JOIN firsts f ON w.seq = f.seq AND f.least < w.doc_id CROSS JOIN range(0, 13) k(k)
  GROUP BY w.doc_id
), judged AS (
  SELECT s.doc_id, s.words, coalesce(g.places, []) AS places FROM split s LEFT JOIN gone g ON s.doc_id = g.doc_id
), numbered AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, len(places)::BIGINT AS n_removed, words, places, row_number() OVER () AS r FROM judged
), kept AS (
  SELECT r, string_agg(words[i], ' ' ORDER BY i) AS body
  FROM (SELECT r, words, places, unnest(range(1, len(words) + 1)) AS i FROM numbered)
  WHERE NOT list_contains(places, i) GROUP BY r
)
SELECT n.doc_id, n.n_words, n.n_removed, sha256(coalesce(k.body, '')) AS kept_sha256
FROM numbered n LEFT JOIN kept k ON n.r = k.r
"""

ORACLES["op6_topk"] = r"""
WITH scaled AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM scaled q JOIN scaled c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
