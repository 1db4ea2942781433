"""The queries of this folder in SQL, where SQL can express them."""

ORACLES: dict[str, str] = {}

ORACLES["op11_exact_dedup"] = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
groups AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM docs GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256
FROM docs JOIN groups USING (text)
"""


def _clusters(rounds: int = 3, k: int = 16) -> str:
    """Rounds of nearest centroids and floored means, one pair of tables each."""
    steps = [
        """WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))))""",
        f"""c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS k, v FROM kept
  QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id), v) <= {k})""",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (
  SELECT r, vec_id, kept.v, c.k, c.v AS c,
    list_inner_product(kept.v, kept.v) - 2 * list_inner_product(kept.v, c.v) + list_inner_product(c.v, c.v) AS d
  FROM kept, c{i} c QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c.k) = 1)""")
        if i < rounds:
            steps.append(f"""m{i} AS (
  SELECT k, i, floor(sum(x) / count(*)) AS x
  FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY k, i),
c{i + 1} AS (
  SELECT k, list(x ORDER BY i) AS v FROM m{i} GROUP BY k
  UNION ALL SELECT k, v FROM c{i} WHERE k NOT IN (SELECT k FROM m{i}))""")
    return ",\n".join(steps) + f"""
SELECT vec_id, k::INTEGER AS cluster, d::BIGINT AS distance,
  (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a{rounds}
"""


ORACLES["op12_ns_clusters"] = _clusters()

ORACLES["op13_hard_negatives"] = """
WITH part AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS other, a.label = b.label AS same,
    list_inner_product(a.v, b.v)::BIGINT AS score
  FROM part a, part b WHERE a.vec_id % 50 = 0 AND a.r <> b.r AND len(a.v) = len(b.v)),
positives AS (
  SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, other, br) <= 5),
found AS (
  SELECT p.ar, p.br, p.anchor_id, p.other AS positive_id, n.other AS negative_id, p.score AS positive_score,
    n.score AS negative_score, row_number() OVER (PARTITION BY p.ar, p.br ORDER BY n.score DESC, n.other, n.br) AS nth
  FROM positives p JOIN scores n ON p.ar = n.ar AND NOT n.same
    AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, nth::INTEGER AS rank, negative_id, positive_score, negative_score FROM found WHERE nth <= 3
"""
