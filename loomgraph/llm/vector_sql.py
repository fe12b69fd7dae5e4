"""DuckDB SQL for the operators over embeddings."""

from __future__ import annotations

FINITE = "embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0"

TOP_PRODUCTS = f"""
WITH v AS (SELECT row_number() OVER () AS row, vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS x FROM embeddings WHERE {FINITE}),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, c.row AS other, list_inner_product(q.x, c.x)::BIGINT AS score
      FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST, other))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


def clusters(rounds: int = 5, k: int = 40) -> str:
    """The rounds one after the other: m0 has the first centroids, a{i} whom each vector is nearest to, m{i+1} the next ones."""
    floor_mean = "((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*))::DOUBLE"
    parts = [
        f"v AS (SELECT row_number() OVER () AS row, vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS x FROM embeddings WHERE {FINITE} AND len(embedding) = 64)",
        f"m0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, x) - 1 AS k, x AS c FROM v QUALIFY k < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"d{i} AS (SELECT row, vec_id, x, k, (list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c))::BIGINT AS d FROM v, m{i})")
        parts.append(f"a{i} AS (SELECT row, any_value(vec_id) AS vec_id, any_value(x) AS x, min({{'d': d, 'k': k}}) AS best FROM d{i} GROUP BY row)")
        if i < rounds:
            parts.append(f"e{i} AS (SELECT best.k AS k, unnest(range(64)) AS j, unnest(x)::HUGEINT AS v FROM a{i})")
            parts.append(f"f{i} AS (SELECT k, j, {floor_mean} AS mean FROM e{i} GROUP BY k, j)")
            parts.append(f"g{i} AS (SELECT k, list(mean ORDER BY j) AS c FROM f{i} GROUP BY k)")
            parts.append(f"m{i + 1} AS (SELECT m{i}.k, coalesce(g{i}.c, m{i}.c) AS c FROM m{i} LEFT JOIN g{i} ON m{i}.k = g{i}.k)")
    last = f"a{rounds}"
    return f"""WITH {", ".join(parts)}
SELECT vec_id, best.k::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.k))::BIGINT AS cluster_inertia,
       (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string([x::BIGINT for x in c], ',')) AS centroid_sha256
FROM {last} JOIN m{rounds} ON best.k = m{rounds}.k
"""
