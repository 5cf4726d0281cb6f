"""DuckDB SQL for clustering evaluation (X1-X11, N14) on ``embeddings``."""

from __future__ import annotations

from .sql import r

CLUSTERINGS = [("label_k10", None, 10), ("labelmod_k2", 2, 2), ("labelmod_k3", 3, 3),
               ("labelmod_k5", 5, 5)]


def assigned_cte(name: str, modulo: int | None) -> str:
    cluster = "label" if modulo is None else f"label % {modulo}"
    return (f"{name} AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS features, "
            f"CAST({cluster} AS INTEGER) AS cluster FROM embeddings)")


def sample_ctes(src: str, name: str, size: int, seed: int = 42) -> list[str]:
    """X2 in SQL: per cluster the row with the smallest (hash, id), then the rest by hash."""
    return [
        f"""{name}_keyed AS (SELECT *, md5(CAST(row_id AS VARCHAR) || '|{seed}') AS _key FROM {src})""",
        f"""{name}_first AS (
  SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY cluster ORDER BY _key, row_id) AS rn
                      FROM {name}_keyed) AS t WHERE rn = 1)""",
        f"""{name}_ids AS (
  SELECT row_id FROM {name}_first
  UNION ALL
  SELECT row_id FROM (SELECT row_id FROM {name}_keyed WHERE row_id NOT IN (SELECT row_id FROM {name}_first)
                      ORDER BY _key, row_id
                      LIMIT greatest(0, {size} - (SELECT count(DISTINCT cluster) FROM {src}))) AS rest)""",
        f"""{name} AS (
  SELECT * FROM {src} WHERE (SELECT count(*) FROM {src}) <= {size}
  UNION ALL
  SELECT * FROM {src} WHERE (SELECT count(*) FROM {src}) > {size} AND row_id IN (SELECT row_id FROM {name}_ids))""",
    ]


def silhouette_cte(src: str, name: str) -> str:
    return f"""{name} AS (
  SELECT CASE WHEN count(DISTINCT cluster) < 2 THEN NULL ELSE avg(s) END AS silhouette_score FROM (
    SELECT i, cluster,
      CASE WHEN n_own > 1 THEN (b - a) / greatest(a, b) ELSE 0.0 END AS s
    FROM (
      SELECT i, cluster, n_own,
        max(CASE WHEN other = cluster THEN dsum / greatest(n_other - 1, 1) END) AS a,
        min(CASE WHEN other <> cluster THEN dsum / n_other END) AS b
      FROM (
        SELECT p.row_id AS i, p.cluster, q.cluster AS other, sum(list_distance(p.features, q.features)) AS dsum,
          any_value(cn.n) AS n_other, any_value(co.n) AS n_own
        FROM {src} AS p JOIN {src} AS q ON true
        JOIN (SELECT cluster, count(*) AS n FROM {src} GROUP BY cluster) AS cn ON cn.cluster = q.cluster
        JOIN (SELECT cluster, count(*) AS n FROM {src} GROUP BY cluster) AS co ON co.cluster = p.cluster
        GROUP BY p.row_id, p.cluster, q.cluster) AS d
      GROUP BY i, cluster, n_own) AS ab) AS ss)"""


def eval_ctes(src: str, name: str, model: str, k: int, sample_size: int = 10_000) -> list[str]:
    cen = f"{name}_cen"
    return sample_ctes(src, f"{name}_smp", sample_size) + [
        silhouette_cte(f"{name}_smp", f"{name}_sil"),
        f"""{cen} AS (
  SELECT cluster, list(c ORDER BY d) AS centroid, any_value(n) AS n FROM (
    SELECT a.cluster, d, avg(x) AS c, any_value(sz.n) AS n
    FROM (SELECT cluster, unnest(features) AS x, generate_subscripts(features, 1) AS d FROM {src}) AS a
    JOIN (SELECT cluster, count(*) AS n FROM {src} GROUP BY cluster) AS sz ON a.cluster = sz.cluster
    GROUP BY a.cluster, d) AS t GROUP BY cluster)""",
        f"""{name}_spread AS (
  SELECT s.cluster, avg(list_distance(s.features, c.centroid)) AS "S",
    sum(list_distance(s.features, c.centroid) * list_distance(s.features, c.centroid)) AS "W"
  FROM {src} AS s JOIN {cen} AS c ON s.cluster = c.cluster GROUP BY s.cluster)""",
        f"""{name}_g AS (
  SELECT list(v ORDER BY d) AS g FROM (
    SELECT d, sum(x * n) / (SELECT sum(n) FROM {cen}) AS v FROM (
      SELECT n, unnest(centroid) AS x, generate_subscripts(centroid, 1) AS d FROM {cen}) AS u GROUP BY d) AS t)""",
        f"""{name}_scores AS (
  SELECT
    (SELECT avg(m) FROM (
       SELECT ci.cluster, max((si."S" + sj."S") / list_distance(ci.centroid, cj.centroid)) AS m
       FROM {cen} AS ci JOIN {cen} AS cj ON ci.cluster <> cj.cluster
       JOIN {name}_spread AS si ON si.cluster = ci.cluster JOIN {name}_spread AS sj ON sj.cluster = cj.cluster
       GROUP BY ci.cluster) AS t) AS davies_bouldin_score,
    ((SELECT sum(n * list_distance(centroid, (SELECT g FROM {name}_g)) * list_distance(centroid, (SELECT g FROM {name}_g)))
      FROM {cen}) / (count(*) - 1))
      / ((SELECT sum("W") FROM {name}_spread) / ((SELECT sum(n) FROM {cen}) - count(*))) AS calinski_harabasz_score,
    (SELECT sum("W") FROM {name}_spread) AS inertia
  FROM {cen})""",
        f"""{name}_sizes AS (
  SELECT map_from_entries(list(struct_pack(k := cluster, v := n) ORDER BY cluster)) AS cluster_sizes,
    CAST(sum(n) AS BIGINT) AS n_observations, count(*) AS n_assigned_clusters,
    min(n) AS min_cluster_count, max(n) AS max_cluster_count,
    min(n) / sum(n) AS min_cluster_share, max(n) / sum(n) AS max_cluster_share
  FROM (SELECT cluster, count(*) AS n FROM {src} GROUP BY cluster) AS t)""",
        f"""{name} AS (
  SELECT '{model}' AS model, {k} AS n_clusters, n_observations, n_assigned_clusters, inertia,
    CASE WHEN ok THEN davies_bouldin_score END AS davies_bouldin_score,
    CASE WHEN ok THEN calinski_harabasz_score END AS calinski_harabasz_score,
    CASE WHEN ok THEN silhouette_score END AS silhouette_score,
    ok AND NOT small AND NOT dominant AS is_valid_clustering,
    CASE WHEN NOT ok THEN printf('Invalid clustering solution: assigned %d cluster(s). Internal metrics require at least 2 clusters.', n_assigned_clusters)
         WHEN dominant THEN printf('Invalid clustering solution, one cluster dominates the portfolio. max_cluster_share=%.4f', max_cluster_share)
         WHEN small THEN printf('Invalid clustering solution, contains a small cluster: min_cluster_count=%d, min_cluster_share=%.4f', min_cluster_count, min_cluster_share)
         ELSE 'Valid clustering solution' END AS evaluation_note,
    cluster_sizes, min_cluster_count, min_cluster_share
  FROM (SELECT *, n_assigned_clusters > 1 AND n_assigned_clusters < n_observations AS ok,
          min_cluster_count < 50 OR min_cluster_share < 0.005 AS small, max_cluster_share > 0.85 AS dominant
        FROM {name}_sizes, {name}_scores, {name}_sil) AS t)""",
    ]


METRIC_DOUBLES = ["inertia", "davies_bouldin_score", "calinski_harabasz_score", "silhouette_score",
                  "min_cluster_share"]


def metrics_ctes() -> list[str]:
    ctes = []
    for i, (model, mod, k) in enumerate(CLUSTERINGS):
        ctes.append(assigned_cte(f"as{i}", mod))
        ctes += eval_ctes(f"as{i}", f"ev{i}", model, k)
    ctes.append("cmetrics AS (" + " UNION ALL ".join(f"SELECT * FROM ev{i}" for i in range(len(CLUSTERINGS)))
                + ")")
    return ctes


RANK = ("CAST(row_number() OVER (ORDER BY is_valid_clustering DESC, silhouette_score DESC NULLS LAST, "
        "davies_bouldin_score ASC NULLS LAST, model ASC) AS INTEGER) AS rank")


def curve(metric: str) -> str:
    return (f"SELECT regexp_replace(model, '_k[0-9]+$', '') AS model_family, n_clusters AS k, "
            f"{r(f'CAST({metric} AS DOUBLE)')} AS value, '{metric}' AS metric FROM cmetrics "
            f"WHERE {metric} IS NOT NULL")
