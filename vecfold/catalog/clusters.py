"""Cluster reports and validity metrics, with ``label`` as the cluster."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vecfold.catalog.registry import Tables, query
from vecfold.catalog.vectors import POSITIONS, points
from vecfold.operators import report as R
from vecfold.operators import validity as M
from vecfold.plans.lineage import shared_dir

CENTROIDS_SQL = f"""
cm AS (SELECT label, pos, avg(embedding[pos]::DOUBLE) AS m FROM embeddings, {POSITIONS} GROUP BY ALL),
cents AS (SELECT label, list(m ORDER BY pos) AS c FROM cm GROUP BY label),
dist AS (SELECT e.vec_id, e.label, list_distance(e.embedding::DOUBLE[], c) AS d FROM embeddings e JOIN cents USING (label))"""
REPORT_SQL = f"""
WITH {CENTROIDS_SQL}
SELECT label, arg_min(vec_id, (d, vec_id)) AS representative, count(*) AS size FROM dist GROUP BY label"""
PAIRS_SQL = """
pairs AS (
  SELECT a.vec_id AS i, b.vec_id AS j, a.label AS li, b.label AS lj,
         list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d
  FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id
)"""


def labelled(t: Tables):
    """Label as cluster, label 0 as noise."""
    noise = F.when(F.col("label") == 0, R.NOISE).otherwise(F.col("label"))
    return t.embeddings.select("vec_id", "embedding", noise.cast("int").alias("cluster"))


def scored(t: Tables):
    return points(t).join(t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("cluster")), "id")


@query(REPORT_SQL)
def cluster_report(t: Tables):
    return R.cluster_report(t.embeddings, "vec_id", "embedding", "label").clusters


@query(REPORT_SQL)
def written_report(t: Tables):
    path = f"{shared_dir(t.spark)}/vecfold-reports/{uuid.uuid4().hex}"
    R.write_report(R.cluster_report(t.embeddings, "vec_id", "embedding", "label"), path)
    return t.spark.read.parquet(f"{path}/clusters")


@query("SELECT vec_id, label AS cluster FROM embeddings WHERE label <> 0")
def clustered_rows(t: Tables):
    return R.clustered(labelled(t)).select("vec_id", "cluster")


@query("SELECT vec_id FROM embeddings WHERE label = 0")
def report_outliers(t: Tables):
    return R.cluster_report(labelled(t), "vec_id", "embedding").outliers


@query("SELECT avg((label = 0)::INT) AS noise_ratio, count(*) AS n_rows FROM embeddings")
def noise_ratio(t: Tables):
    return R.noise_ratio(labelled(t))


@query("""
WITH p AS (SELECT label, vec_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 20 AS chunk FROM embeddings)
SELECT label, chunk, list(vec_id ORDER BY vec_id) AS members FROM p GROUP BY ALL
""")
def membership(t: Tables):
    return R.membership(t.embeddings, "vec_id", "label", chunk_rows=20)


@query("SELECT vec_id, label FROM embeddings")
def labels_from_members(t: Tables):
    return R.labels(R.membership(t.embeddings, "vec_id", "label", chunk_rows=20), "vec_id", "label")


@query("""
WITH s AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, min(vec_id)) - 1 AS dense
           FROM embeddings WHERE label <> 0 GROUP BY label)
SELECT vec_id, coalesce(dense, -1)::INT AS cluster FROM embeddings LEFT JOIN s USING (label)
""")
def relabel(t: Tables):
    return R.relabel(labelled(t).select("vec_id", "cluster"), "vec_id")


@query(f"""
WITH {PAIRS_SQL},
per AS (SELECT i, li, lj, sum(d) AS s, count(*) AS n FROM pairs GROUP BY ALL),
ab AS (SELECT i, max(CASE WHEN li = lj THEN s / n END) AS a, min(CASE WHEN li <> lj THEN s / n END) AS b FROM per GROUP BY i)
SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM ab
""")
def silhouette(t: Tables):
    return M.silhouette(M.cluster_blocks(scored(t))).select(F.round("silhouette", 6).alias("silhouette"))


@query(f"""
WITH {PAIRS_SQL},
per AS (SELECT i, li, lj, sum(d) AS s, count(*) AS n FROM pairs GROUP BY ALL)
SELECT i AS id, round(max(CASE WHEN li = lj THEN s / n END), 5) AS a,
       round(min(CASE WHEN li <> lj THEN s / n END), 5) AS b FROM per GROUP BY i
""")
def silhouette_rows(t: Tables):
    rows = M.silhouette_rows(M.cluster_blocks(scored(t)))
    return rows.select("id", F.round("a", 5).alias("a"), F.round("b", 5).alias("b"))


@query(f"""
WITH {CENTROIDS_SQL},
sc AS (SELECT label, avg(d) AS s FROM dist GROUP BY label),
r AS (SELECT a.label, max((sa.s + sb.s) / list_distance(a.c, b.c)) AS worst
      FROM cents a JOIN sc sa ON sa.label = a.label, cents b JOIN sc sb ON sb.label = b.label
      WHERE a.label <> b.label GROUP BY a.label)
SELECT round(avg(worst), 5) AS davies_bouldin FROM r
""")
def davies_bouldin(t: Tables):
    return M.davies_bouldin(scored(t)).select(F.round("davies_bouldin", 5).alias("davies_bouldin"))


@query(f"""
WITH {CENTROIDS_SQL},
om AS (SELECT pos, avg(embedding[pos]::DOUBLE) AS m FROM embeddings, {POSITIONS} GROUP BY pos),
o AS (SELECT list(m ORDER BY pos) AS m FROM om),
w AS (SELECT label, sum(d * d) AS w, count(*) AS n FROM dist GROUP BY label),
s AS (SELECT sum(w) AS w, sum(n * list_distance(c, m) ** 2) AS b, sum(n) AS n, count(*) AS k
      FROM w JOIN cents USING (label), o)
SELECT round((b / (k - 1)) / (w / (n - k)), 5) AS calinski_harabasz FROM s
""")
def calinski_harabasz(t: Tables):
    return M.calinski_harabasz(scored(t)).select(F.round("calinski_harabasz", 5).alias("calinski_harabasz"))


@query(f"""
WITH {PAIRS_SQL}
SELECT round(min(CASE WHEN li <> lj THEN d END) / max(CASE WHEN li = lj THEN d END), 5) AS dunn FROM pairs
""")
def dunn(t: Tables):
    return M.dunn(scored(t)).select(F.round("dunn", 5).alias("dunn"))
