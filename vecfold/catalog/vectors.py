"""Vector math, grouped vector aggregates, reduction, neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecfold.catalog.ingest import components
from vecfold.catalog.registry import Tables, query
from vecfold.functions import vectors as V
from vecfold.operators import neighbors as N
from vecfold.operators import reduce as R
from vecfold.operators.report import with_centroid

POSITIONS = "(SELECT unnest(range(1, 65)) AS pos)"
PLANTED_SQL = (
    "SELECT vec_id, label, list_transform(embedding::DOUBLE[], "
    "lambda x, i: 0.3 * x + (CASE WHEN i - 1 = label THEN 1 ELSE 0 END)) AS v FROM embeddings"
)
# every row against every other row of the planted view
PLANTED_PAIRS = f"""
planted AS ({PLANTED_SQL}),
pairs AS (
  SELECT a.vec_id AS i, b.vec_id AS j, a.label AS li, b.label AS lj, list_distance(a.v, b.v) AS d
  FROM planted a, planted b WHERE a.vec_id <> b.vec_id
)"""


def points(t: Tables):
    """The stored vectors as one group."""
    return t.embeddings.select(
        F.lit(0).alias("g"), F.col("vec_id").alias("id"), V.as_doubles(F.col("embedding")).alias("v")
    )


def planted(t: Tables):
    """Vectors with ten planted clusters, one per label."""
    shifted = F.transform(
        V.as_doubles(F.col("embedding")),
        lambda x, i: F.lit(0.3) * x + F.when(i == F.col("label"), 1.0).otherwise(0.0),
    )
    return t.embeddings.select(F.lit(0).alias("g"), F.col("vec_id").alias("id"), shifted.alias("v"), "label")


@query("""
SELECT vec_id,
  round(list_distance(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]) ** 2, 6) AS sq,
  round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm,
  round(embedding[3]::DOUBLE * 2.5, 6) AS scaled,
  round(embedding[3]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS unit
FROM embeddings
""")
def vector_math(t: Tables):
    v = F.col("embedding")
    return t.embeddings.select(
        "vec_id",
        F.round(V.sqdist(v, F.reverse(v)), 6).alias("sq"),
        F.round(V.norm(v), 6).alias("norm"),
        F.round(V.scale(v, F.lit(2.5))[2], 6).alias("scaled"),
        F.round(V.normalise(v)[2], 6).alias("unit"),
    )


@query(f"""
SELECT label, pos - 1 AS pos, round(min(embedding[pos]::DOUBLE), 6) AS low, round(max(embedding[pos]::DOUBLE), 6) AS high
FROM embeddings, {POSITIONS} GROUP BY ALL
""")
def axis_ranges_by_label(t: Tables):
    boxes = V.axis_ranges(t.embeddings, "embedding", ["label"])
    sides = boxes.select("label", F.posexplode(F.arrays_zip("mins", "maxs")).alias("pos", "s"))
    return sides.select("label", "pos", F.round("s.mins", 6).alias("low"), F.round("s.maxs", 6).alias("high"))


@query("""
SELECT 0 AS pos, round(min(l_quantity), 4) AS low, round(max(l_quantity), 4) AS high FROM lineitem UNION ALL
SELECT 1, round(min(l_extendedprice), 4), round(max(l_extendedprice), 4) FROM lineitem UNION ALL
SELECT 2, round(min(l_discount), 4), round(max(l_discount), 4) FROM lineitem UNION ALL
SELECT 3, round(min(l_tax), 4), round(max(l_tax), 4) FROM lineitem
""")
def axis_ranges_lineitem(t: Tables):
    rows = t.lineitem.select(F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("v"))
    sides = V.axis_ranges(rows, "v").select(F.posexplode(F.arrays_zip("mins", "maxs")).alias("pos", "s"))
    return sides.select("pos", F.round("s.mins", 4).alias("low"), F.round("s.maxs", 4).alias("high"))


@query(f"""
SELECT label, pos - 1 AS pos, round(avg(embedding[pos]::DOUBLE), 6) AS x
FROM embeddings, {POSITIONS} GROUP BY ALL
""")
def centroids_by_label(t: Tables):
    return components(V.centroids(t.embeddings, ["label"], "embedding"), "label", "centroid", 6)


@query("""
SELECT l_suppkey, round(avg(l_quantity), 4) AS quantity, round(avg(l_extendedprice), 3) AS price, count(*) AS size
FROM lineitem GROUP BY ALL
""")
def centroids_lineitem(t: Tables):
    rows = t.lineitem.select("l_suppkey", F.array("l_quantity", "l_extendedprice").alias("v"))
    c = V.centroids(rows, ["l_suppkey"], "v")
    return c.select(
        "l_suppkey", F.round(F.col("centroid")[0], 4).alias("quantity"),
        F.round(F.col("centroid")[1], 3).alias("price"), "size",
    )


@query(f"""
WITH c AS (SELECT label, pos, avg(embedding[pos]::DOUBLE) AS m FROM embeddings, {POSITIONS} GROUP BY ALL),
cl AS (SELECT label, list(m ORDER BY pos) AS c FROM c GROUP BY label)
SELECT vec_id, label, round(list_distance(embedding::DOUBLE[], c), 6) AS dist FROM embeddings JOIN cl USING (label)
""")
def centroid_distances(t: Tables):
    rows = with_centroid(t.embeddings, ["label"], "embedding")
    d = F.sqrt(V.sqdist(F.col("embedding"), F.col("centroid")))
    return rows.select("vec_id", "label", F.round(d, 6).alias("dist"))


@query("""
WITH d AS (
  SELECT a.vec_id AS id, b.vec_id AS nbr, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d
  FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id
)
SELECT id, nbr, row_number() OVER (PARTITION BY id ORDER BY d, nbr) AS place, round(d, 6) AS dist
FROM d QUALIFY place <= 5
""")
def nearest_neighbors(t: Tables):
    found = N.knn(N.build_index(points(t), []), 5)
    rows = found.select("id", F.posexplode(F.arrays_zip("nbr", "dist")).alias("p", "x"))
    return rows.select(
        "id", F.col("x.nbr").alias("nbr"), (F.col("p") + 1).alias("place"), F.round("x.dist", 6).alias("dist")
    )


@query(f"""
WITH {PLANTED_PAIRS}
SELECT i AS id, round(d, 6) AS core FROM pairs
QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) = 4
""")
def core_distances(t: Tables):
    """Distance to the 5th nearest row, the row itself being the first."""
    found = N.knn(N.build_index(planted(t).drop("label"), []), 5).withColumn("mult", F.lit(1))
    return found.select("id", F.round(N.core_distance(True, 5), 6).alias("core"))


@query("""
SELECT round(sum(var), 6) AS total FROM (
  SELECT var_samp(embedding[pos]::DOUBLE) AS var FROM embeddings, (SELECT unnest(range(1, 65)) AS pos) GROUP BY pos
)
""")
def pca_total_variance(t: Tables):
    """All components together carry the variance of the input."""
    scores = components(R.pca(t.embeddings, "embedding", 64).rows, "vec_id", "reduced", 12)
    return scores.groupBy("pos").agg(F.var_samp("x").alias("v")).agg(F.round(F.sum("v"), 6).alias("total"))


@query("""
WITH m AS (SELECT pos, avg(embedding[pos]::DOUBLE) AS m FROM embeddings, (SELECT unnest(range(1, 65)) AS pos) GROUP BY pos),
ml AS (SELECT list(m ORDER BY pos) AS m FROM m)
SELECT vec_id, round(list_distance(embedding::DOUBLE[], m), 6) AS size FROM embeddings, ml
""")
def pca_rotation(t: Tables):
    """At full dimension the centred scores keep every row's distance to the mean."""
    rows = R.pca(t.embeddings, "embedding", 64).rows
    return rows.select("vec_id", F.round(V.norm(F.col("reduced")), 6).alias("size"))


@query()
def pca_explained(t: Tables):
    """Scores' variance per component, in descending order."""
    scores = components(R.pca(t.embeddings, "embedding", 16).rows, "vec_id", "reduced", 12)
    return scores.groupBy("pos").agg(F.round(F.var_samp("x"), 8).alias("variance"))


@query("SELECT vec_id, 64 AS dim, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def reduce_skipped(t: Tables):
    rows = R.reduce(t.embeddings, "embedding", 0)
    total = F.aggregate("reduced", F.lit(0.0), lambda s, x: s + x)
    return rows.select("vec_id", F.size("reduced").alias("dim"), F.round(total, 6).alias("total"))


@query("""
SELECT count(*) AS n_rows, max(len(embedding)) AS n_cols, least(count(*), max(len(embedding))) - 1 AS max_dim
FROM embeddings
""")
def largest_dimension(t: Tables):
    return R.max_dim(t.embeddings, "embedding")
