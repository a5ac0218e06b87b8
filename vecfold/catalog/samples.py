"""Sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecfold.catalog.registry import Tables, query
from vecfold.catalog.vectors import POSITIONS
from vecfold.operators import sample as S

SEED = 11

# the arithmetic design: points i, axes 0..63, one bucket of m per axis and point
DESIGN_SQL = f"""
size AS (SELECT ceil(count(*)::FLOAT * 0.2::FLOAT)::BIGINT AS m FROM embeddings),
starts AS (
  SELECT m, axis, (({SEED} + 1) * 7919 + (axis + 1) * 104729) % m AS s, ({SEED} * 31 + (axis + 1) * 7907) % m AS shift
  FROM size, (SELECT unnest(range(0, 64)) AS axis)),
maps AS (
  SELECT m, axis, shift, min(s + k) % m AS factor FROM starts, (SELECT unnest(range(0, 1000)) AS k)
  WHERE gcd(s + k, m) = 1 GROUP BY m, axis, shift),
design AS (
  SELECT i, axis, (factor * i + shift) % m AS bucket,
    (((i + 1) * (axis + 1) * 7907 + {SEED} * 31) % 1000003) / 1000003.0::DOUBLE AS off
  FROM maps, (SELECT unnest(range(0, m)) AS i FROM size)
)"""
NEAREST_SQL = f"""
{DESIGN_SQL},
box AS (SELECT pos - 1 AS axis, min(embedding[pos]::DOUBLE) AS lo, max(embedding[pos]::DOUBLE) AS hi FROM embeddings, {POSITIONS} GROUP BY pos),
synthetic AS (
  SELECT i, list(lo + (bucket + off) / m::DOUBLE * (hi - lo) ORDER BY axis) AS p
  FROM design JOIN box USING (axis), size GROUP BY i
),
dists AS (SELECT i, vec_id, list_distance(embedding::DOUBLE[], p) AS d FROM synthetic, embeddings),
nearest AS (SELECT i, vec_id, d FROM dists QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, vec_id) = 1)"""


@query(f"WITH {DESIGN_SQL} SELECT i, axis, bucket, round(off, 8) AS off FROM design")
def lhs_design(t: Tables):
    m = S.lhs_rows(t.embeddings.count(), 0.2)
    rows = S.lhs_design(t.spark, m, 64, SEED, "arithmetic")
    return rows.select("i", "axis", "bucket", F.round("offset", 8).alias("off"))


@query(f"WITH {NEAREST_SQL} SELECT i, vec_id, round(d, 6) AS dist FROM nearest")
def nearest_row(t: Tables):
    rows = t.embeddings
    points = S.lhs_points(rows, "embedding", S.lhs_rows(rows.count(), 0.2), SEED, "arithmetic")
    return S.nearest_row(points, rows, "vec_id", "embedding").withColumn("dist", F.round("dist", 6))


@query(f"WITH {NEAREST_SQL} SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT vec_id FROM nearest)")
def lhs_subsample(t: Tables):
    return S.lhs_subsample(t.embeddings, "vec_id", "embedding", 0.2, SEED, "arithmetic").select("vec_id", "label")


@query(f"""
SELECT o_orderkey, o_custkey FROM orders
QUALIFY row_number() OVER (ORDER BY ((o_orderkey + 1) * 7919 + (o_orderkey % 97) * 104729 + {SEED}) % 1000003, o_orderkey)
  <= (SELECT floor(count(*) * 0.25) FROM orders)
""")
def sample_k(t: Tables):
    k = S.share_rows(t.orders.count(), 0.25)
    return S.sample_k(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey", k, SEED, "arithmetic")


@query("""
SELECT lang, count(*) AS n, ceil(count(*)::FLOAT * 0.3::FLOAT)::BIGINT AS up, floor(count(*) * 0.3)::BIGINT AS down
FROM documents GROUP BY lang
""")
def fraction_rows(t: Tables):
    """Row counts of the two samplers for a share of 0.3, as expressions."""
    n = F.count(F.lit(1))
    up = F.ceil((n.cast("float") * F.lit(0.3).cast("float")).cast("float")).cast("long")
    return t.documents.groupBy("lang").agg(n.alias("n"), up.alias("up"), F.floor(n * 0.3).alias("down"))
