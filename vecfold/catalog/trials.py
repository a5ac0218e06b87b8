"""Trial tables scored from the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecfold.catalog.registry import Tables, query
from vecfold.catalog.samples import SEED
from vecfold.operators import reduce as R
from vecfold.operators import sample as S
from vecfold.operators import trials as T
from vecfold.operators import validity as M

GRID_SQL = """
grid AS (
  SELECT (a - 1) * 5 + (b - 1) AS grid_ord, ([3, 5, 10, 20, 50])[a] AS min_samples, ([3, 5, 10, 20, 50])[b] AS min_cluster_size
  FROM (SELECT unnest(range(1, 6)) AS a), (SELECT unnest(range(1, 6)) AS b)
)"""
SCORE = "avg((o_orderkey * min_samples + o_custkey * min_cluster_size * 11) % 97) / 97"
FULL_SQL = f"""
{GRID_SQL},
scores AS (SELECT grid_ord, min_samples, min_cluster_size, {SCORE} AS score FROM grid, orders GROUP BY ALL)"""


def order_scores(rows, trials):
    """A cheap data-derived score per trial: one pass over the rows, one average per trial."""
    items = trials.collect()  # at most the size of the grid
    mixed = [(F.col("o_orderkey") * r["min_samples"] + F.col("o_custkey") * r["min_cluster_size"] * 11) % 97 for r in items]
    means = rows.agg(F.array(*[F.avg(x) / 97 for x in mixed]).alias("means"))
    literal = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in trials.columns]) for r in items])
    scored = means.select(F.posexplode("means").alias("at", "score")).select(F.get(literal, F.col("at")).alias("t"), "score")
    return scored.select("t.*", "score")


def full_scores(t: Tables):
    return order_scores(t.orders, T.hdbscan_grid(t.spark))


@query(f"WITH {FULL_SQL} SELECT grid_ord, min_samples, min_cluster_size, round(score, 8) AS score FROM scores")
def trial_grid(t: Tables):
    return full_scores(t).withColumn("score", F.round("score", 8))


@query(f"WITH {FULL_SQL} SELECT grid_ord, row_number() OVER (ORDER BY score DESC, grid_ord) AS place FROM scores")
def ranked_trials(t: Tables):
    return T.ranked(full_scores(t), "grid_ord").select("grid_ord", "place")


@query(f"""
WITH {FULL_SQL}
SELECT min_samples, grid_ord, row_number() OVER (PARTITION BY min_samples ORDER BY score DESC, grid_ord) AS place
FROM scores QUALIFY place <= 3
""")
def leaderboard(t: Tables):
    return T.leaderboard(full_scores(t), "grid_ord", ["min_samples"], 3).select("min_samples", "grid_ord", "place")


@query(f"WITH {FULL_SQL} SELECT grid_ord, round(max(score) OVER (ORDER BY grid_ord), 8) AS best_so_far FROM scores")
def running_best(t: Tables):
    return T.running_best(full_scores(t), "grid_ord").select("grid_ord", F.round("best_so_far", 8).alias("best_so_far"))


@query(f"""
WITH {FULL_SQL}
SELECT min_samples, min_cluster_size, round(score, 8) AS score FROM scores ORDER BY scores.score DESC, grid_ord LIMIT 1
""")
def best_trial(t: Tables):
    return T.winner(full_scores(t), "grid_ord").select(
        "min_samples", "min_cluster_size", F.round("score", 8).alias("score")
    )


def _round_sql(number: int, share: float, source: str) -> str:
    h = f"((o_orderkey + 1) * 7919 + (o_orderkey % 97) * 104729 + {SEED + number}) % 1000003"
    return f"""
s{number} AS (SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (ORDER BY {h}, o_orderkey)
       <= (SELECT floor(count(*) * {share}) FROM orders)),
r{number} AS (SELECT grid_ord, score, row_number() OVER (ORDER BY score DESC, grid_ord) AS place FROM
       (SELECT grid_ord, {SCORE} AS score FROM {source}, s{number} GROUP BY grid_ord))"""


@query(f"""
WITH {GRID_SQL}, {_round_sql(0, 0.25, 'grid')},
g1 AS (SELECT * FROM grid WHERE grid_ord IN (SELECT grid_ord FROM r0 WHERE place <= 25)), {_round_sql(1, 0.5, 'g1')},
g2 AS (SELECT * FROM grid WHERE grid_ord IN (SELECT grid_ord FROM r1 WHERE place <= 12)), {_round_sql(2, 1.0, 'g2')}
SELECT 0 AS round, grid_ord, place, round(score, 8) AS score FROM r0 UNION ALL
SELECT 1, grid_ord, place, round(score, 8) FROM r1 UNION ALL
SELECT 2, grid_ord, place, round(score, 8) FROM r2
""")
def successive_halving(t: Tables):
    grid = T.hdbscan_grid(t.spark)
    n = t.orders.count()
    seeds = iter(range(SEED, SEED + 3))

    def score(trials, share):
        rows = S.sample_k(t.orders, "o_orderkey", S.share_rows(n, share), next(seeds), "arithmetic")
        return order_scores(rows, trials)

    history = T.successive_halving(grid, score, T.hdbscan_rounds(25))
    return history.select("round", "grid_ord", "place", F.round("score", 8).alias("score"))


@query("""
WITH n AS (SELECT max(len(embedding)) AS n_cols FROM embeddings)
SELECT dim, n_cols FROM n, (SELECT unnest([8, 16, 32, 48, 64, 128, 200]) AS dim) WHERE dim < n_cols
""")
def candidate_dimensions(t: Tables):
    n_cols = R.max_dim(t.embeddings, "embedding").first()["n_cols"]
    dims = T.dims_below(n_cols, [8, 16, 32, 48, 64, 128, 200])
    return T.grid(t.spark, dim=dims).select("dim", F.lit(n_cols).alias("n_cols"))


BOUNDS_SQL = """
shape AS (SELECT count(*) AS n, max(len(embedding)) AS d FROM embeddings),
lim AS (SELECT n, d, least(n - 1, d - 1) AS md,
          least(n, greatest(2000, least(n - 1, d - 1) + 1)) AS s FROM shape),
bounds AS (SELECT md, least(50, md) AS lo, s, least(50, greatest(5, floor(sqrt(s))::INT // 2)) AS ms FROM lim)"""


def _bounds(t: Tables):
    shape = R.max_dim(t.embeddings, "embedding").first()
    rows = T.search_rows(shape["n_rows"], shape["max_dim"])
    return rows, T.search_bounds(shape["n_rows"], shape["n_cols"], rows)


@query(f"""
WITH {BOUNDS_SQL}
SELECT 'pca_dim' AS axis, lo::BIGINT AS low, md::BIGINT AS high, s::BIGINT AS rows FROM bounds UNION ALL
SELECT 'min_samples', 2, ms, s FROM bounds UNION ALL
SELECT 'min_cluster_size', 2, ms, s FROM bounds
""")
def search_bounds(t: Tables):
    rows, bounds = _bounds(t)
    table = [(axis, low, high, rows) for axis, (low, high) in bounds.items()]
    return t.spark.createDataFrame(table, "axis string, low long, high long, rows long")


def _axis_sql(axis: int) -> str:
    start = f"(({SEED} + 1) * 7919 + ({axis} + 1) * 104729) % 40"
    factor = f"(SELECT min({start} + k) FROM (SELECT unnest(range(0, 40)) AS k) WHERE gcd({start} + k, 40) = 1)"
    bucket = f"({factor} * i + {SEED} * 31 + ({axis} + 1) * 7907) % 40"
    offset = f"(((i + 1) * ({axis} + 1) * 7907 + {SEED} * 31) % 1000003) / 1000003.0::DOUBLE"
    return f"({bucket} + {offset}) / 40.0::DOUBLE AS u{axis}"


@query(f"""
WITH {BOUNDS_SQL},
u AS (SELECT i, {_axis_sql(0)}, {_axis_sql(1)}, {_axis_sql(2)} FROM (SELECT unnest(range(0, 40)) AS i))
SELECT i AS trial, least(md, lo + floor(u0 * (md - lo + 1)))::INT AS pca_dim,
  least(ms, 2 + floor(u1 * (ms - 1)))::INT AS min_samples, least(ms, 2 + floor(u2 * (ms - 1)))::INT AS min_cluster_size
FROM u, bounds
""")
def search_design(t: Tables):
    _, bounds = _bounds(t)
    return T.design(t.spark, bounds, 40, SEED, "arithmetic")


TRIAL_STATS_SQL = """
stats AS (
  SELECT l_suppkey % 50 AS trial, count(*) AS n_rows, avg((l_returnflag = 'R')::INT) AS noise_ratio,
    count(DISTINCT l_linenumber) AS n_clusters, avg(l_discount) * 10 AS dbcv, avg(l_tax) * 5 AS silhouette,
    avg(l_quantity) AS davies_bouldin, max(l_extendedprice) AS calinski_harabasz, min(l_extendedprice) AS dunn
  FROM lineitem GROUP BY ALL
)"""


def trial_stats(t: Tables):
    return t.lineitem.groupBy((F.col("l_suppkey") % 50).alias("trial")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg((F.col("l_returnflag") == "R").cast("int")).alias("noise_ratio"),
        F.count_distinct("l_linenumber").alias("n_clusters"),
        (F.avg("l_discount") * 10).alias("dbcv"),
        (F.avg("l_tax") * 5).alias("silhouette"),
        F.avg("l_quantity").alias("davies_bouldin"),
        F.max("l_extendedprice").alias("calinski_harabasz"),
        F.min("l_extendedprice").alias("dunn"),
    )


@query(f"""
WITH {TRIAL_STATS_SQL}
SELECT trial, (n_clusters < 2 OR noise_ratio > 0.5 OR n_rows <= 12 * trial OR 12 * trial < 2) AS rejected FROM stats
""")
def rejected_trials(t: Tables):
    dim = F.col("trial") * 12
    bad = M.rejected(F.col("n_clusters"), F.col("noise_ratio"), F.col("n_rows"), dim)
    return trial_stats(t).select("trial", bad.alias("rejected"))


@query(f"""
WITH {TRIAL_STATS_SQL}
SELECT trial, round((0.50 * (dbcv + 1) / 2 + 0.30 * (silhouette + 1) / 2 + 0.20 / (1 + davies_bouldin)) * (1 - noise_ratio), 6) AS score
FROM stats
""")
def composite_scores(t: Tables):
    score = M.composite(F.col("dbcv"), F.col("silhouette"), F.col("davies_bouldin"), F.col("noise_ratio"))
    return trial_stats(t).select("trial", F.round(score, 6).alias("score"))


@query(f"""
WITH {TRIAL_STATS_SQL},
n AS (SELECT *, trial % 5 AS sweep, min(calinski_harabasz) OVER w AS c0, max(calinski_harabasz) OVER w AS c1,
        min(dunn) OVER w AS d0, max(dunn) OVER w AS d1 FROM stats WINDOW w AS (PARTITION BY trial % 5))
SELECT trial, sweep, round(0.30 * (dbcv + 1) / 2 + 0.25 * (silhouette + 1) / 2 + 0.20 / (1 + davies_bouldin)
  + 0.15 * (CASE WHEN c1 - c0 < 1e-9 THEN 0.5 ELSE (calinski_harabasz - c0) / (c1 - c0) END)
  + 0.10 * (CASE WHEN d1 - d0 < 1e-9 THEN 0.5 ELSE (dunn - d0) / (d1 - d0) END), 6) AS score
FROM n
""")
def sweep_scores(t: Tables):
    trials = trial_stats(t).withColumn("sweep", F.col("trial") % 5)
    return M.sweep_score(trials, ["sweep"]).select("trial", "sweep", F.round("sweep_score", 6).alias("score"))
