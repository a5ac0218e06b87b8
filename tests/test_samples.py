import numpy as np
import pytest
from pyspark.sql import functions as F

from vecfold.operators import sample as S
from vecfold.operators import trials as T
from vecfold.operators.report import cluster_report, membership, relabel
from vecfold.plans import lineage
from vecfold.plans.ordered import ordinal, prefix, ranges


def test_design_uses_every_bucket_once(spark):
    rows = S.lhs_design(spark, 37, 5, seed=3).toPandas()
    for _, axis in rows.groupby("axis"):
        assert sorted(axis.bucket) == list(range(37))
    assert rows.offset.between(0, 1, inclusive="left").all()
    orders = {tuple(a.sort_values("i").bucket) for _, a in rows.groupby("axis")}
    assert len(orders) == 5


@pytest.mark.parametrize("m", [1, 2, 30, 97])
def test_points_stay_in_their_buckets_without_a_shuffle(spark, m):
    df = spark.createDataFrame([(0, [0.0, -2.0]), (1, [1.0, 6.0])], "id long, v array<double>")
    points = S.lhs_points(df, "v", m, 5)
    assert "Exchange" not in points._jdf.queryExecution().executedPlan().toString()
    got = np.array([r["v"] for r in points.collect()])
    for axis, (low, high) in enumerate([(0, 1), (-2, 6)]):
        assert sorted(np.floor((got[:, axis] - low) / (high - low) * m).astype(int)) == list(range(m))


def test_sample_is_exact_distinct_and_repeatable(spark):
    df = spark.range(5000)
    for k in (0, 1, 777, 5000, 9000):
        picked = S.sample_k(df, "id", k, seed=2)
        assert picked.count() == picked.distinct().count() == min(k, 5000)
    assert S.sample_k(df, "id", 50, 2).exceptAll(S.sample_k(df.repartition(7), "id", 50, 2)).count() == 0
    assert S.sample_k(df, "id", 50, 2).exceptAll(S.sample_k(df, "id", 50, 3)).count() > 0


def test_lhs_subsample_size(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(c) for c in rng.normal(size=3)]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    n = S.lhs_subsample(df, "id", "v", 0.3, 5).count()
    assert 1 <= n <= S.lhs_rows(200, 0.3) == 61  # 200 * 0.3 is above 60 in single precision
    assert S.lhs_subsample(df.filter("id < 0"), "id", "v", 0.3).count() == 0


def test_ordinal_and_prefix_split_a_hot_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 5 + 1).alias("k"), (3000 - F.col("id")).alias("x"))
    got = ordinal(df, ["x"], within=["k"]).toPandas()
    for _, g in got.groupby("k"):
        assert list(g.sort_values("x").ordinal) == list(range(len(g)))
    parts = ranges(df, ["k", "x"])
    assert parts.filter("k = 0").select("_range").distinct().count() > 1
    run = prefix(parts, ["x"], ["k"], total=("sum", "x"), top=("max", "x"), low=("min", "x")).toPandas()
    for _, g in run.groupby("k"):
        g = g.sort_values("x")
        assert list(g.total) == list(g.x.cumsum()) and list(g.top) == list(g.x) and set(g.low) == {g.x.min()}


def test_relabel_and_membership(spark):
    rows = [(0, 7), (1, 7), (2, 5), (3, -1), (4, 5), (5, 9), (6, 9), (7, 9)]
    df = spark.createDataFrame(rows, "id long, cluster int")
    got = {r["id"]: r["cluster"] for r in relabel(df, "id").collect()}
    assert got == {5: 0, 6: 0, 7: 0, 0: 1, 1: 1, 2: 2, 4: 2, 3: -1}
    lists = membership(df, "id", chunk_rows=2).collect()
    assert all(len(r["members"]) <= 2 for r in lists)
    assert sorted(r["members"] for r in lists if r["cluster"] == 9) == [[5, 6], [7]]


def test_report_on_raw_vectors(spark):
    rows = [(0, [0.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [5.0, 0.0], 0), (3, [9.0, 9.0], -1)]
    df = spark.createDataFrame(rows, "id long, v array<double>, cluster int")
    report = cluster_report(df, "id", "v")
    assert [tuple(r) for r in report.clusters.collect()] == [(0, 1, 3)]
    assert report.members.count() == 3 and [r["id"] for r in report.outliers.collect()] == [3]


def test_bounds_clamp(spark):
    assert T.search_bounds(500, 64, 500) == {"pca_dim": (50, 63), "min_samples": (2, 11), "min_cluster_size": (2, 11)}
    assert T.search_bounds(10, 8, 10)["pca_dim"] == (7, 7)
    assert T.search_bounds(0, 0, 0)["pca_dim"] == (0, 0)
    assert T.search_rows(100000, 767) == 2000 and T.search_rows(100000, 4095) == 4096
    assert T.pca_rounds(1)[1] == (0.5, 1) and T.hdbscan_rounds(25) == [(0.25, 25), (0.5, 12), (1.0, 6)]
    assert T.pca_rounds(7) == [(0.2, 7), (0.5, 3), (1.0, 2)]


def test_ranking_puts_nan_last_and_keeps_order_on_ties(spark):
    rows = [(0, 1.0), (1, float("nan")), (2, 2.0), (3, 1.0), (4, float("-inf"))]
    scores = spark.createDataFrame(rows, "grid_ord long, score double")
    got = [r["grid_ord"] for r in T.ranked(scores, "grid_ord").orderBy("place").collect()]
    assert got == [2, 0, 3, 4, 1]


def test_halving_drops_nobody_first(spark):
    grid = T.hdbscan_grid(spark)
    mark = (F.col("min_samples") * 37 + F.col("min_cluster_size") * 11) % 97 / 97.0
    history = T.successive_halving(grid, lambda trials, share: trials.withColumn("score", mark), T.hdbscan_rounds(25))
    counts = {r["round"]: r["count"] for r in history.groupBy("round").count().collect()}
    assert counts == {0: 25, 1: 25, 2: 12}
    best = T.halving_winner(history).first()
    top = max((a * 37 + b * 11) % 97 for a in T.MIN_SAMPLES for b in T.MIN_CLUSTER_SIZE)
    assert (best["min_samples"] * 37 + best["min_cluster_size"] * 11) % 97 == top


def test_scratch_lies_in_the_shared_folder_and_can_be_dropped(spark):
    out = lineage.cut(spark.range(10))
    files = out.inputFiles()
    assert out.count() == 10 and lineage.scratch_dir(spark).split(":")[-1] in files[0]
    lineage.drop_scratch(spark)
    import os

    assert not os.path.exists(files[0].split("://")[-1])
