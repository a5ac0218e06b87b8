import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from vecfold.operators import hdbscan as H
from vecfold.operators import neighbors as N
from vecfold.operators.dbcv import dbcv
from vecfold.operators.graph import components, roots


def sample(kind, rng):
    n, dim = int(rng.integers(2, 70)), int(rng.integers(1, 4))
    if kind == 0:
        return rng.normal(size=(n, dim))
    if kind == 1:  # ties everywhere
        return rng.integers(0, 6, size=(n, dim)).astype(float)
    if kind == 2:
        return np.concatenate([rng.normal(c * 6, 1, size=(n // 3 + 1, dim)) for c in range(3)])
    x = rng.normal(size=(n, dim))
    x[: n // 3] = x[0]  # a third of all rows are copies
    return x


def frame(spark, data, extra=None):
    rows = [
        (g, i, [float(c) for c in x[i]], *([int(extra[g][i])] if extra else []))
        for g, x in enumerate(data) for i in range(len(x))
    ]
    return spark.createDataFrame(rows, "g int, id long, v array<double>" + (", cluster int" if extra else ""))


@pytest.fixture()
def small_blocks(monkeypatch):
    """Many cells and blocks even on a fixture, so that pruning and block pairs are exercised."""
    monkeypatch.setattr(N.build_index, "__defaults__", (12,))


def test_hdbscan_equals_definition(spark, small_blocks):
    rng = np.random.default_rng(5)
    data = [sample(g % 4, rng) for g in range(24)]
    params = [(g, int(rng.integers(1, 7)), int(rng.integers(2, 9))) for g in range(24)]
    table = spark.createDataFrame(params, "g int, min_samples int, min_cluster_size int")
    out = H.hdbscan_groups(frame(spark, data), table).toPandas()
    for g, x in enumerate(data):
        got = out[out.g == g].sort_values("id")
        labels, scores = brute.hdbscan(x, *params[g][1:])
        assert list(got.cluster) == list(labels), (g, params[g])
        assert np.abs(got.outlier_score.values - scores).max() < 1e-9


def test_tree_has_minimal_weight_and_levels_agree(spark, small_blocks):
    rng = np.random.default_rng(3)
    data = [rng.normal(size=(150, 3)), rng.normal(size=(90, 8))]
    params = spark.createDataFrame([(0, 4), (1, 6)], "g int, min_samples int")
    tree = H.build_trees(frame(spark, data), params)
    for g, k in ((0, 4), (1, 6)):
        d = brute.pairwise(data[g])
        edges = tree.edges.filter(F.col("g") == g).toPandas()
        assert len(edges) == len(data[g]) - 1
        assert abs(edges.w.sum() - brute.prim_weight(brute.mutual(d, brute.cores(d, k)))) < 1e-9


def test_neighbors_equal_all_pairs(spark, small_blocks):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c * 10, 1, size=(60, 4)) for c in range(4)])
    found = N.knn(N.build_index(frame(spark, [x]), []), 6).toPandas().sort_values("id")
    d = brute.pairwise(x)
    np.fill_diagonal(d, np.inf)
    for i, row in enumerate(found.itertuples()):
        assert list(row.nbr) == list(np.lexsort((np.arange(len(x)), d[i]))[:6])


def test_far_cells_are_not_joined(spark, small_blocks):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c * 1000, 1, size=(60, 3)) for c in range(4)])
    index = N.build_index(frame(spark, [x]), [])
    needed = N.needed_cells(index.blocks, index.meta, lambda p, d, m: N._reach(p, d, m, 3, True))
    assert needed.count() < index.blocks.count() * index.blocks.select("cell").distinct().count() / 2


def test_string_ids_and_single_cluster_and_tiny_input(spark):
    rows = [(f"k{i:03d}", [float(i % 2) * 50 + i * 0.01, 0.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "name string, v array<double>")
    got = {r["name"]: r["cluster"] for r in H.hdbscan(df, "name", "v", 3, 5).collect()}
    labels, _ = brute.hdbscan([r[1] for r in rows], 3, 5)
    assert [got[r[0]] for r in rows] == list(labels)
    one = H.hdbscan(df.limit(1), "name", "v", 3, 5).collect()
    assert [(r["cluster"], r["outlier_score"]) for r in one] == [(-1, 1.0)]


def test_dbcv_equals_definition(spark, small_blocks):
    rng = np.random.default_rng(9)
    data, labels = [], []
    for g in range(8):
        n, dim, k = int(rng.integers(6, 60)), int(rng.integers(1, 5)), int(rng.integers(1, 5))
        x, c = rng.normal(size=(n, dim)), rng.integers(0, k, size=n)
        if g % 3 == 0:
            x = x + c[:, None] * 5
        if g % 4 == 1:
            first = np.flatnonzero(c == 0)
            x[first[: len(first) // 2]] = x[first[0]]
        data.append(x), labels.append(c)
    got = {r["g"]: r["dbcv"] for r in dbcv(frame(spark, data, labels)).collect()}
    for g in range(8):
        assert abs(got[g] - brute.dbcv(data[g], labels[g])) < 1e-9


def test_dbcv_by_hand(spark):
    """Two groups of four on a line: 0 1 2 3 and 10 11 12 13."""
    x = np.array([[0.0], [1.0], [2.0], [3.0], [10.0], [11.0], [12.0], [13.0]])
    labels = [[0, 0, 0, 0, 1, 1, 1, 1]]
    # inner rows 1 and 2 have core 3 / (1 + 1 + 1/2) = 1.2, which their edge weighs; 2 and 11 are 9 apart
    got = dbcv(frame(spark, [x], labels)).first()["dbcv"]
    assert abs(got - (9 - 1.2) / 9) < 1e-12


def test_roots_and_components(spark):
    chain = spark.range(200).select(
        F.lit(0).alias("g"), "id", F.greatest(F.col("id") - 1, F.lit(0)).alias("parent")
    )
    assert roots(chain).filter("root <> 0").count() == 0
    edges = spark.range(199).select(F.lit(0).alias("g"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    parts = components(chain.select("g", "id"), edges.filter("a % 10 <> 9")).groupBy("root").count().collect()
    assert sorted((r["root"], r["count"]) for r in parts) == [(i * 10, 10) for i in range(20)]
