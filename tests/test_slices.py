"""Distance kernels in strips, and partners of a tile in slices."""

import tracemalloc

import numpy as np
import pytest

from vecfold.operators import dbcv, graph, neighbors


def part(rng, n, first):
    x = rng.normal(size=(n, 8))
    return {"x": x, "id": np.arange(first, first + n), "core": np.full(n, 0.1), "comp": np.arange(first, first + n),
            "limit": np.full(n, np.inf), "floor": np.zeros(n), "mult": np.ones(n, "i8"), "members": np.full(n, 2 * n)}


@pytest.mark.parametrize("kernel", [lambda p: neighbors._Nearest(p, 5, True), graph._Foreign, dbcv._PowerMean])
def test_a_kernel_holds_a_few_strips(kernel):
    rng = np.random.default_rng(3)
    own, other = part(rng, 2048, 0), part(rng, 2048, 5000)
    state = kernel(own)
    tracemalloc.start()
    state.feed(other, 0.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
    kept = state.finish()
    assert len(kept["id"]) == 2048


def frame(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(400, 3)), 1)
    x[350:] = x[:50]
    return spark.createDataFrame([(0, i, [float(c) for c in r]) for i, r in enumerate(x)], "g int, id long, v array<double>"), x


def test_sliced_lists_and_trees_are_the_same(spark, monkeypatch):
    points, x = frame(spark)
    index = neighbors.build_index(points, [], 32)
    plain = {r["id"]: (r["nbr"], r["dist"]) for r in neighbors.knn(index, 6).collect()}
    cores = points.selectExpr("g", "id", "0.2D AS core")
    tree = {tuple(r) for r in graph.spanning_tree(index, cores).collect()}
    monkeypatch.setattr(neighbors, "TASK_PAIRS", 9)
    assert neighbors.slices_of(index.blocks) > 3
    assert {r["id"]: (r["nbr"], r["dist"]) for r in neighbors.knn(index, 6).collect()} == plain
    assert {tuple(r) for r in graph.spanning_tree(index, cores).collect()} == tree
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert all(np.allclose(np.sort(d[i])[:6], plain[i][1]) for i in range(400))
