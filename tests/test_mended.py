"""Cases that were once answered wrongly: ties, bad vectors, nulls, negative cluster numbers."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from vecfold.functions.embedders import CharFold
from vecfold.operators.graph import spanning_tree
from vecfold.operators.ingest import ingest
from vecfold.operators.neighbors import build_index
from vecfold.operators.repeats import corpus_repeats
from vecfold.operators.report import cluster_report
from vecfold.operators.validity import cluster_blocks, davies_bouldin, dunn, silhouette
from vecfold.plans.lineage import shared_dir
from vecfold.sources.store import first_per_key


def grid(spark):
    rows = [(g, i, [float(i % 4), float(i // 4 % 4)]) for g in range(2) for i in range(24)]
    return spark.createDataFrame(rows, "g int, id long, v array<double>")


def test_the_tree_does_not_depend_on_blocks(spark):
    points = grid(spark)
    cores = points.select("g", "id", F.lit(0.0).alias("core"))
    trees = [
        {tuple(r) for r in spanning_tree(build_index(points, [], **size), cores).select("g", "a", "b", "w").collect()}
        for size in ({}, {"block_rows": 7})
    ]
    assert trees[0] == trees[1] and len(trees[0]) == 46


@pytest.mark.parametrize("vectors", [[[1.0, 2.0, 3.0], [1.0]], [[1.0, None], [1.0, 2.0]], [None, [1.0, 2.0]]])
def test_bad_vectors_are_refused(spark, vectors):
    rows = spark.createDataFrame([(0, i, v) for i, v in enumerate(vectors)], "g int, id long, v array<double>")
    with pytest.raises(Exception, match="one size"):
        build_index(rows, []).blocks.collect()


def test_first_row_without_order(spark):
    rows = spark.createDataFrame([("a", None, 5), ("b", None, 1), ("b", 2, 7)], "k string, o int, x int")
    assert {tuple(r) for r in first_per_key(rows, "k", "o").select("k", "o", "x").collect()} == {("a", None, 5), ("b", 2, 7)}


def test_rows_without_cluster_are_outliers(spark):
    rows = [(i, [float(i), 0.0], c) for i, c in enumerate([0, 0, 1, -1, None, None])]
    report = cluster_report(spark.createDataFrame(rows, "id long, v array<double>, cluster int"), "id", "v")
    assert sorted(r.id for r in report.outliers.collect()) == [3, 4, 5] and report.members.count() == 3


def test_ingest_names_its_order(spark):
    rows = spark.createDataFrame([("a", "x")], "filename string, content string")
    with pytest.raises(ValueError, match="order"):
        ingest(rows, "unordered", CharFold(), "ollama", "m")


def test_silhouette_takes_any_cluster_number(spark):
    rows = [(i, [float(i % 2) * 10 + i / 10, 1.0], i % 2) for i in range(12)]
    frame = spark.createDataFrame([(0, *r) for r in rows], "g int, id long, v array<double>, cluster long")
    plain, shifted = (
        silhouette(cluster_blocks(frame.withColumn("cluster", F.col("cluster") - by))).first()["silhouette"] for by in (0, 5)
    )
    assert 0.5 < plain < 1 and plain == pytest.approx(shifted)


def test_scores_do_not_change_with_a_shift(spark):
    rows = [(i, [float(i % 2) * 10 + i / 8, i / 4], i % 2) for i in range(40)]
    scores = []
    for by in (0.0, 1e8):
        moved = [(0, i, [x + by for x in v], c) for i, v, c in rows]
        frame = spark.createDataFrame(moved, "g int, id long, v array<double>, cluster long")
        found = (dunn(frame), davies_bouldin(frame), silhouette(cluster_blocks(frame)))
        scores.append([f.first()[1] for f in found])
    assert scores[0] == pytest.approx(scores[1], rel=1e-6) and min(scores[0]) > 0


def test_corpus_repeats(spark):
    texts = ["abracadabra", "cadabra abra", "", None, "abra"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    freq, docs, after = Counter(), Counter(), {}
    for t in texts:
        pieces = [(t[p : p + n], t[p + n : p + n + 1]) for p in range(len(t or "")) for n in (2, 3, 4) if p + n <= len(t)]
        freq.update(w for w, _ in pieces)
        docs.update({w for w, _ in pieces})
        for w, x in pieces:
            after.setdefault(w, set()).add(x)
    expected = {(w, n, docs[w]) for w, n in freq.items() if docs[w] > 1 and len(after[w]) > 1}
    assert {tuple(r) for r in corpus_repeats(frame, "id", "text", 2, 4).collect()} == expected


def test_scratch_is_in_a_shared_folder(spark):
    found = shared_dir(spark)
    assert found.startswith(spark.conf.get("spark.sql.warehouse.dir").rstrip("/")) or found == spark.conf.get("spark.checkpoint.dir", "")
