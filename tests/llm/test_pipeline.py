"""The corpus pipeline, stage by stage, on a small table."""

import re

import pytest

import corpus_pipeline
from vecfold.llm import queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    clean = spark.range(100, 160).selectExpr(
        "id AS doc_id", "concat('a calm letter about topic', id, ' and garden', id * 7, ' with music', id * 13) AS text",
        "'en' AS lang", "concat('src', id % 3) AS source", "60L AS n_chars")
    toxic = spark.range(200, 230).selectExpr(
        "id AS doc_id", "concat('you vile pest', ' number', id, ' of street', id * 3) AS text",
        "'en' AS lang", "'src1' AS source", "30L AS n_chars")
    docs.select(*COLUMNS).unionByName(clean).unionByName(toxic).write.parquet(f"{path}/documents.parquet")
    spark.range(100, 230).filter("id < 160 OR id >= 200").selectExpr(
        "id AS doc_id", "1 AS quality", "cast(id >= 200 AS int) AS toxic").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = queries.table(spark, folder, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, folder).cache()
        seen[name] = docs
        if name != "packing":
            assert docs.columns == COLUMNS
    safe = {r.doc_id for r in seen["toxicity"].collect()}
    assert not safe & set(range(200, 230)) and safe >= set(range(100, 160))
    single = [r.doc_id for r in seen["near-duplicates"].collect()]
    assert 0 in single and 1 not in single and single.count(11) <= 1
    for r in seen["secrets"].collect():
        assert not re.search("hunter2|AKIA", r.text or "") and (r.text is None or r.n_chars == len(r.text))
    assert sorted(map(str, single)) == sorted(str(r.doc_id) for r in seen["secrets"].collect())
    assert {r.doc_id for r in seen["mixing"].collect()} <= set(single)
    assert {r.doc_id for r in seen["packing"].collect()} == {r.doc_id for r in seen["mixing"].collect()}
    for frame in seen.values():
        frame.unpersist()


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_on_hard_cases(spark, folder, name):
    if name == "op6_topk":
        spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.25])], "vec_id long, embedding array<float>").write.mode(
            "overwrite").parquet(f"{folder}/embeddings.parquet")
        assert queries.QUERIES[name](spark, folder).count() == 1
    else:
        assert queries.QUERIES[name](spark, folder).count() >= 104
