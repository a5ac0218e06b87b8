from pyspark.sql import functions as F

from vecfold.llm import near_copies, simhash


def test_fingerprints_and_sets_come_from_one_function(spark, docs, monkeypatch):
    """Two functions in one stage are two Python workers per core, which Spark keeps for all later stages."""
    written = []

    def seen(frame, real=near_copies.cut):
        written.append((frame._jdf.queryExecution().executedPlan().toString(), real(frame)))
        return written[-1][1]

    monkeypatch.setattr(near_copies, "cut", seen)
    near_copies.one_per_group(docs).count()
    plan, signed = written[0]
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
    texts = docs.select(F.xxhash64(simhash.whole()).alias("tag"), simhash.simhash().alias("fp")).distinct().collect()
    assert {(r.tag, r.fp) for r in signed.collect()} == {(r.tag, r.fp) for r in texts}
