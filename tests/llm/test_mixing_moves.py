from collections import Counter

from pyspark.sql import functions as F

from vecfold.llm import mixing
from vecfold.plans import ordered


def test_mixing_writes_no_texts(spark, docs, monkeypatch):
    """Sums are worked out on rows without texts; the texts meet them in one join."""
    written = []

    def seen(frame, real=ordered.cut):
        written.append(frame.schema.simpleString())
        return real(frame)

    monkeypatch.setattr(mixing, "cut", seen)
    monkeypatch.setattr(ordered, "cut", seen)
    found = mixing.mix(docs.drop("size"))
    assert found.count() == docs.count()
    assert written and not [s for s in written if "text" in s]


def test_mixing_does_not_depend_on_the_layout(spark):
    """Rows of one id and size but other texts get the same copies however they are dealt."""
    rows = spark.range(400).select(
        (F.col("id") % 3).alias("doc_id"), F.concat(F.lit("one two "), F.col("id").cast("string")).alias("text"),
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("s"), (F.col("id") % 4).cast("string"))).alias("source"),
    )
    taken = [
        Counter(tuple(r) for r in mixing.mix(frame).select("row.text", "row.source", "copies").collect())
        for frame in (rows.repartition(5, "text"), rows.orderBy(F.desc("text")).coalesce(1))
    ]
    assert taken[0] == taken[1] and sum(taken[0].values()) == 400
