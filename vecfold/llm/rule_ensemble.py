"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of every text are Spark columns. A small forest is grown on labelled rows, every path
from a root to a node becomes a rule (a conjunction of comparisons), a lasso logistic regression
weighs the rules, and the few rules with a weight are compiled into one Spark column expression.
At most ``MOST_LABELLED`` labelled rows are learned from; every text is scored in whole, without Python.
"""

from __future__ import annotations

import json
import math

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecfold.llm.texts import GAP, whole
from vecfold.plans.lineage import cut

# Labelled rows that a fit learns from, at most: those with the lowest hash of their id.
MOST_LABELLED = 20_000
TREES, DEPTH, LEAST_PER_NODE, SEED = 20, 4, 5, 11
LASSO = 1e-3
ROUNDS = 60

# (feature, is above, threshold); a feature is a position in STATISTICS
Condition = tuple[int, bool, float]
Rule = tuple[Condition, ...]

STATISTICS = (
    "n_words", "mean_word", "distinct_share", "repeat_share", "upper_share", "letter_share", "digit_share",
    "symbol_share", "mark_share", "stop_share", "n_lines", "same_line_share", "words_per_line",
)


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and the statistics of ``text``; all are 0 for a null or empty text."""
    text = F.col("_text")
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    # of frequent characters: whole runs are taken out, so no match per character is kept
    often = lambda runs: F.length(text) - F.length(F.regexp_replace(text, runs, ""))
    per = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    some = F.greatest(F.size("_words") - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice("_words", 1, some).alias("a"), F.slice("_words", 2, some).alias("b"))
    rows = docs.select(*keep, whole().alias("_text")).select(
        *keep,
        F.length(text).alias("_n"),
        F.array_remove(F.split(text, GAP), "").alias("_words"),
        F.array_remove(F.split(text, r"\n+"), "").alias("_lines"),
        often(r"\p{Lu}+").alias("_upper"), often(r"\p{L}+").alias("_letters"), often(r"[0-9]+").alias("_digits"),
        count(r"[#*$%&|<>{}\[\]_=~^\\]").alias("_symbols"), count(r"[!?]").alias("_marks"), count(r"[.,;:]").alias("_stops"),
    )
    words, lines, n = F.size("_words"), F.size("_lines"), F.col("_n")
    return rows.select(
        *keep,
        words.cast("double").alias("n_words"),
        per(n, words).alias("mean_word"),
        per(F.size(F.array_distinct("_words")), words).alias("distinct_share"),
        per(F.size(F.filter(pairs, lambda p: p["a"] == p["b"])), words).alias("repeat_share"),
        per(F.col("_upper"), F.col("_letters")).alias("upper_share"),
        per(F.col("_letters"), n).alias("letter_share"),
        per(F.col("_digits"), n).alias("digit_share"),
        per(F.col("_symbols"), n).alias("symbol_share"),
        per(F.col("_marks"), n).alias("mark_share"),
        per(F.col("_stops"), n).alias("stop_share"),
        lines.cast("double").alias("n_lines"),
        per(lines - F.size(F.array_distinct("_lines")), lines).alias("same_line_share"),
        per(words, lines).alias("words_per_line"),
    )


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """``label`` and the statistics of at most ``most`` labelled documents."""
    usable = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # bounded, so it may be broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return statistics(texts.withColumn("label", F.col("label").cast("double")), "label")


def rules_of(node, path: Rule = ()) -> list[Rule]:
    """The path to every node below the root of one tree of the forest."""
    found = [path] if path else []
    if node.getClass().getSimpleName() == "InternalNode":
        feature, threshold = node.split().featureIndex(), node.split().threshold()
        found += rules_of(node.leftChild(), (*path, (feature, False, threshold)))
        found += rules_of(node.rightChild(), (*path, (feature, True, threshold)))
    return found


def holds(rule: Rule) -> Column:
    test = F.lit(True)
    for feature, above, threshold in rule:
        value = F.col(STATISTICS[feature])
        test = test & (value > threshold if above else value <= threshold)
    return test


class Ensemble:
    """Weighted rules; ``score`` is the chance of label 1."""

    def __init__(self, bias: float, rules: list[tuple[Rule, float]]):
        self.bias, self.rules = bias, rules

    def score(self) -> Column:
        """The score as a column over the columns of ``statistics``."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + F.when(holds(rule), F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def to_json(self) -> str:
        return json.dumps({"bias": self.bias, "rules": self.rules})


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, lasso: float = LASSO) -> Ensemble:
    """Rules learned from ``labels`` (``doc_id, label``); a constant if there are not two classes."""
    rows = cut(training_rows(docs, labels, most)).coalesce(4)
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if ones in (0, n):
        share = min(max(ones / n if n else 0.5, 0.01), 0.99)
        return Ensemble(math.log(share / (1 - share)), [])
    forest = RandomForestClassifier(
        featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=LEAST_PER_NODE,
        subsamplingRate=0.7, featureSubsetStrategy="onethird", seed=SEED,
    ).fit(rows.select("label", array_to_vector(F.array(*STATISTICS)).alias("x")))
    rules = sorted({rule for tree in forest.trees for rule in rules_of(tree._java_obj.rootNode())})
    if not rules:
        return Ensemble(math.log(ones / (n - ones)), [])
    tested = rows.select("label", array_to_vector(F.array(*[holds(r).cast("double") for r in rules])).alias("x"))
    tested = cut(tested).coalesce(4)
    weighed = LogisticRegression(
        featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=lasso, maxIter=ROUNDS, standardization=False
    ).fit(tested)
    weights = weighed.coefficients.toArray().tolist()
    return Ensemble(float(weighed.intercept), [(r, w) for r, w in zip(rules, weights) if w])
