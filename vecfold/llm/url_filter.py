"""URL filters: prefix rules first, then logistic regression on hashed character n-grams of host and path.

Only DataFrame functions run here, no Python worker. A url's host is what follows the first ``://`` up
to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; its path follows up to ``?``, ``#`` or the end.
A null url or one without ``://`` has an empty host and path.

A rule ``host/path`` fits a url whose host is the rule's host or ends with ``.`` and it, and whose path
starts with the rule's path; of the rules that fit, the longest decides (equal length: the one listed
first). Where no rule fits, the model decides.

The model: every host is padded as ``^host$`` and every path as ``^path$``; their character n-grams
(``NGRAMS``) are hashed into ``BUCKETS`` features, host and path apart, each n-gram weighing one over the root of
the url's number of n-grams. Weights are fitted by full-batch gradient descent with momentum on the mean log loss plus an L2 term, one
Spark job a step: a step joins the examples' features with the weights (a broadcast of at most
``BUCKETS + 1`` rows, bounded by construction), sums margins per url without a shuffle (examples are
dealt by url once), and sums gradients per feature in the one shuffle of the step.
The labelled table is small: the query trains on at most ``MOST_LABELLED`` rows, a documented bound.

Defined results: a null or empty url gets empty host and path, and is judged by the rules (none fit) and
then by the model from its padding n-grams alone. Repeated rows are judged alike; ties of the model
(probability exactly 0.5) allow. An empty labelled table gives zero weights, so every url the rules
leave is allowed. Extra columns of the input are kept and may clash with none of the output names,
which are added last and replace columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecfold.plans.lineage import cut

# Fixed values of the contract: the rules, in the order given.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

NGRAMS = (3, 4, 5)
BUCKETS = 1 << 16
STEPS, RATE, MOMENTUM, L2 = 20, 4.0, 0.8, 1e-4
MOST_LABELLED = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_fits(rule: str, h: Column, p: Column) -> Column:
    cut_at = rule.find("/")
    rule_host, rule_path = (rule, "") if cut_at < 0 else (rule[:cut_at], rule[cut_at:])
    on_host = (h == F.lit(rule_host)) | h.endswith("." + rule_host)
    return on_host & p.startswith(rule_path)


def rule_of(h: Column, p: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, nulls where none fits."""
    ordered = sorted(enumerate(rules), key=lambda x: (-len(x[1][1]), x[0]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for _, (v, r) in reversed(ordered):
        fits = rule_fits(r, h, p)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def grams(text: Column, side: str) -> Column:
    """Hashed n-grams of ``^text$`` as feature numbers, ``side`` keeping host and path apart."""
    padded = F.concat(F.lit("^"), text, F.lit("$"))
    out = []
    for n in NGRAMS:
        starts = F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1)))
        out.append(F.transform(starts, lambda i: F.substring(padded, i, n)))
    every = F.flatten(F.array(*out))
    return F.transform(every, lambda g: F.pmod(F.xxhash64(F.lit(side), g), F.lit(BUCKETS)))


def features(h: Column, p: Column) -> Column:
    """Feature numbers of a url's n-grams, repeats included; each weighs 1 / sqrt(their number).

    ``h`` and ``p`` should be plain columns: a lambda re-evaluates what it refers to for every element.
    """
    return F.concat(grams(h, "h"), grams(p, "p"))


def exploded(df: DataFrame, keep: list[str]) -> DataFrame:
    """Rows (keep..., f, x) of the n-grams of ``host`` and ``path``, and the bias (f = -1, x = 1)."""
    listed = df.select(*keep, features(F.col("host"), F.col("path")).alias("_fs"))
    parts = listed.select(*keep, F.explode("_fs").alias("f"), (1 / F.sqrt(F.size("_fs").cast("double"))).alias("x"))
    return parts.unionByName(df.select(*keep, F.lit(-1).cast("long").alias("f"), F.lit(1.0).alias("x")))


@dataclass
class Model:
    weights: DataFrame  # f long, w double (and more); f = -1 is the bias

    def score(self, df: DataFrame, h: str = "host", p: str = "path") -> DataFrame:
        """Adds ``_p``, the probability of block, to ``df`` (which needs a unique ``_row``).

        The n-grams of a row are summed in the task that made them, so one row a url is shuffled for the join back.
        """
        parts = exploded(df, ["_row"])
        margin = parts.join(F.broadcast(self.weights.select("f", "w")), "f").groupBy("_row").agg(F.sum(F.col("w") * F.col("x")).alias("_m"))
        return df.join(margin, "_row", "left").withColumn("_p", 1 / (1 + F.exp(-F.coalesce(F.col("_m"), F.lit(0.0))))).drop("_m")


def fit(labelled: DataFrame, url: str = "url", label: str = "label", steps: int = STEPS) -> Model:
    """Gradient descent on hashed n-grams of ``labelled`` (label 1 = block); null labels are left out."""
    spark = labelled.sparkSession
    rows = labelled.filter(F.col(label).isNotNull()).select(
        F.monotonically_increasing_id().alias("_row"), F.col(label).cast("double").alias("y"), F.col(url).alias("_url")
    )
    rows = cut(rows.select("_row", "y", host(F.col("_url")).alias("host"), path(F.col("_url")).alias("path")))
    examples = cut(exploded(rows, ["_row", "y"]))
    n = max(1, examples.filter("f = -1").count())
    # Dealt by url once and kept: each step sums margins and joins errors without a shuffle. A lost block is
    # read again from the written examples.
    examples = examples.repartition(max(1, n // 20_000 + 1), "_row").cache()
    weights = spark.createDataFrame([(-1, 0.0, 0.0)], "f long, w double, v double")
    for _ in range(steps):
        # every feature of the weights occurs in the examples, so a step is one aggregation by feature
        joined = examples.join(F.broadcast(weights), "f", "left")
        margin = joined.groupBy("_row", "y").agg(F.sum(F.coalesce(F.col("w"), F.lit(0.0)) * F.col("x")).alias("m"))
        error = margin.select("_row", (1 / (1 + F.exp(-F.col("m"))) - F.col("y")).alias("err"))
        grad = joined.join(error, "_row").groupBy("f").agg(
            (F.sum(F.col("err") * F.col("x")) / n).alias("g"),
            F.coalesce(F.first("w", ignorenulls=True), F.lit(0.0)).alias("w"),
            F.coalesce(F.first("v", ignorenulls=True), F.lit(0.0)).alias("v"),
        )
        v = MOMENTUM * F.col("v") - RATE * (F.col("g") + L2 * F.col("w"))
        # at most BUCKETS + 1 rows: one file
        weights = cut(grad.select("f", (F.col("w") + v).alias("w"), v.alias("v")).coalesce(1))
    examples.unpersist()
    return Model(weights)


def judge(pages: DataFrame, model: Model, url: str = "url", rules=RULES) -> DataFrame:
    """Every row of ``pages`` with host, path, rule (null where none fits), block probability and verdict."""
    h, p = host(F.col(url)), path(F.col(url))
    out = pages.withColumn("host", h).withColumn("path", p)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = out.withColumn("rule", rule).withColumn("_rule_verdict", verdict).withColumn("_row", F.monotonically_increasing_id())
    out = model.score(cut(out))
    model_verdict = F.when(F.col("_p") > 0.5, F.lit("block")).otherwise(F.lit("allow"))
    out = out.withColumn("verdict", F.coalesce(F.col("_rule_verdict"), model_verdict)).withColumnRenamed("_p", "block_probability")
    return out.drop("_row", "_rule_verdict")


def rule_labelled(pages: DataFrame, url: str = "url", most: int = MOST_LABELLED, rules=RULES) -> DataFrame:
    """A small labelled table: up to ``most`` urls that a rule decides (label 1 = block), chosen by hash."""
    h, p = host(F.col(url)), path(F.col(url))
    _, verdict = rule_of(h, p, rules)
    decided = pages.select(F.col(url).alias("url"), verdict.alias("v")).filter(F.col("v").isNotNull())
    decided = decided.select("url", (F.col("v") == "block").cast("int").alias("label"))
    return decided.orderBy(F.xxhash64("url", "label"), "url", "label").limit(most)
