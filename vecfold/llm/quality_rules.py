"""Quality rules: repetition and length, then a likelihood ratio of hashed n-grams.

Words and word pairs are hashed into buckets. One multinomial over the buckets is counted on
trusted texts, one on the whole corpus; a text scores the mean of log(trusted / corpus) over its
n-grams and is kept if that reaches a fixed threshold, so the verdict on a text depends on nothing
but the text and the two tables. Only DataFrame functions are used; the two tables
have a fixed number of buckets, so they travel as one constant.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecfold.llm.texts import GAP, whole

BUCKETS = 10_000
# Low bits of a packed window that hold its place in the text.
PLACE_BITS = 29
SYMBOLS = "[#*$%&|<>]"
BLANKS = " \t\n\x0b\x0c\r"
# A text is kept when its mean log ratio is at least this. Ordinary text sits near 0; text made of
# n-grams that trusted texts hardly have falls far below.
LEAST_MEAN_RATIO = -0.12
SMOOTHING = 1.0
FEWEST_WORDS = 50
MOST_REPEATED_PERCENT = 50


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, also where lambdas in ``body`` use it again."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def word_pairs(words: Column) -> Column:
    """Structs of each word and the next one (null after the last); ``inline`` makes rows of them."""
    return F.arrays_zip(words.alias("w"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("v"))


def gram_buckets(buckets: int) -> tuple[Column, Column]:
    """Buckets of the lower-cased word ``w`` and of the pair ``w, v``; the pair's is null after the last word."""
    bucket = lambda *grams: F.pmod(F.xxhash64(*grams), F.lit(buckets)).cast("int")
    w, v = F.lower("w"), F.lower("v")
    return bucket(w), F.when(F.col("v").isNotNull(), bucket(w, v))


def bucket_counts(texts: DataFrame, trusted: Column, buckets: int = BUCKETS) -> list[tuple[int, int]]:
    """Per bucket the n-grams of all texts and of the trusted ones, combined before the shuffle."""
    rows = texts.select(trusted.alias("t"), words(whole()).alias("words")).select("t", F.inline(word_pairs(F.col("words"))).alias("w", "v"))
    grams = rows.select("t", F.stack(F.lit(2), *gram_buckets(buckets)).alias("b")).filter("b IS NOT NULL")
    found = grams.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.count_if("t").alias("m")).collect()
    counts = [(0, 0)] * buckets
    for row in found:  # one row per bucket
        counts[row.b] = (row.n, row.m)
    return counts


def log_ratios(counts: list[tuple[int, int]], smoothing: float = SMOOTHING) -> list[int]:
    """log(trusted share / corpus share) of each bucket in millionths; all 0 without trusted n-grams."""
    corpus, trusted = (sum(c[i] for c in counts) for i in (0, 1))
    if not trusted:
        return [0] * len(counts)
    more = smoothing * len(counts)
    return [
        round(1e6 * (math.log((m + smoothing) / (trusted + more)) - math.log((n + smoothing) / (corpus + more))))
        for n, m in counts
    ]


def repeated_words(rows: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words`` to rows with ``words``: those in 3-word windows that the text has twice or more.

    Hashes of the windows, with the place in the low bits, are sorted; neighbours with equal hash
    name the candidates. Candidates are compared as words, and the places left, sorted, cover
    three words each, less what the next one covers again.
    """
    n = F.size("words")
    shifted = lambda k: F.slice("words", k + 1, F.greatest(n - 2, F.lit(0)))
    windows = F.arrays_zip(shifted(0).alias("a"), shifted(1).alias("b"), shifted(2).alias("c"))
    packed = F.transform(windows, lambda x, i: F.shiftleft(F.xxhash64(x), PLACE_BITS).bitwiseOR(i.cast("long")))
    rows = rows.withColumn("packed", F.sort_array(packed))
    some = F.greatest(F.size("packed") - 1, F.lit(0))
    next_to = F.arrays_zip(F.slice("packed", 1, some).alias("a"), F.slice("packed", 2, some).alias("b"))
    hash_of = lambda x: F.shiftright(x, PLACE_BITS)
    rows = rows.withColumn("hits", F.filter(next_to, lambda x: hash_of(x["a"].bitwiseXOR(x["b"])) == 0)).drop("packed")
    at = lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    places = F.array_union(F.transform("hits", lambda x: at(x["a"])), F.transform("hits", lambda x: at(x["b"])))
    rows = rows.withColumn("places", places).drop("hits")

    def compared(w: Column) -> Column:
        window = lambda i: F.struct(F.concat_ws(" ", w[i], w[i + 1], w[i + 2]).alias("w"), i.alias("i"))
        return F.sort_array(F.transform("places", window))

    def marked(windows: Column) -> Column:
        same = lambda x, k: F.coalesce(x["w"] == F.get(windows, k)["w"], F.lit(False))
        hits = F.filter(windows, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return F.sort_array(F.transform(hits, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        step = F.transform(at, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3))))
        return F.aggregate(step, F.lit(0).cast("long"), lambda total, x: total + x)

    exact = let(let(let(F.col("words"), compared), marked), covered)
    none = F.lit(0).cast("long")
    return rows.withColumn("n_repeat_words", F.when(F.size("places") > 0, exact).otherwise(none)).drop("places")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(docs: DataFrame, ratios: list[int], least: float = LEAST_MEAN_RATIO) -> DataFrame:
    """``doc_id``, the columns of ``BASE``, ``mean_ratio, base_failed, kept``.

    A null text counts as empty: no words, no ratio, failed. A very long text costs the time of one
    sort. Repeated rows are judged one by one; an empty table gives an empty result.
    """
    text = F.col("text")
    rows = docs.select("doc_id", whole().alias("text")).select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        F.length(F.concat_ws("", words(text))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        duplicate_lines(text).alias("n_dup_lines"),
        words(text).alias("words"),
    )
    rows = repeated_words(rows.withColumn("n_words", F.size("words").cast("long")))
    keys = ["row", "doc_id", *BASE]
    pairs = rows.select(*keys, F.inline_outer(word_pairs(F.col("words"))).alias("w", "v"))
    table = F.from_json(F.lit(json.dumps(ratios)), "array<long>")
    one, two = gram_buckets(len(ratios))
    ratio = F.when(F.col("w").isNotNull(), F.get(table, one) + F.coalesce(F.get(table, two), F.lit(0)))
    # the rows of a document are in one task, so one row per document is shuffled
    found = pairs.groupBy(*keys).agg(F.sum(ratio).alias("sum"))
    n = F.col("n_words")
    mean = F.col("sum") / (1e6 * (2 * n - 1))
    failed = (n < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * n)
    found = found.select("doc_id", *BASE, mean.alias("mean_ratio"), failed.alias("base_failed"))
    return found.withColumn("kept", ~F.col("base_failed") & (F.coalesce("mean_ratio", F.lit(0.0)) >= least))


def fit_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Log ratios of the documents whose ids are in ``trusted`` against all documents."""
    ids = trusted.select(F.col("doc_id").alias("_trusted")).distinct()
    # one plan at every size: texts are dealt by id once, ids are hashed per partition
    marked = docs.select("doc_id", "text").join(ids.hint("shuffle_hash"), F.col("doc_id") == F.col("_trusted"), "left")
    return log_ratios(bucket_counts(marked, F.col("_trusted").isNotNull(), buckets))
