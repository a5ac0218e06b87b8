"""Mixing sources to target weights by systematic sampling.

Every document expects ``target / source size`` copies. The expected copies are added up within
the source and one random offset is added; a document is emitted once for each integer that its
stretch of that line crosses. Of a few random offsets per source, the one that comes nearest to
the target is used. Documents are taken in order of size, so the copies are spread over
all sizes and a source misses its target by about one document.

Running sums come from range-partitioned prefix sums over one small row per document, so a source
that holds most of the rows is spread over many tasks. Texts move once, when they meet their sums.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecfold.llm.texts import WORD, whole
from vecfold.plans.lineage import cut
from vecfold.plans.ordered import prefix, ranges

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
# Expected copies are whole multiples of this part, so sums are exact in any order.
PART_BITS = 24
PARTS = 1 << PART_BITS
OFFSET_STEP, OFFSET_SEED, OFFSET_TRY = 2654435761, 97, 10368889
# Random offsets per source; the one that leaves the source nearest to its target is used.
OFFSETS = 32


def n_words(text: str = "text") -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def weight_of(position: Column, weights: tuple[int, ...] = WEIGHTS) -> Column:
    """The weights in turn, by the 0-based position of a source."""
    return F.element_at(F.array(*[F.lit(w) for w in weights]), (position % len(weights) + 1).cast("int")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``source, s, source_size, target`` from ``source, source_size``, one row per source.

    All sizes are shared out by weight; a target stops at ``most`` times its source, and what is
    left over goes to the others by weight. In order of the level at which sources stop, the
    final level is the first one that the next source does not stop at.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    placed = sizes.withColumn("s", (F.row_number().over(order) - 1).cast("long")).withColumn("w", weight_of(F.col("s"), weights))
    full = placed.withColumn("top", F.col("source_size") * most)
    by_level = Window.orderBy(F.col("top") / F.col("w"), "s")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    rest = (F.sum("source_size").over(everything) - F.coalesce(F.sum("top").over(before), F.lit(0))).cast("double")
    weight = (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))).cast("double")
    levels = full.withColumn("level", rest / weight)
    stays = F.when(F.col("level") <= F.col("top") / F.col("w"), F.col("level"))
    # levels grow until the right number of sources is taken out and fall from there on
    levels = levels.withColumn("final", F.max(stays).over(everything))
    target = F.least(F.col("top").cast("double"), F.col("final") * F.col("w"))
    return levels.select("source", "s", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = OFFSET_SEED
) -> DataFrame:
    """``row, size, source_size, target, copies`` for every row of ``docs`` (in the struct ``row``).

    Needs ``doc_id, text, source``, and takes ``size`` instead of ``text`` if ``docs`` has no text.
    Null texts and texts without words have size 0; a null source is a source of its own, the
    last; a source of size 0 has target 0 and no copies. Repeated rows are taken one by one.
    """
    size = n_words() if "text" in docs.columns else F.col("size")
    # rows of one place are equal, so it does not matter which of them gets which copies
    place = ["size", "id", "hash"]
    rows = docs.select(
        F.struct("*").alias("row"), F.col("source").alias("source"), size.alias("size"), F.col("doc_id").alias("id"),
        F.xxhash64(*docs.columns).alias("hash"),
    )
    # sums, ranges and offsets are worked out without the rows; those move once, to their place
    places = cut(rows.groupBy("source", *place).agg(F.count(F.lit(1)).alias("n")))
    sizes = cut(places.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    aims = targets(sizes, weights, most)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aims = cut(aims.withColumn("e", F.floor(share * PARTS + 0.5).cast("long")))
    joined = places.join(aims.withColumnRenamed("source", "of"), places["source"].eqNullSafe(F.col("of")))
    joined = joined.select("s", *place, "n", "source", "source_size", "target", "e", (F.col("n") * F.col("e")).alias("line"))
    summed = prefix(ranges(joined, ["s", *place]), place, ["s"], upto=("sum", "line"))
    start = (F.col("s") + 1) * OFFSET_STEP + seed
    offset = lambda k: (start + k * OFFSET_TRY) % PARTS
    crossed = lambda upto, line, at: F.shiftright(upto + at, PART_BITS) - F.shiftright(upto - line + at, PART_BITS)
    taken = lambda k: crossed(F.col("upto"), F.col("line"), offset(k)) * F.col("size")
    totals = summed.groupBy("s").agg(
        F.array(*[F.struct(F.abs(F.sum(taken(k)) - F.first("target")).alias("off"), F.lit(k).alias("k")) for k in range(OFFSETS)]).alias("tried")
    )
    best = cut(totals.select(F.col("s").alias("of"), F.array_min("tried")["k"].alias("k")))
    lines = summed.join(best, F.col("s") == F.col("of")).select(
        F.struct("source", *place).alias("key"), "source_size", "target", "n", "e", F.col("upto").alias("end"), offset(F.col("k")).alias("at")
    )
    found = rows.select("row", "size", F.struct("source", *place).alias("key")).join(lines.hint("merge"), "key")
    number = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    upto = F.col("end") - (F.col("n") - number) * F.col("e")
    return found.select("row", "size", "source_size", "target", crossed(upto, F.col("e"), F.col("at")).alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it."""
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy")
    return mix(docs, **options).filter("copies > 0").select("row", copies).select("row.*")
