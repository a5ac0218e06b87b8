"""Positions in a total order without pulling a group into one task.

``row_number().over(partitionBy(hot key))`` sorts the whole group in one task. Here rows are
range partitioned by (group, order), numbered inside each range, and shifted by the counts of
the ranges before it, so a group that holds most rows is spread over many ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecfold.plans.lineage import cut


def ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows cut into key ranges, with the range number in ``_range``.

    The table is written before it is used twice, because the sampled range bounds may differ
    between two runs of the same plan.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))


def ordinal(df: DataFrame, order: list[str], within: list[str] = (), name: str = "ordinal") -> DataFrame:
    """Adds the 0-based position by ``order`` inside each ``within`` group.

    ``order`` has to be unique inside a group, so that hot values still split into ranges.
    """
    within = list(within)
    keys = ["_range", *within]
    parts = ranges(df, within + list(order))
    before = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    before = before.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        # one row per (range, group): a group never has more rows here than there are ranges
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    numbered = parts.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    )
    return numbered.join(offsets, keys).select(
        *df.columns, (F.col("_before") + F.col("_rn") - 1).cast("long").alias(name)
    )


_COMBINE = {
    "sum": (F.sum, lambda before, here: F.coalesce(before, F.lit(0)) + here),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
}


def prefix(parts: DataFrame, order: list[str], within: list[str], **aggs: tuple[str, str]) -> DataFrame:
    """Inclusive running aggregates inside each ``within`` group of a table from ``ranges``.

    ``aggs`` maps an output name to ``(kind, column)`` with kind sum, max or min. Values run
    inside a range first; what came before it is one small row per (range, group).
    """
    keys = ["_range", *within]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*(within or [F.lit(0)])).orderBy("_range")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(*keys).agg(*[_COMBINE[k][0](c).alias(f"_t_{n}") for n, (k, c) in aggs.items()])
    carried = totals.select(
        *keys, *[_COMBINE[k][0](f"_t_{n}").over(before).alias(f"_b_{n}") for n, (k, _) in aggs.items()]
    )
    out = parts.select("*", *[_COMBINE[k][0](c).over(inside).alias(f"_h_{n}") for n, (k, c) in aggs.items()])
    out = out.join(carried, keys)
    return out.select(
        *parts.columns,
        *[_COMBINE[k][1](F.col(f"_b_{n}"), F.col(f"_h_{n}")).alias(n) for n, (k, _) in aggs.items()],
    )
