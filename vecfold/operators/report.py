"""Cluster report: representative, size and members per cluster, and the outliers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecfold.functions.vectors import centroids, sqdist
from vecfold.plans.lineage import sized_broadcast
from vecfold.plans.ordered import ordinal

NOISE = -1


def clustered(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Rows that belong to a cluster; a row without a cluster number is noise."""
    return df.filter(F.col(cluster) != NOISE)


def with_centroid(df: DataFrame, by: list[str], v: str) -> DataFrame:
    """Each row next to its group's ``centroid`` and ``size``.

    The centroid table has one row per group; it is broadcast only when its counted size is
    small, otherwise it is shuffled and skewed groups are left to adaptive execution.
    """
    dims = df.select(F.size(v)).first()
    table = sized_broadcast(centroids(df, by, v), 16 + 8 * (dims[0] if dims else 0))
    return df.join(table, by)


def medoids(df: DataFrame, id: str, v: str, by: list[str]) -> DataFrame:
    """Per group: the member nearest to the centroid (lowest id on ties), and the size."""
    rows = with_centroid(df, by, v).withColumn("_d", sqdist(F.col(v), F.col("centroid")))
    return rows.groupBy(*by).agg(
        F.min_by(id, F.struct("_d", id)).alias("representative"), F.count(F.lit(1)).alias("size")
    )


def noise_ratio(df: DataFrame, by: list[str] = (), cluster: str = "cluster") -> DataFrame:
    """Share of rows that are noise; null for no rows."""
    return df.groupBy(*by).agg(
        F.avg((F.col(cluster) == NOISE).cast("int")).alias("noise_ratio"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def relabel(df: DataFrame, id: str, cluster: str = "cluster", by: list[str] = ()) -> DataFrame:
    """Dense cluster numbers by (size descending, lowest id); noise stays -1."""
    by = list(by)
    sizes = clustered(df, cluster).groupBy(*by, cluster).agg(
        (-F.count(F.lit(1))).alias("_neg"), F.min(id).alias("_first")
    )
    ranked = ordinal(sizes, ["_neg", "_first"], within=by, name="_dense").select(*by, cluster, "_dense")
    ranked = sized_broadcast(ranked, 24 + 8 * len(by))
    dense = F.coalesce(F.col("_dense"), F.lit(NOISE)).cast("int")
    return df.join(ranked, [*by, cluster], "left").withColumn(cluster, dense).select(*df.columns)


def membership(df: DataFrame, id: str, cluster: str = "cluster", chunk_rows: int = 1000) -> DataFrame:
    """``(cluster, chunk, members)``: label column to member lists of at most ``chunk_rows``.

    A cluster of any size is a set of bounded lists, so no list has to fit in one task.
    """
    placed = ordinal(df.select(cluster, id), [id], within=[cluster])
    chunk = F.floor(F.col("ordinal") / F.lit(chunk_rows)).alias("chunk")
    return placed.groupBy(cluster, chunk).agg(F.array_sort(F.collect_list(id)).alias("members"))


def labels(members: DataFrame, id: str, cluster: str = "cluster") -> DataFrame:
    """Member lists back to one ``(id, cluster)`` row per member."""
    return members.select(F.explode("members").alias(id), cluster)


@dataclass
class Report:
    clusters: DataFrame  # cluster, representative, size
    members: DataFrame  # cluster, id, one row per member
    outliers: DataFrame  # id and outlier score, when there is one


def cluster_report(df: DataFrame, id: str, v: str, cluster: str = "cluster") -> Report:
    """Every row is a member of a cluster or an outlier; rows without a cluster number are outliers."""
    kept = clustered(df, cluster)
    extra = ["outlier_score"] if "outlier_score" in df.columns else []
    return Report(
        medoids(kept, id, v, [cluster]),
        kept.select(cluster, id),
        df.filter(F.coalesce(F.col(cluster), F.lit(NOISE)) == NOISE).select(id, *extra),
    )


def write_report(report: Report, path: str) -> None:
    """Report sink: three tables under ``path``; members are laid out in cluster order."""
    report.clusters.write.mode("overwrite").parquet(f"{path}/clusters")
    members = report.members
    members.repartitionByRange(*members.columns).sortWithinPartitions(*members.columns).write.mode(
        "overwrite"
    ).parquet(f"{path}/members")
    report.outliers.write.mode("overwrite").parquet(f"{path}/outliers")
