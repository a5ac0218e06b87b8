"""Cutting lineage with written tables in the cluster's shared folder.

Iterative operators write each round to a table and read it back. Unlike executor-local
checkpoints the written rounds survive the loss of any executor, and the plan of the next
round starts from a plain Parquet scan.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder set in ``spark.checkpoint.dir``; where it is unset, one in the warehouse.

    A warehouse on a local disk is not shared by the executors of a cluster, so it is refused there.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", "") or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not sc.master.startswith("local") and (":" not in warehouse or warehouse.startswith("file:")):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return f"{warehouse}/_vecfold"


def scratch_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/vecfold/{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete the tables this application has cut; frames that still read them become unusable."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_counted(df: DataFrame, **metrics) -> tuple[DataFrame, dict]:
    """``cut`` that also returns aggregates observed by the same job (``n`` = row count)."""
    seen = Observation(uuid.uuid4().hex)
    exprs = [F.count(F.lit(1)).alias("n")] + [m.alias(k) for k, m in metrics.items()]
    out = cut(df.observe(seen, *exprs))
    return out, seen.get


# A side is broadcast only when its measured size stays below this many bytes.
BROADCAST_LIMIT = 32 << 20


def sized_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Cut ``df``, count it, and hint a broadcast only if it is provably small."""
    out, seen = cut_counted(df)
    return F.broadcast(out) if seen["n"] * row_bytes <= limit else out


def bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Write ``df`` once as a table bucketed and sorted by ``keys`` in the shared folder; return its scan.

    Two tables bucketed alike on the same keys join bucket by bucket, without an exchange, so a large
    side written once (vectors, say) can meet a small side written each round without moving.
    """
    spark = df.sparkSession
    name = f"vecfold_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{scratch_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)
