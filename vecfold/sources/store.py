"""Vector tables: one vector per key, fixed dimension, partitioned by mode and model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def create_if_missing(
    spark: SparkSession, table: str, dim: int, key: str = "filename", location: str | None = None
) -> None:
    """Create the vector table unless it exists; an existing one must have the same dimension."""
    where = f"LOCATION '{location}' " if location else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} "
        f"({key} STRING, embedding ARRAY<FLOAT>, embed_mode STRING, model STRING) "
        f"USING parquet PARTITIONED BY (embed_mode, model) {where}TBLPROPERTIES ('vector.dim' = '{dim}')"
    )
    stored = table_dim(spark, table)
    if stored != dim:
        raise ValueError(f"table {table} holds vectors of size {stored}, not {dim}")


def table_dim(spark: SparkSession, table: str) -> int:
    row = spark.sql(f"SHOW TBLPROPERTIES {table} ('vector.dim')").first()
    return int(row["value"])


def checked(v: Column, dim: int) -> Column:
    """``v``, raising when its size is not ``dim``; part of the value, so it is never pruned."""
    bad = F.concat(
        F.lit(f"vector size mismatch: expected {dim}, got "), F.coalesce(F.size(v).cast("string"), F.lit("null"))
    )
    return F.when(F.size(v) == dim, v).otherwise(F.raise_error(bad).cast("array<float>"))


def load_vectors(source: DataFrame, dim: int, key: str = "filename", v: str = "embedding") -> DataFrame:
    """Key and vector of a stored table, dimension-checked."""
    return source.select(key, checked(F.col(v), dim).alias(v))


def existing_keys(candidates: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Candidates whose key is already stored."""
    return candidates.join(store.select(key), key, "left_semi")


def new_keys(candidates: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Candidates whose key is not stored yet."""
    return candidates.join(store.select(key), key, "left_anti")


def first_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by ``order``; rows without an order come last.

    A ``min_by`` aggregate combines on the map side, so a key that holds most rows reaches the
    shuffle as one row per task instead of being sorted in a window.
    """
    rest = [c for c in rows.columns if c != key]
    packed = F.struct(*rest)
    return (
        rows.groupBy(key)
        .agg(F.min_by(packed, F.struct(F.col(order).isNull(), F.col(order))).alias("_row"))
        .select(key, *[F.col("_row")[c].alias(c) for c in rest])
    )


def upsert_ignore(new: DataFrame, store: DataFrame, key: str, order: str) -> DataFrame:
    """Rows to append for insert-or-ignore: stored rows win, then the first of the batch."""
    return new_keys(first_per_key(new, key, order), store, key)


def append(rows: DataFrame, table: str, mode: str, model: str) -> None:
    """Append ``(key, embedding)`` rows to the partition of one mode and model."""
    rows.withColumn("embed_mode", F.lit(mode)).withColumn("model", F.lit(model)).write.insertInto(table)
