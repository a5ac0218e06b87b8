"""Incremental ingest: embed only keys that are not stored, commit in slices, resume freely."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecfold.operators.embed import DEFAULT_BATCH, Remote, embed, embed_remote
from vecfold.sources.files import read_content, scan_files
from vecfold.sources.store import append, create_if_missing, first_per_key, load_vectors, new_keys


def fresh_vectors(
    source: DataFrame, store: DataFrame, embedder, key: str, input_col: str, order: str,
    batch: int = DEFAULT_BATCH,
) -> DataFrame:
    """``(key, embedding)`` for the first row of each key that is not stored yet.

    ``embedder`` is a local one or a ``Remote``; vectors of another size than ``embedder.dim`` are refused.
    """
    wanted = list(dict.fromkeys([key, input_col, order]))
    first = first_per_key(new_keys(source, store, key).select(*wanted), key, order)
    first = first.select(key, input_col)
    if isinstance(embedder, Remote):
        found = embed_remote(
            first, input_col, "embedding", embedder.transport, embedder.shape, embedder.model, embedder.waits
        )
    else:
        found = embed(first, input_col, "embedding", embedder, batch)
    return load_vectors(found, embedder.dim, key)


def ingest(
    source: DataFrame,
    table: str,
    embedder,
    mode: str,
    model: str,
    key: str = "filename",
    input_col: str = "content",
    order: str | None = None,
    slices: int = 1,
    batch: int = DEFAULT_BATCH,
    stopped: Callable[[], bool] = lambda: False,
) -> None:
    """Embed and append the new keys of ``source``.

    Keys are split into ``slices`` by hash and each slice is one committed append: a stop or a
    crash between slices leaves valid progress, and a rerun skips what is stored. The same
    call serves one micro-batch of a stream.
    """
    if order is None:
        raise ValueError("name the column whose order says which row of a key is the first")
    spark = source.sparkSession
    create_if_missing(spark, table, embedder.dim, key)
    for i in range(slices):
        if stopped():
            return
        part = source.filter(F.pmod(F.xxhash64(key), F.lit(slices)) == i) if slices > 1 else source
        store = spark.table(table).filter((F.col("embed_mode") == mode) & (F.col("model") == model))
        rows = fresh_vectors(part, store, embedder, key, input_col, order, batch)
        append(rows, table, mode, model)


def ingest_files(
    spark: SparkSession, path: str, table: str, embedder, mode: str, model: str,
    slices: int = 1, batch: int = DEFAULT_BATCH, stopped: Callable[[], bool] = lambda: False,
) -> None:
    """Ingest the images of a folder; bytes are read only for files not stored yet."""
    create_if_missing(spark, table, embedder.dim)
    listed = scan_files(spark, path, images_only=True).select("filename", "path")
    for i in range(slices):
        if stopped():
            return
        part = listed.filter(F.pmod(F.xxhash64("filename"), F.lit(slices)) == i)
        store = spark.table(table).filter((F.col("embed_mode") == mode) & (F.col("model") == model))
        todo = first_per_key(new_keys(part, store, "filename"), "filename", "path")
        rows = embed(read_content(todo), "content", "embedding", embedder, batch)
        append(rows, table, mode, model)
