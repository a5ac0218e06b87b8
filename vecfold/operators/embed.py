"""Embedding as Arrow batches through a pluggable embedder, local or remote."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecfold.functions.payloads import content_request, model_request, reply_vectors
from vecfold.functions.vectors import pool

DEFAULT_BATCH = 8  # items per embedder call
IN_FLIGHT = 4  # remote requests per worker
RETRY_WAITS = (1.0, 2.0, 3.0)  # seconds between tries of the "content" service


def guard_input(df: DataFrame, col: str) -> DataFrame:
    """Embedder input has to be string or binary (checked now) and non-null (checked per row)."""
    kind = df.schema[col].dataType
    if not isinstance(kind, (T.StringType, T.BinaryType)):
        raise TypeError(f"embedder input {col} must be string or binary, is {kind.simpleString()}")
    null = F.raise_error(F.lit(f"embedder input {col} is null")).cast(kind)
    return df.withColumn(col, F.coalesce(F.col(col), null))


def embed(
    df: DataFrame,
    input_col: str,
    out_col: str,
    embedder,
    batch: int = DEFAULT_BATCH,
) -> DataFrame:
    """Replaces ``input_col`` by its vector in ``out_col``; all other columns travel along.

    ``embedder`` is an object, or a callable without ``dim`` that builds one in each worker
    (for models that do not pickle).
    """
    df = guard_input(df, input_col)
    kept = [c for c in df.columns if c != input_col]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(out_col, T.ArrayType(T.FloatType()))])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        model = embedder if hasattr(embedder, "embed_batch") else embedder()
        for rows in batches:
            for start in range(0, rows.num_rows, batch):
                part = rows.slice(start, batch)
                vectors = np.asarray(model.embed_batch(part.column(input_col).to_pylist()), "f4")
                if vectors.shape != (part.num_rows, model.dim):
                    raise ValueError(
                        f"embedder returned {vectors.shape}, expected {(part.num_rows, model.dim)}"
                    )
                offsets = np.arange(part.num_rows + 1, dtype="i4") * model.dim
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in kept] + [column], names=[*kept, out_col]
                )

    return df.select(*kept, input_col).mapInArrow(run, schema)


@dataclass(frozen=True)
class Remote:
    """A remote embedding service with vectors of size ``dim``, used like a local embedder."""

    transport: Callable[[str], str]
    dim: int
    shape: str = "content"
    model: str = ""
    waits: tuple[float, ...] = RETRY_WAITS


def call_with_retry(transport: Callable[[str], str], request: str, waits, sleep) -> str:
    for wait in waits:
        try:
            return transport(request)
        except Exception:
            sleep(wait)
    return transport(request)


def embed_remote(
    df: DataFrame,
    input_col: str,
    out_col: str,
    transport: Callable[[str], str],
    shape: str = "content",
    model: str = "",
    waits: tuple[float, ...] = RETRY_WAITS,
) -> DataFrame:
    """Vectors from a remote service reached through ``transport(request) -> reply``.

    At most ``IN_FLIGHT`` requests run at once per worker. Only the "content" service retries.
    Every reply stays on the row of its request, whatever order replies come in.
    """
    df = guard_input(df, input_col)
    data = F.col(input_col).cast("binary")
    request = content_request(data) if shape == "content" else model_request(data, model)
    waits = waits if shape == "content" else ()
    kept = [c for c in df.columns if c != input_col]
    asked = df.select(*kept, request.alias("_request"))
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField("_reply", T.StringType())])

    def run(batches):
        import time
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(IN_FLIGHT) as workers:
            for pdf in batches:
                for start in range(0, len(pdf), 16 * IN_FLIGHT):
                    part = pdf.iloc[start : start + 16 * IN_FLIGHT]
                    replies = workers.map(
                        lambda r: call_with_retry(transport, r, waits, time.sleep), part["_request"]
                    )
                    yield part.drop(columns="_request").assign(_reply=list(replies))

    answered = asked.mapInPandas(run, schema)
    vectors = reply_vectors(F.col("_reply"), shape)
    return answered.select(*kept, pool(vectors).cast("array<float>").alias(out_col))
