"""Ingest of a stream of records into a vector table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vecfold.operators.embed import DEFAULT_BATCH
from vecfold.operators.ingest import ingest


def ingest_stream(
    source: DataFrame, table: str, embedder, mode: str, model: str, checkpoint: str,
    key: str = "filename", input_col: str = "content", order: str | None = None,
    batch: int = DEFAULT_BATCH, trigger: dict | None = None,
) -> StreamingQuery:
    """Runs ``ingest`` on every micro-batch.

    A micro-batch that is replayed after a failure adds nothing, because its keys are stored.
    ``order`` is needed, as for ``ingest``; without it no stream is started.
    """
    if order is None:
        raise ValueError("name the column whose order says which row of a key is the first")

    def commit(rows: DataFrame, _epoch: int) -> None:
        ingest(rows, table, embedder, mode, model, key, input_col, order, batch=batch)

    return (
        source.writeStream.foreachBatch(commit)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
