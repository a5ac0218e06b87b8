"""Texts packed into blocks that a task works on as a whole, and are read again later.

A block holds whole documents up to a bound of bytes (a longer document is a block of its own). Blocks
are written once, so every later pass sees the same ones, whatever executors are lost. What a pass
asks others about a block, and what it is answered, are packed arrays keyed by the block.
"""

from __future__ import annotations

import uuid
from typing import Callable, Iterator, NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vecfold.plans.lineage import scratch_dir

# Takes the place of a missing id: such rows come last.
NO_ID = (1 << 63) - 1
SCHEMA = "block long, ids binary, lengths binary, data binary"


def compress(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


class Block(NamedTuple):
    """Ids and byte ends of the documents, and their bytes one after another."""

    ids: np.ndarray
    ends: np.ndarray
    data: bytes

    @property
    def starts(self) -> np.ndarray:
        return np.append(0, self.ends[:-1]).astype(np.int64)


def load(ids: bytes, lengths: bytes, data: bytes) -> Block:
    return Block(np.frombuffer(ids, "<i8"), np.cumsum(np.frombuffer(lengths, "<i8")), expand(data))


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple[int, Block, int]]:
    """(block number, block, row of the batch)."""
    for row, number in enumerate(batch.column("block").to_pylist()):
        yield number, load(*(batch.column(c)[row].as_py() for c in ("ids", "lengths", "data"))), row


def _texts(number: int, ids: list[int], texts: list[bytes]) -> pa.RecordBatch:
    lengths = np.array([len(t) for t in texts], "<i8").tobytes()
    columns = [number], [np.array(ids, "<i8").tobytes()], [lengths], [compress(b"".join(texts))]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, (pa.int64(), *(pa.binary(),) * 3))], ["block", "ids", "lengths", "data"]
    )


def _packer(size: int, row: Callable):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        texts: list[bytes] = []
        held = 0

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                data = text.as_py()
                if texts and held + len(data) > size:
                    yield row(number, ids, texts)
                    ids, texts, held, number = [], [], 0, number + 1
                ids.append(doc_id), texts.append(data)
                held += len(data)
        if texts:
            yield row(number, ids, texts)

    return pack


def stored(df: DataFrame, **metrics) -> tuple[DataFrame, dict]:
    """Writes packed rows to the shared folder as they are (they are compressed) and reads them back."""
    path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    seen = Observation(uuid.uuid4().hex)
    observed = df.observe(seen, F.count(F.lit(1)).alias("n"), *[m.alias(k) for k, m in metrics.items()])
    observed.write.option("compression", "none").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get


def build(docs: DataFrame, size: int, tokens: Callable | None = None, schema: str = SCHEMA) -> tuple[DataFrame, int]:
    """The blocks of ``doc_id, text``, and the bytes of all texts; a null text is empty, a null id ``NO_ID``.

    With ``tokens`` a block's row is what that makes of its number, ids and texts, in the columns of ``schema``.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.encode(text, "UTF-8").alias("text"))
    seen = Observation(uuid.uuid4().hex)
    counted = rows.observe(seen, F.sum(F.length("text").cast("long")).alias("bytes"))
    blocks, _ = stored(counted.mapInArrow(_packer(size, tokens or _texts), schema))
    return blocks, seen.get["bytes"] or 0


def answered(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Blocks with ``answers`` (``block, part, answer``) gathered to the arrays ``parts`` and ``answers``."""
    each = answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "answer"))).alias("of"))
    joined = blocks.join(each.withColumnRenamed("block", "_block"), F.col("block") == F.col("_block"), "left")
    return joined.select(*blocks.columns, F.col("of.part").alias("parts"), F.col("of.answer").alias("answers"))
